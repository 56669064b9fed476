"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting: words of training texts become 64-bit hashes; words, pairs and triples are counted in each Arrow batch and summed by
ranges of their hashes. An n-gram with count c is quantised to q = 1 + floor(log2 c) and put into a Bloom filter level by
level, as (n-gram, 1) to (n-gram, q). Probing one level after the other until a miss gives q back, and 2^(q-1) as a count
that is never too high but for false positives (``BITS`` bits an entry, ``PROBES`` of them set, all within one word of 64 bits:
2 to 3 %). Triples have no entry for level 1: one that occurs once, as it does in the very text that is scored, isn't told from
an unseen one. All are counted, at every size of the corpus alike.

Scoring, all counts of pairs and triples from probes:

    P(w | u v) = b * c(u v w) / c(u v) + (1 - b) * P(w | v)     where u v has come twice or more, else P(w | v)
    P(w | v)   = a * c(v w) / c(v)     + (1 - a) * P(w)         where v is known, else P(w)
    P(w)       = (c(w) + 1) / (N + V + 1)

P(w) has exact counts, as the base score asks for them. b = (tokens in repeated triples) / (tokens in repeated pairs), over the
whole training corpus: how often, one occurrence left out, a known pair goes on in a known way. a = ``WEIGHT``. Texts begin with
a start and end with an end.

Every range of hashes has its own block of the filter, sized by its entries. If all blocks and the exact counts of words together
stay under ``max_broadcast`` bytes they are broadcast, and texts are scored where they are read. Otherwise both stay with
their ranges and the requests of groups of texts travel to them, with the same results.

Defined results: null or empty text is its end alone. Held-out rows (by ``held_out``) are not learned from; without
training rows N and V are 0. Rows of one id are each scored. Words are compared by 64-bit hashes. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, table
from .shingles import WordHashes, mixed, words

END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n", b"\r"))  # no word holds white space
BITS, PROBES, WEIGHT = 9, 4, 0.1
BATCH_BYTES, KNOWN = 3_000_000, 100_000
#: Text behind a range of hashes, and of a group of texts that sends its requests.
RANGE_BYTES, GROUP_BYTES = 64_000_000, 16_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)


def tokens(texts: list, known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all tokens, hashes of their contexts, tokens of each text)."""
    out = []
    for x in texts:
        w = words(x)
        a = np.empty(len(w) + 1, np.uint64)
        a[:-1] = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        a[-1] = END
        out.append(a)
    n = np.array([len(a) for a in out], np.int64)
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(n) - n] = START
    return h, before, n


def pair_hash(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(before * GOLD + h)


def triple_hash(p: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the pair before a token and the token; a text's first token, at the places first, has none (0)."""
    t = np.zeros_like(h)
    t[1:] = mixed(p[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])
    t[first] = 0
    return t


def ranges(h: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash; ranges follow the order of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def within(h: np.ndarray) -> np.ndarray:
    """32 bits that name a pair or triple within its range (the filter is approximate anyway)."""
    return (mixed(h) & LOW).astype(np.uint32)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c, first)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)


def _spot(keys: np.ndarray, kind: int, level: int, words_: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(the word of the block, the mask of its bits) of n-grams of a kind (2: pairs, 3: triples) at a level."""
    a = mixed(keys.astype(np.uint64) * GOLD + np.uint64(64 * kind + level))
    mask = np.zeros(len(a), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << (a >> np.uint64(6 * i) & np.uint64(63))
    return ((a >> np.uint64(32)) * np.asarray(words_, np.uint64) >> np.uint64(32)).astype(np.int64), mask


def filter_block(pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> bytes:
    """pairs, triples: (32-bit keys, counts)."""
    put = [(kind, kind - 1, keys, levels(counts)) for kind, (keys, counts) in ((2, pairs), (3, triples))]
    entries = sum(int(np.maximum(q - least + 1, 0).sum()) for _, least, _, q in put)
    block = np.zeros(-(-entries * bits // 64), np.uint64)
    for kind, least, keys, q in put:
        for level in range(least, int(q.max(initial=0)) + 1):
            at, mask = _spot(keys[q >= level], kind, level, len(block))
            np.bitwise_or.at(block, at, mask)
    return block.tobytes()


class Filter:
    """The blocks of all ranges, or of one, as one array."""

    def __init__(self, blocks: bytes, sizes: list[int]):
        """blocks: end to end. sizes: bytes of each."""
        self.block = np.frombuffer(blocks, "<u8")
        self.sizes = np.array(sizes, np.uint64) // np.uint64(8)
        self.bases = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)

    def probe(self, keys: np.ndarray, kind: int, of: np.ndarray | None = None) -> np.ndarray:
        """The quantised count (0: not in the filter) of each key, by probes of one level after the other. of: the keys' ranges."""
        of = np.zeros(len(keys), np.int64) if of is None else of
        q, open_ = np.zeros(len(keys), np.uint8), np.flatnonzero(self.sizes[of] > 0) if len(keys) else np.zeros(0, np.int64)
        level = kind - 1  # the least that has entries
        while len(open_):
            r = of[open_]
            at, mask = _spot(keys[open_], kind, level, self.sizes[r])
            open_ = open_[self.block[self.bases[r] + at] & mask == mask]
            q[open_] = level
            level += 1
        return q


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list]:
    texts, held = [], 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            texts.append(x)
            held += len(x or "")
            if held >= most:
                yield texts
                texts, held = [], 0
    if texts:
        yield texts


PARTIAL = "bucket int, words binary, word_counts binary, pairs binary, pairs_again binary, pair_counts binary, triples binary, triples_again binary, triple_counts binary"
TOTALS = "bucket int, words binary, word_counts binary, n_words long, n_tokens long, pairs_again long, triples_again long, block binary"


def _ranged(u: np.ndarray, buckets: int) -> list[slice]:
    at = np.searchsorted(ranges(u, buckets), np.arange(buckets + 1)).tolist()
    return [slice(x, y) for x, y in zip(at, at[1:], strict=False)]


def count(docs: DataFrame, text_col: str, buckets: int, bits: int = BITS) -> DataFrame:
    """TOTALS of each range of hashes."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(KNOWN)
        for texts in _grouped(batches, BATCH_BYTES):
            h, before, n = tokens(texts, known)
            p = pair_hash(before, h)
            first = np.cumsum(n) - n
            t = np.delete(triple_hash(p, h, first), first)
            u, c = np.unique(h, return_counts=True)
            columns = [[u[x].tobytes() for x in _ranged(u, buckets)], [c[x].astype("<u4").tobytes() for x in _ranged(u, buckets)]]
            for grams in (p, t):  # of those that occur once in the batch only the keys
                u, c = np.unique(grams, return_counts=True)
                w = within(u)
                each = [(w[x], c[x]) for x in _ranged(u, buckets)]
                columns += [[k[m == 1].tobytes() for k, m in each], [k[m > 1].tobytes() for k, m in each], [m[m > 1].astype("<u4").tobytes() for _, m in each]]
            yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), *[pa.array(x, pa.binary()) for x in columns]], names=[x.split()[0] for x in PARTIAL.split(", ")])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        get = lambda c, kind: [np.frombuffer(x, kind) for x in rows[c].to_pylist()]
        u, c = summed(get("words", "<u8"), [x.astype(np.int64) for x in get("word_counts", "<u4")])
        both = []
        for name in ("pair", "triple"):
            once = get(f"{name}s", "<u4")
            both.append(summed(once + get(f"{name}s_again", "<u4"), [np.ones(len(x), np.int64) for x in once] + [x.astype(np.int64) for x in get(f"{name}_counts", "<u4")]))
        again = [int(k[k > 1].sum()) for _, k in both]
        return pa.table({
            "bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([u.tobytes()], pa.binary()), "word_counts": pa.array([c.astype("<i8").tobytes()], pa.binary()),
            "n_words": [len(u)], "n_tokens": [int(c.sum())], "pairs_again": [again[0]], "triples_again": [again[1]], "block": pa.array([filter_block(*both, bits)], pa.binary()),
        })

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(partial, PARTIAL).groupBy("bucket").applyInArrow(total, TOTALS)


class Scorer:
    """What is asked for a list of texts, and their scores by the answers."""

    def __init__(self, texts: list, known: WordHashes):
        self.h, self.before, self.n = tokens(texts, known)
        self.first = np.cumsum(self.n) - self.n
        self.p = pair_hash(self.before, self.h)
        self.t = triple_hash(self.p, self.h, self.first)
        self.words, self.of_word = np.unique(self.h, return_inverse=True)
        self.pairs, self.of_pair = np.unique(self.p, return_inverse=True)
        self.triples, self.of_triple = np.unique(self.t, return_inverse=True)

    def scores(self, counts: np.ndarray, q2: np.ndarray, q3: np.ndarray, n_tokens: int, n_words: int, go_on: float, weight: float) -> dict[str, pa.Array]:
        """counts, q2, q3: of the distinct words, pairs and triples."""
        c, q2, q3 = counts[self.of_word].astype(np.float64), q2[self.of_pair].astype(np.float64), q3[self.of_triple].astype(np.float64)
        cv = np.empty_like(c)
        cv[1:] = c[:-1]
        cv[self.first] = counts[np.searchsorted(self.words, END)] if len(self.words) else 0  # as many starts as ends
        one = (c + 1) / (n_tokens + n_words + 1)
        two = np.minimum(1.0, np.where(q2 > 0, np.exp2(q2 - 1), 0.0) / np.maximum(cv, 1))
        prob = np.where(cv > 0, weight * two + (1 - weight) * one, one)
        q_before = np.zeros_like(q2)
        q_before[1:] = q2[:-1]
        q_before[self.first] = 0
        # no triple comes more often than its pairs, so one whose pairs came once is a false positive
        three = np.where((q3 > 1) & (q2 > 1), np.exp2(np.minimum(0.0, q3 - q_before)), 0.0)
        prob = np.where(q_before > 1, go_on * three + (1 - go_on) * prob, prob)
        add = lambda x: np.add.reduceat(x, self.first) if len(x) else x
        return {
            "n_tokens": pa.array(self.n), "n_known": pa.array(add((c > 0).astype(np.int64))), "train_tokens": pa.array([n_tokens] * len(self.n), pa.int64()),
            "base_score": pa.array(add(np.log10(one))), "score": pa.array(add(np.log10(prob))),
        }


def count_of(words_: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(words_):
        return np.zeros(len(asked), np.int64)
    i = np.minimum(np.searchsorted(words_, asked), len(words_) - 1)
    return np.where(words_[i] == asked, counts[i], 0).astype(np.int64)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 256 << 20, weight: float = WEIGHT, bits: int = BITS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score)."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    buckets = max(shuffle_parts(docs.sparkSession), -(-n_bytes // RANGE_BYTES))
    counted = cut(count(docs.where(training), text_col, buckets, bits))
    sums = counted.agg(*[F.sum(c) for c in ("n_words", "n_tokens", "pairs_again", "triples_again")], F.sum(F.octet_length("block")), F.max("n_tokens")).first()
    n_words, n_tokens, pairs, triples, filter_bytes, most = (int(x or 0) for x in sums)
    # one in twenty of known pairs may always go on in a new way: a corpus of copies alone leaves room for other texts
    go_on = min(0.95, triples / pairs) if pairs else 0.0
    facts = (n_tokens, n_words, go_on, weight)
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {dict(d.dtypes)['id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    wide = "<u4" if most < 1 << 32 else "<i8"
    if filter_bytes + n_words * (8 + np.dtype(wide).itemsize) <= max_broadcast:
        return d.mapInArrow(_in_place(_sent(counted, buckets, wide), buckets, facts), schema)
    return _by_requests(d, counted, buckets, n_bytes, facts, schema)


def _sent(counted: DataFrame, buckets: int, wide: str):
    """The whole model as a broadcast; its size is checked before."""
    parts: dict[str, dict[int, bytes]] = {"words": {}, "word_counts": {}, "block": {}}
    for r in counted.select("bucket", *parts).toLocalIterator():
        for c, of in parts.items():
            of[r["bucket"]] = np.frombuffer(r[c], "<i8").astype(wide).tobytes() if c == "word_counts" else bytes(r[c])
    sizes = [len(parts["block"].get(b, b"")) for b in range(buckets)]
    whole = [b"".join([of.pop(b, b"") for b in range(buckets)]) for of in parts.values()]
    return counted.sparkSession.sparkContext.broadcast((whole[0], whole[1], wide, whole[2], sizes))


def _in_place(sent, buckets: int, facts: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, counts, wide, *blocks = sent.value
        # views of the one copy that a worker holds
        words_, counts, filter_, known = np.frombuffer(words_, "<u8"), np.frombuffer(counts, wide), Filter(*blocks), WordHashes(KNOWN)
        for batch in batches:
            for rows in slices(batch, BATCH_BYTES // 3):
                s = Scorer(rows.column(1).to_pylist(), known)
                q2 = filter_.probe(within(s.pairs), 2, ranges(s.pairs, buckets))
                worth = np.zeros(len(s.triples), bool)  # a triple is known only if its later pair is
                worth[s.of_triple[q2[s.of_pair] > 1]] = True
                q3, ask = np.zeros(len(s.triples), np.uint8), s.triples[worth]
                q3[worth] = filter_.probe(within(ask), 3, ranges(ask, buckets))
                yield pa.RecordBatch.from_pydict({"id": rows.column(0), **s.scores(count_of(words_, counts, s.words), q2, q3, *facts)})

    return run


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of text in its second column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _by_requests(d: DataFrame, counted: DataFrame, buckets: int, n_bytes: int, facts: tuple, schema: str) -> DataFrame:
    groups = max(4 * shuffle_parts(d.sparkSession), -(-n_bytes // GROUP_BYTES))
    d = d.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int"))

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        s = Scorer(rows["text"].to_pylist(), WordHashes(KNOWN))
        ask_of = [[u[x] for x in _ranged(u, buckets)] for u in (s.words, s.pairs, s.triples)]
        sent = [[x.tobytes() for x in ask_of[0]], *[[within(x).tobytes() for x in u] for u in ask_of[1:]]]
        pick = [b for b in range(buckets) if any(u[b] for u in sent)]
        return pa.table({"bucket": pa.array(pick, pa.int32()), "part": pa.array([key[0].as_py()] * len(pick), pa.int32()), **{c: pa.array([u[b] for b in pick], pa.binary()) for c, u in zip(("words", "pairs", "triples"), sent, strict=True)}})

    def answer(key: tuple, asked: pa.Table, have: pa.Table) -> pa.Table:
        words_, counts, block = np.zeros(0, np.uint64), np.zeros(0, np.int64), b""
        if have.num_rows:
            words_, counts, block = np.frombuffer(have["words"][0].as_py(), "<u8"), np.frombuffer(have["word_counts"][0].as_py(), "<i8"), have["block"][0].as_py()
        filter_ = Filter(block, [len(block)])
        out = {"counts": [count_of(words_, counts, np.frombuffer(x, "<u8")).astype("<i8").tobytes() for x in asked["words"].to_pylist()]}
        for name, kind in (("pairs", 2), ("triples", 3)):
            out[name] = [filter_.probe(np.frombuffer(x, "<u4"), kind).tobytes() for x in asked[name].to_pylist()]
        return pa.table({"part": asked["part"], "bucket": asked["bucket"], **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    def finish(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        s = Scorer(rows["text"].to_pylist(), WordHashes(KNOWN))
        a = answers.sort_by("bucket")
        joined = lambda c, kind: np.frombuffer(b"".join(a[c].to_pylist()), kind)
        return pa.table({"id": rows["id"], **s.scores(joined("counts", "<i8"), joined("pairs", np.uint8), joined("triples", np.uint8), *facts)})

    asked = d.groupBy("part").applyInArrow(ask, "bucket int, part int, words binary, pairs binary, triples binary")
    have = counted.select("bucket", "words", "word_counts", "block")
    answers = asked.groupBy("bucket").cogroup(have.groupBy("bucket")).applyInArrow(lambda k, x, y: answer(k, x, y), "part int, bucket int, counts binary, pairs binary, triples binary")
    return d.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda k, x, y: finish(k, x, y), schema)


def held_out(fold: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, ~held_out()).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
