"""Subword vocabularies: BPE learned on the word-frequency table, encoding of distinct words, selection of a size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut

SPECIALS = ["<pad>", "<unk>", "<s>", "</s>"]
MARK = "▁"
EOS = 3


def training_lines(docs: DataFrame, text: str = "text", share: float = 0.25, least: int = 20, limit: int = 3_000_000, seed: int = 1337) -> DataFrame:
    """A seeded Bernoulli sample of lines of a least length, up to a limit (this sampling operator's feature).

    Beyond the limit the lines that come first in a seeded order stay. Lines are counted by ranges of that order, so only the
    one range where the limit falls is sorted.
    """
    each = docs.select("doc_id", F.posexplode(T.lines(F.col(text))).alias("pos", "raw")).select("doc_id", "pos", T.strip(F.col("raw")).alias("line"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "pos"), F.lit(1_000_000)) < int(share * 1_000_000)
    order = F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "pos")
    sample = each.where((F.length("line") >= least) & drawn).withColumn("o", order).withColumn("range", F.shiftright("o", 48))
    left = limit
    for r, n in sorted(map(tuple, sample.groupBy("range").count().collect())):  # 65,536 rows at most
        if n > left:
            last = sample.where(F.col("range") == r).orderBy("o", "doc_id", "pos", "line").limit(left)
            return sample.where(F.col("range") < r).unionByName(last).select("line")
        left -= n
    return sample.select("line")


#: Distinct words that are counted at a time: some tens of MB. Then the counts so far are given out.
WORDS_AT_ONCE = 200_000


def word_frequencies(lines: DataFrame, column: str = "line") -> DataFrame:
    """(word, n): the only step that sees the corpus; words are counted where the texts are read, only counts are shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                seen.update((t.as_py() or "").split())
                if len(seen) >= WORDS_AT_ONCE:
                    yield given()
        yield given()

    return lines.select(column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_bpe(words: DataFrame, size: int, coverage: float = 0.9995) -> list[str]:
    """Pieces by id: specials, 256 bytes, merged pieces in order of merging, single characters.

    words: (word, n). Merges are learned on all words; ties go to the smaller pair. The trainer is sequential by nature and
    holds the distinct words on the driver, a number of 2 or 4 bytes a character (some times that while it merges); words are
    in the order of their frequency, so that only the places where it changes are kept.
    """
    t = words.select("word", F.col("n").cast("long").alias("n")).toArrow()
    t = t.take(np.argsort(t["n"].to_numpy(), kind="stable"))
    end = "\ud800"  # never in a text

    def codes() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, t.num_rows, 100_000):
            part = t.slice(lo, 100_000)
            code = np.frombuffer("".join([f"{MARK}{w}{end}" for w in part["word"].to_pylist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            at_end = code == ord(end)
            yield code, np.where(at_end, 0, part["n"].to_numpy()[np.minimum(np.cumsum(at_end), part.num_rows - 1)])

    count = np.zeros(0x110000, np.int64)
    for code, n in codes():
        np.add.at(count, code, n)
    total, seen, alphabet = int(count.sum()), 0, []
    for c in sorted(np.flatnonzero(count).tolist(), key=lambda c: (-count[c], c)):
        if seen >= coverage * total:
            break
        alphabet.append(chr(c))
        seen += int(count[c])
    kind = np.int16 if max(size, len(alphabet)) < 1 << 15 else np.int32
    number = np.full(0x110000, -1, kind)
    number[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    ends = np.cumsum(pc.utf8_length(t["word"]).to_numpy().astype(np.int64) + 2)
    symbols = np.empty(ends[-1] if len(ends) else 0, kind)  # -1: an end or an unknown character
    at = 0
    for code, _ in codes():
        symbols[at : at + len(code)] = number[code]
        at += len(code)
    weight, first = np.unique(t["n"].to_numpy(), return_index=True)
    starts = np.r_[0, ends][first]  # where words of each weight begin
    del t, ends
    texts = list(alphabet)
    ids = {c: i for i, c in enumerate(texts)}
    pairs: Counter = Counter()

    def add(slots: np.ndarray, sign: int) -> None:
        """Counts the pairs that begin at these places."""
        slots = slots[(slots >= 0) & (slots < len(symbols) - 1)]
        slots = slots[(symbols[slots] >= 0) & (symbols[slots + 1] >= 0)]
        keys, of = np.unique(symbols[slots].astype(np.int64) << 32 | symbols[slots + 1], return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, of, weight[np.searchsorted(starts, slots, side="right") - 1])
        for k, n in zip(keys.tolist(), sums.tolist(), strict=True):
            p = (k >> 32, k & 0xFFFFFFFF)
            pairs[p] += sign * n
            if pairs[p] <= 0:
                del pairs[p]

    for lo in range(0, len(symbols), 4_000_000):
        add(np.arange(lo, min(lo + 4_000_000, len(symbols))), 1)
    merges: list[str] = []
    room = size - len(SPECIALS) - 256 - len(alphabet)
    while len(merges) < room and pairs:
        x, y = min(pairs, key=lambda p: (-pairs[p], texts[p[0]], texts[p[1]]))
        if pairs[x, y] < 2:
            break
        merges.append(texts[x] + texts[y])
        new = ids.setdefault(merges[-1], len(texts))
        if new == len(texts):
            texts.append(merges[-1])
        at = np.flatnonzero((symbols[:-1] == x) & (symbols[1:] == y))
        if x == y:  # of places in a row every other, from the left
            head = np.r_[True, at[1:] != at[:-1] + 1]
            at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]
        add(np.unique(np.concatenate([at - 1, at, at + 1])), -1)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols[at] = new
        symbols, starts = symbols[stay], starts - np.searchsorted(at + 1, starts)
        at = at - np.arange(len(at))
        add(np.unique(np.concatenate([at - 1, at])), 1)
    return [*SPECIALS, *(f"<0x{b:02X}>" for b in range(256)), *dict.fromkeys([*merges, *alphabet])]


def encode_word(word: str, rank: dict[str, int]) -> list[int]:
    """Ids of a marked word: the adjacent pair with the lowest rank merges first; unknown characters become bytes."""
    s = list(MARK + word)
    while len(s) > 1:
        found = [(rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False))]
        r, i = min(found)
        if r == 1 << 30:
            break
        s[i : i + 2] = [s[i] + s[i + 1]]
    out: list[int] = []
    for p in s:
        out += [rank[p]] if p in rank else [len(SPECIALS) + b for b in p.encode()]
    return out


def encoder(pieces: list[str]):
    """Column function word -> array<int>. The vocabulary's size is fixed, so it is broadcast."""
    rank = {p: i for i, p in enumerate(pieces) if i >= len(SPECIALS) + 256}

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for s in batches:
            for w in set(s) - known.keys():
                known[w] = encode_word(w, rank)
            yield s.map(known.__getitem__)
            if len(known) > 500_000:
                known.clear()

    return encode


def decode(ids: Column, pieces: Column) -> Column:
    """Text of ids up to the first end of text; pieces: the vocabulary as an array. Byte pieces stay written out."""
    end = F.array_position(ids, F.lit(EOS))
    cut = F.when(end > 0, F.slice(ids, F.lit(1), (end - 1).cast("int"))).otherwise(ids)
    return F.ltrim(F.replace(F.array_join(F.transform(cut, lambda i: F.get(pieces, i)), ""), F.lit(MARK), F.lit(" ")))


def encode_measures(words: DataFrame, pieces: list[str]) -> DataFrame:
    """words: (word, n, any keys). Every distinct word is encoded once; adds ids."""
    distinct = words.select("word").distinct().withColumn("ids", encoder(pieces)(F.col("word")))
    return words.join(distinct, "word")


def select_vocabulary(candidates: DataFrame, cap: int, tolerance: float = 0.03) -> DataFrame:
    """The smallest size within the tolerance of the best fertility among those under the cap; none under it: the smallest."""
    under = candidates.where(F.col("vocab_size") <= cap)
    best = under.agg(F.min("fertility").alias("best"))
    near = under.join(F.broadcast(best), F.col("fertility") <= F.col("best") * (1 + tolerance))  # one row
    return near.agg(F.min("vocab_size").alias("a")).join(candidates.agg(F.min("vocab_size").alias("b")), F.lit(True)).select(F.coalesce("a", "b").alias("vocab_size"))


def evaluate_candidates(encoded: DataFrame) -> DataFrame:
    """encoded: (vocab_size, word, n, pieces, known_pieces). One row a candidate: fertility, characters a token, the share of
    words of one piece, of words that go on in a further piece, of pieces that are bytes, and what was encoded."""
    n, p = F.col("n"), F.col("pieces")
    total = lambda c: F.sum(c * n)
    return encoded.groupBy("vocab_size").agg(
        F.count(F.lit(1)).alias("distinct_words"), F.sum("n").alias("words"), total(p).alias("tokens"), (total(p) / F.sum("n")).alias("fertility"),
        (total(F.length("word")) / total(p)).alias("chars_per_token"), (total((p == 1).cast("long")) / F.sum("n")).alias("whole_share"),
        (total((p > 1).cast("long")) / F.sum("n")).alias("continued_share"), (total(p - F.col("known_pieces")) / total(p)).alias("byte_share"),
    )


def lookup_selected(candidates: DataFrame, cap: int, tolerance: float = 0.03) -> DataFrame:
    """The row of the selected size. The rows, one a size, are made once, though they are read four times."""
    candidates = cut(candidates)
    return candidates.join(F.broadcast(select_vocabulary(candidates, cap, tolerance)), "vocab_size")  # one row
