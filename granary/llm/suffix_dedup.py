"""Suffix-array dedup: bytes covered by a long string that already stands earlier are removed.

A sparse suffix array over anchors instead of all suffixes: each string of ``length`` bytes has one anchor, the place of the
least hash among its ``GRAM``-byte grams (the leftmost of equals), so equal strings have equal anchors at equal offsets.
About one place in forty is an anchor, and only strings whose anchor's gram stands elsewhere can stand twice.

1. Documents are dealt into parts of some MB. A part sends the distinct hashes of its anchors to ranges of hashes, which
   answer which of them other parts have as well.
2. A part sorts its own repeated strings and removes all but the first of each; a copied document costs nothing more.
   Of what is first in the part, the surroundings of shared anchors go on: a hot passage is sent once a part, not once a copy.
3. Splitters sampled from the anchors' leading bytes range-partition these suffixes. A bucket holds every suffix
   that begins with the same bytes and sorts its strings by multikey quicksort: digests part different strings at
   once, then the bytes decide, eight at a time. Ranges cut between different leading bytes, so no run of
   equal strings crosses a boundary; that is what the comparison across boundaries comes to here.
   What stands at an anchor that more than ``HOT`` parts have is sorted twice: first among about the root of the number of parts,
   which pass on only the first of equal strings, then in its bucket. No task thus holds a copy from every part.
4. Removed ranges return to their parts, and the rest of each text is put together.

Order: smaller id, then earlier start; repeated ids by text; null ids come last, by a hash of their text. Defined results:
null or empty text has no bytes and loses none; texts shorter than ``length`` lose nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, table
from .lm import ranges
from .shingles import mixed

LENGTH, GRAM = 100, 24
#: Text of a part; its arrays take some hundred MB at most.
PART_BYTES = 4_000_000
HOT = 32
#: Text behind a range of hashes and a bucket of suffixes.
RANGE_BYTES = 128_000_000
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
BIG = np.iinfo(np.int64).max


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; places near the end are filled up with zeros."""
    n = len(buf)
    padded = np.zeros((n // 8 + 3) * 8, np.uint8)
    padded[:n] = buf
    out = np.empty((n // 8 + 1) * 8, np.uint64)
    for j in range(8):
        out[j::8] = padded[j : j + len(out)].view(np.uint64)
    return out[:n]


def digest_at(w: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit digests of the strings of length bytes at places of w (words8 of a buffer)."""
    steps = [*range(0, length - 7, 8)]
    if steps[-1] + 8 < length:
        steps.append(length - 8)
    h = np.zeros(len(at), np.uint64)
    for i, s in enumerate(steps):
        h = (h ^ w[at + s]) * PRIMES[i % 5]
        h ^= h >> np.uint64(29)
    return mixed(h)


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    out, have = g, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def ordered(ids: list, data: list[bytes]) -> tuple[list[int], list[tuple[int, int]]]:
    """(rows in the order of what counts as earlier, the key of each row). A row's rank in this order names it in its part: rows
    of a part may arrive in another order each time that it is read. Rows of equal keys and texts are interchangeable."""
    keys = [(BIG, xxhash.xxh64_intdigest(b) >> 1) if i is None else (i, 0) for i, b in zip(ids, data, strict=True)]
    return sorted(range(len(data)), key=lambda r: (keys[r], data[r])), keys


class Part:
    """The distinct texts of a part in order, in one buffer, with their anchors and the strings of each."""

    def __init__(self, ids: list, texts: list, length: int = LENGTH):
        self.length = length
        data = [(t or "").encode() for t in texts]
        order, keys = ordered(ids, data)
        rows, ranks, seen = [], [], set()
        for k, r in enumerate(order):
            if data[r] not in seen:
                seen.add(data[r])
                rows.append(r)
                ranks.append(k)
        sizes = np.array([len(data[r]) for r in rows], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.buf = np.frombuffer(b"".join([data[r] for r in rows]), np.uint8)
        self.rank = np.array(ranks, np.int32)
        self.id = np.array([keys[r][0] for r in rows], np.int64)
        self.tie = np.array([keys[r][1] for r in rows], np.int64)
        self.w = words8(self.buf)
        self._anchors()

    def _anchors(self) -> None:
        """anchor: its place, lo..hi: the places of its strings, doc: its text, gram: its hash."""
        n, width = len(self.buf), self.length - GRAM + 1
        none = np.zeros(0, np.int64)
        self.anchor, self.lo, self.hi, self.doc, self.gram = none, none, none, none, np.zeros(0, np.uint64)
        if n < self.length:
            return
        at = np.arange(n - GRAM + 1)
        g = np.zeros(len(at), np.uint64)
        for i in range(0, GRAM, 8):
            g = (g ^ self.w[i : i + len(at)]) * PRIMES[i // 8]
            g ^= g >> np.uint64(31)
        g = mixed(g)
        least = sliding_min((g & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64), width)
        valid = np.zeros(len(least) + 1, np.int64)
        fits = self.ends - self.starts >= self.length
        np.add.at(valid, self.starts[fits], 1)
        np.add.at(valid, self.ends[fits] - self.length + 1, -1)
        s = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
        if not len(s):
            return
        a = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)])
        self.anchor, self.lo = a[first], s[first]
        self.hi = s[np.r_[first[1:] - 1, len(s) - 1]]
        self.doc = np.searchsorted(self.ends, self.anchor, side="right")
        self.gram = g[self.anchor]

    def places(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of all strings of the picked anchors, which of the picked each belongs to)."""
        n = self.hi[pick] - self.lo[pick] + 1
        of = np.repeat(np.arange(len(pick)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.lo[pick][of], of


def equal_runs(w: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings at places of w. Returns (indices into at, run of each) of strings that stand
    there more than once; equal strings have one run number. at must be in the order of what counts as earlier."""
    idx, run = np.arange(len(at)), np.zeros(len(at), np.int64)
    steps = [*range(0, length - 7, 8)]
    if steps[-1] + 8 < length:
        steps.append(length - 8)
    for step in [-1, *steps]:
        if not len(idx):
            break
        key = digest_at(w, at, length) if step < 0 else w[at[idx] + step]
        head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        if step >= 0 and (key == np.repeat(key[head], np.diff(np.r_[head, len(key)]))).all():
            continue  # all runs agree in these bytes
        order = np.lexsort((idx, key, run)) if step >= 0 else np.argsort(key, kind="stable")
        idx, key, run = idx[order], key[order], run[order]
        new = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])]
        run = np.cumsum(new) - 1
        several = np.bincount(run)[run] > 1
        idx, run = idx[several], run[several]
    return idx, run


def not_first(idx: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Of runs in stable order, all but the first of each."""
    return idx[np.r_[False, run[1:] == run[:-1]]] if len(idx) else idx


def merged(starts: np.ndarray, length: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct starts of strings as maximal runs (start, end) within each text; doc: the text of each start."""
    if not len(starts):
        return starts, starts
    first = np.flatnonzero(np.r_[True, (starts[1:] > starts[:-1] + length) | (doc[1:] != doc[:-1])])
    return starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]] + length


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary, spans array<struct<start, end>>); digest: kept_sha256 in place of both last."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    salt = F.when(F.col("id").isNull(), F.xxhash64("text"))
    n_rows, n_bytes = d.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(shuffle_parts(spark), -(-(n_bytes or 0) // RANGE_BYTES))
    parts = max(buckets, -(-(n_bytes or 0) // part_bytes))
    pools = max(1, round(parts**0.5))
    d = d.withColumn("part", F.pmod(F.xxhash64("id", salt), F.lit(parts)).cast("int"))
    cuts = _splitters(d, n_rows, parts, length)

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        u = np.unique(Part(rows["id"].to_pylist(), rows["text"].to_pylist(), length).gram)
        to, at = _runs(ranges(u, buckets))
        return pa.table({"bucket": pa.array(to, pa.int32()), "part": pa.array([key[0].as_py()] * len(to), pa.int32()), "grams": pa.array([u[x].tobytes() for x in at], pa.binary())})

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, "<u8") for x in asked["grams"].to_pylist()]
        u, n = np.unique(np.concatenate(grams), return_counts=True)
        pick = lambda some: pa.array([g[np.isin(g, some, assume_unique=True)].tobytes() for g in grams], pa.binary())
        return pa.table({"part": asked["part"], "grams": pick(u[n > 1]), "hot": pick(u[n > hot])})

    SENT = "bucket int, pool int, part int, kind int, id binary, tie binary, row binary, start binary, size binary, bytes binary"
    FOUND = "part int, row binary, start binary, size binary"

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], SENT)
        p = Part(rows["id"].to_pylist(), rows["text"].to_pylist(), length)
        shared, often = (np.unique(np.frombuffer(b"".join(answers[c].to_pylist()), "<u8")) for c in ("grams", "hot"))
        u, back, n = np.unique(p.gram, return_inverse=True, return_counts=True)
        at, _ = p.places(np.flatnonzero(n[back] > 1))
        later = np.sort(at[not_first(*equal_runs(p.w, at, length))])
        out: list[tuple] = []
        a, b = merged(later, length, np.searchsorted(p.ends, later, side="right"))
        doc = np.searchsorted(p.ends, a, side="right")
        part, blank = key[0].as_py(), b""
        out.append((part % len_buckets, -1, part, 0, blank, blank, p.rank[doc].tobytes(), (a - p.starts[doc]).tobytes(), (b - a).tobytes(), blank))
        # the first in this part of each string: runs of such places under one shared anchor go on with their surroundings
        pick = np.flatnonzero(np.isin(p.gram, shared))
        at, of = p.places(pick)
        keep = ~np.isin(at, later, assume_unique=True)
        at, of = at[keep], of[keep]
        if len(at):
            head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])
            start, size = at[head], at[np.r_[head[1:] - 1, len(at) - 1]] - at[head] + length
            anchor = p.anchor[pick][of[head]]
            leads = np.array([p.buf[x : x + GRAM].tobytes() for x in anchor.tolist()], f"S{GRAM}")
            to = np.searchsorted(np.array(cuts, f"S{GRAM}"), leads, side="right") if cuts else np.zeros(len(leads), np.int64)
            to = 2 * to + np.isin(p.gram[pick][of[head]], often)
            order = np.argsort(to, kind="stable")
            doc = np.searchsorted(p.ends, start, side="right")
            for b, at_b in zip(*_runs(to[order]), strict=True):
                i = order[at_b]
                k = doc[i]
                out.append((
                    b // 2, part % pools if b % 2 else -1, part, 1, p.id[k].tobytes(), p.tie[k].tobytes(), p.rank[k].tobytes(), (start[i] - p.starts[k]).tobytes(), size[i].tobytes(),
                    b"".join([p.buf[x : x + y].tobytes() for x, y in zip(start[i].tolist(), size[i].tolist(), strict=True)]),
                ))
        return _table(out, SENT)

    len_buckets = len(cuts) + 1

    def sort(rows: pa.Table, pass_on: bool) -> list[tuple]:
        """Rows of SENT: what is removed (kind 0) and, for what is sorted again, the first of equal strings (kind 1)."""
        kind, blank = rows["kind"].to_numpy(), b""
        # what parts have found by themselves passes through
        out = [tuple(r.values()) for r in rows.filter(pa.array(kind == 0)).to_pylist()]
        t = rows.filter(pa.array(kind == 1))
        if not t.num_rows:
            return out
        get = lambda c, k: np.frombuffer(b"".join(t[c].to_pylist()), k)
        ident, tie, start, size, row = get("id", "<i8"), get("tie", "<i8"), get("start", "<i8"), get("size", "<i8"), get("row", "<i4")
        part = np.repeat(t["part"].to_numpy(), [len(x) // 4 for x in t["row"].to_pylist()])
        buf = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8)
        base = np.cumsum(size) - size
        order = np.lexsort((start, tie, ident))
        n = size[order] - length + 1
        of = np.repeat(order, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = np.zeros(len(of), bool)
        gone[not_first(*equal_runs(words8(buf), base[of] + inner, length))] = True

        def segments(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(the sent run, first place in it, bytes) of maximal runs of picked places."""
            place, seg = inner[pick], of[pick]
            if not len(place):
                return seg, place, place
            head = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (place[1:] != place[:-1] + 1)])
            return seg[head], place[head], place[np.r_[head[1:] - 1, len(place) - 1]] - place[head] + length

        bucket = t["bucket"][0].as_py()
        for k, pick in ((0, gone), (1, ~gone))[: 1 + pass_on]:
            seg, place, long = segments(np.flatnonzero(pick))
            by = np.argsort(part[seg], kind="stable")
            for p, at in zip(*_runs(part[seg][by]), strict=True):
                i = by[at]
                j, at_text = seg[i], place[i] + start[seg[i]]
                if k == 0:
                    out.append((p % len_buckets, -1, p, 0, blank, blank, row[j].tobytes(), at_text.tobytes(), long[i].tobytes(), blank))
                else:
                    bytes_ = b"".join([buf[x : x + y].tobytes() for x, y in zip((base[j] + place[i]).tolist(), long[i].tolist(), strict=True)])
                    out.append((bucket, -1, p, 1, ident[j].tobytes(), tie[j].tobytes(), row[j].tobytes(), at_text.tobytes(), long[i].tobytes(), bytes_))
        return out

    def in_pools(key: tuple, rows: pa.Table) -> pa.Table:
        return _table(sort(rows, key[1].as_py() >= 0), SENT)

    def in_buckets(key: tuple, rows: pa.Table) -> pa.Table:
        return _table([(r[2], *r[6:9]) for r in sort(rows, False)], FOUND)

    def finish(key: tuple, rows: pa.Table, cut: pa.Table) -> pa.Table:
        ids, texts = rows["id"].to_pylist(), rows["text"].to_pylist()
        data = [(t or "").encode() for t in texts]
        get = lambda c, k: np.frombuffer(b"".join(cut[c].to_pylist()), k)
        row, start, size = get("row", "<i4"), get("start", "<i8"), get("size", "<i8")
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], start[order] + size[order]
        edges = np.searchsorted(row, np.arange(len(data) + 1))
        by_rank, _ = ordered(ids, data)
        copies = copies_of(by_rank, data)
        rank = np.empty(len(data), np.int64)
        rank[by_rank] = np.arange(len(data))
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
        for r, b in enumerate(data):
            if r in copies and len(b) >= length:
                spans = [(0, len(b))]
            else:
                mine = slice(edges[rank[r]], edges[rank[r] + 1])
                spans = union(start[mine].tolist(), end[mine].tolist())
            kept, at = [], 0
            for x, y in spans:
                kept.append(b[at:x])
                at = y
            kept = b"".join([*kept, b[at:]])
            for c, v in zip(out, (len(b), len(b) - len(kept), len(spans), kept, spans), strict=True):
                out[c].append(v)
        t = {"id": rows["id"], **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}}
        if digest:
            t["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in out["kept"]])
        else:
            t["kept"] = pa.array(out["kept"], pa.binary())
            t["spans"] = pa.array([[{"start": x, "end": y} for x, y in s] for s in out["spans"]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(t)

    asked = d.groupBy("part").applyInArrow(ask, "bucket int, part int, grams binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "part int, grams binary, hot binary")
    sent = d.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda k, x, y: send(k, x, y), SENT)
    found = sent.groupBy("bucket", "pool").applyInArrow(in_pools, SENT)
    found = found.groupBy("bucket").applyInArrow(in_buckets, FOUND) if parts > hot else found.select("part", "row", "start", "size")
    schema = "id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary, spans array<struct<start: long, end: long>>")
    return d.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(lambda k, x, y: finish(k, x, y), schema)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], pa.int32() if c.endswith("int") else pa.binary()) for i, c in enumerate(schema.split(", "))})


def _runs(a: np.ndarray) -> tuple[list, list]:
    """Values of a sorted array and the slices where they stand."""
    head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    ends = [*head[1:].tolist(), len(a)] if len(a) else []
    return a[head].tolist(), [slice(x, y) for x, y in zip(head.tolist(), ends, strict=True)]


def copies_of(order: list[int], data: list[bytes]) -> set[int]:
    """Rows whose text an earlier row of the part has."""
    seen: set[bytes] = set()
    out = set()
    for r in order:
        if data[r] in seen:
            out.add(r)
        seen.add(data[r])
    return out


def union(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in zip(starts, ends, strict=True):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _splitters(d: DataFrame, n: int, buckets: int, length: int, sample_rows: int = 2000) -> list[bytes]:
    """Leading bytes that cut the anchors of a sample of rows into even ranges. Bounded by the sample."""
    if not n:
        return []

    def leads(batches):
        for batch in batches:
            p = Part(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length)
            yield pa.RecordBatch.from_pydict({"lead": pa.array([p.buf[a : a + GRAM].tobytes() for a in p.anchor[:: max(1, len(p.anchor) // 20_000)].tolist()], pa.binary())})

    # rows without id are drawn by their text, not all or none of them
    draw = F.xxhash64(F.lit("split"), "id", F.when(F.col("id").isNull(), F.xxhash64("text")))
    some = d.select("id", "text").where(F.pmod(draw, F.lit(n)) < sample_rows)
    got = np.sort(np.array(some.mapInArrow(leads, "lead binary").toArrow()["lead"].to_pylist(), f"S{GRAM}"))
    return sorted({x.ljust(GRAM, b"\0") for x in got[[len(got) * i // buckets for i in range(1, buckets)]].tolist()}) if len(got) else []


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).withColumnRenamed("id", "doc_id")
