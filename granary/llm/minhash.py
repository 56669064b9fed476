"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

A set's elements go through one permutation of 64 bits into a circle of 2^20 places; a second permutation pi stands on the
circle. Coordinate k of the signature is the least pi over the set, with pi shifted by k: the k-th values of
an element are one contiguous slice of pi, so all coordinates come from one gather and one minimum.

Equal sets are one class first (grouped by 128 bits of the set, a partial minimum of ids, so thousands of copies cost
one row), numbered after they are written down. Signatures' bands are keys only of classes. Candidates under a key are never paired all with all:

1. Shingles that no other candidate has lie in no common part; sets with too many of them can't be similar enough to
   any set under the key, or to larger ones. That rules out most outliers of a large group before any comparison.
2. Every class meets one pivot of its key, the one with the fewest lone shingles, so keys of one group share a
   pivot and the pairs are few. Verified links are joined to components.
3. Under pivots whose classes are still in several components, classes outside the largest are compared with those of the
   others, less the pairs already compared and those that sizes, lone shingles or the differences to the pivot rule out:
   a linked pair must share some of the rarest shingles in which each differs from the pivot, so only classes
   with such a difference in common meet. Links inside one component are skipped; they change nothing.

With bands x rows = 42 x 6 a pair of similarity 0.8 shares no key with probability 3e-6, one of 0.85 with 2e-9.

Defined results: a set without words is linked with nothing. Rows with one id are one node: where their texts differ, what
either is linked with belongs to one component, and each row has its own n_shingles (distinct shingles). A null id links nothing,
gives a null component and the row is kept. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import heavy_keys, spread_join
from .common import cut, shuffle_parts, table, tidy
from .graph import components
from .lm import ranges
from .shingles import WordHashes, mixed, shingle_set, word_hashes

BANDS, ROWS, PLACES = 42, 6, 1 << 20


@functools.cache
def circle(width: int) -> np.ndarray:
    """Every place's width values of the permutation, as overlapping slices of one array."""
    pi = np.argsort(mixed(np.arange(PLACES, dtype=np.uint64) + np.uint64(0xA5A5)), kind="stable").astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: width - 1]]), width)


def signature(s: np.ndarray, width: int) -> np.ndarray:
    places = (mixed(s ^ np.uint64(0x5DEECE66D1234567)) >> np.uint64(44)).astype(np.int64)
    slices, least = circle(width), None
    for lo in range(0, len(places), 2048):
        part = slices[places[lo : lo + 2048]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; bands differ in their keys."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for col in sig.reshape(bands, rows).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + col.astype(np.uint64))
    return out.view(np.int64)


def sets(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int, whole: bool = False) -> DataFrame:
    """(id, n_shingles, set_a, set_b, keys) or, whole, (id, set_a, set_b, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [shingle_set(word_hashes(x, known), n) for x in part.column(1).to_pylist()]
                both = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in found]
                sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
                of = {"set_a": pa.array([sign(x >> 64) for x in both], pa.int64()), "set_b": pa.array([sign(x & (1 << 64) - 1) for x in both], pa.int64())}
                if whole:
                    yield pa.RecordBatch.from_pydict({"id": part.column(0), **of, "shingles": pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))})
                    continue
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0), "n_shingles": pa.array([len(s) for s in found], pa.int64()), **of,
                    "keys": pa.array([band_keys(signature(s, bands * rows), bands, rows) if len(s) else None for s in found], pa.list_(pa.int64())),
                })

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, " + ("set_a long, set_b long, shingles array<long>" if whole else "n_shingles long, set_a long, set_b long, keys array<long>")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(lambda batches: tidy(run(batches)), schema)


def _verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b), compared exactly: (a, b, linked)."""
    left = shingles.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("i")
    return both.select("a", "b", (100 * F.col("i") >= percent * union).alias("linked"))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def class_links(cand: DataFrame, sizes: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """cand: (key, id) of classes under keys that several share. Returns (a, b): links that join all linked ones."""
    # a common part holds none of a set's lone shingles, so no set larger than most can be similar enough to it
    most = F.floor(F.lit(100 + percent) * (F.col("n") - F.col("lone")) / percent - F.col("n") + 1e-6)
    facts = sizes.select("id", F.col("n_shingles").alias("n")).join(lone_shingles(shingles), "id").withColumn("most", most)
    state = cand.select("key", "id").join(facts, "id")
    least = state.groupBy("key").agg(F.min("n").alias("least"))
    state = cut(state.join(least, "key").where("most >= least").select("key", "id", "n", "lone", "most"))

    def possible(x: str, y: str) -> Column:
        n, m = F.col(f"n{x}"), F.col(f"n{y}")
        return (n <= F.col(f"most{y}")) & (m <= F.col(f"most{x}")) & (100 * F.least(n, m) >= percent * F.greatest(n, m))

    pivot = F.min_by(F.struct(F.col("id").alias("pivot"), F.col("n").alias("n1"), F.col("most").alias("most1")), F.struct("lone", "id"))
    first = cut(state.groupBy("key").agg(pivot.alias("p")).select("key", "p.*"))
    meets = state.join(first, "key").where((F.col("id") != F.col("pivot")) & possible("", "1"))
    tried = cut(_verified(meets.select(*_ordered(F.col("id"), F.col("pivot"))).distinct(), shingles, percent))
    links = tried.where("linked")
    comps = components(links)
    state = state.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    members = state.join(first.select("key", "pivot"), "key").select("pivot", "id", "n", "most", "comp").distinct()
    rest = cut(unmet_pairs(members, shingles, possible, percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    new = cut(_verified(rest, shingles, percent).where("linked"))
    return links.select("a", "b").union(new.select("a", "b"))


def unmet_pairs(members: DataFrame, shingles: DataFrame, possible: Callable[[str, str], Column], percent: int) -> DataFrame:
    """members: (pivot, id, n, most, comp). Pairs (a, b) under one pivot, in two components, that may still be linked.

    A member's delta is its symmetric difference with the pivot. Two sets of n1 + n2 shingles are linked when they differ in
    at most f * (n1 + n2), and they differ in d1 + d2 less twice what their deltas share. One of the two isn't linked with
    the pivot, so its delta is larger than f * (n + n0): a linked pair's deltas share at least ``need`` shingles, and
    each has one of them among its d - need + 1 rarest. Shingles that stand in one delta only come first and meet nothing.
    """
    f = (100 - percent) / (100 + percent)
    counts = members.groupBy("pivot", "comp").agg(F.count(F.lit(1)).alias("c"), F.max(F.when(F.col("id") == F.col("pivot"), F.col("n"))).alias("n0"))
    home = F.max(F.when(F.col("n0").isNotNull(), F.col("comp"))).alias("home")
    facts = counts.groupBy("pivot").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), home, F.max("n0").alias("n0"), F.count(F.lit(1)).alias("comps"))
    far = members.where("id <> pivot").join(facts.where("comps > 1").drop("comps"), "pivot")
    far = far.join(shingles.select("id", "shingles"), "id").join(shingles.select(F.col("id").alias("pivot"), F.col("shingles").alias("own")), "pivot")
    far = far.withColumn("delta", F.concat(F.array_except("shingles", "own"), F.array_except("own", "shingles"))).withColumn("d", F.size("delta"))
    need = F.when(F.col("comp") == F.col("home"), F.col("d") + f * (F.col("n0") - F.col("n"))).otherwise(F.col("d") - f * (F.col("n") + F.col("n0")))
    need = F.greatest(F.lit(1), F.ceil(need / 2 - 1e-6))
    far = cut(far.select("pivot", "id", "n", "most", "comp", "largest", "d", (F.col("d") - need + 1).alias("first"), "delta").where("first > 0"))
    each = far.select("pivot", "id", "first", F.explode("delta").alias("shingle"))
    often = each.groupBy("pivot", "shingle").count()
    rank = F.row_number().over(Window.partitionBy("pivot", "id").orderBy("count", "shingle"))
    rare = each.join(often, ["pivot", "shingle"]).withColumn("rank", rank).where("rank <= first and count > 1").select("pivot", "id", "shingle", "rank")
    rare = cut(rare.join(far.drop("delta", "first"), ["pivot", "id"]))
    outside = rare.where("comp <> largest").select(*[F.col(c).alias(f"{c}1") for c in ("pivot", "shingle", "id", "comp", "n", "most", "d", "rank")])
    # from the rarest shingle that both deltas have, each must still hold what the pair needs in common
    near = (F.col("d") + F.col("d1") - f * (F.col("n") + F.col("n1"))) / 2 - 1e-6 <= 1 + F.least(F.col("d") - F.col("rank"), F.col("d1") - F.col("rank1"))
    meet = (F.col("pivot1") == F.col("pivot")) & (F.col("shingle1") == F.col("shingle")) & (F.col("comp") != F.col("comp1"))
    return outside.join(rare, meet & possible("", "1") & near).select(*_ordered(F.col("id"), F.col("id1"))).distinct()


def lone_shingles(shingles: DataFrame) -> DataFrame:
    """(id, lone): how many shingles of a set no other set has. Parts of sets ask ranges of hashes for what others have."""
    buckets = shuffle_parts(shingles.sparkSession)
    d = shingles.select("id", "shingles", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("part"))

    def flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        each = [np.asarray(x, np.int64).view(np.uint64) for x in rows["shingles"].to_numpy(zero_copy_only=False)]
        return np.concatenate([*each, np.zeros(0, np.uint64)]), np.array([len(x) for x in each], np.int64)

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        u = np.unique(flat(rows)[0])
        at = np.searchsorted(ranges(u, buckets), np.arange(buckets + 1))
        return pa.table({"bucket": pa.array(range(buckets), pa.int32()), "part": pa.array([key[0].as_py()] * buckets, pa.int32()), "has": pa.array([u[at[b] : at[b + 1]].tobytes() for b in range(buckets)], pa.binary())})

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        has = [np.frombuffer(x, "<u8") for x in rows["has"].to_pylist()]
        u, n = np.unique(np.concatenate(has), return_counts=True)
        return pa.table({"part": rows["part"], "shared": pa.array([x[np.isin(x, u[n > 1], assume_unique=True)].tobytes() for x in has], pa.binary())})

    def finish(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        h, sizes = flat(rows)
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        lone = (n[back] == 1) & ~np.isin(h, np.frombuffer(b"".join(answers["shared"].to_pylist()), "<u8"))
        sums = np.r_[0, np.cumsum(lone)]
        ends = np.cumsum(sizes)
        return pa.table({"id": rows["id"], "lone": pa.array(sums[ends] - sums[ends - sizes], pa.int64())})

    answers = d.groupBy("part").applyInArrow(ask, "bucket int, part int, has binary").groupBy("bucket").applyInArrow(answer, "part int, shared binary")
    kind = dict(d.dtypes)["id"]
    return d.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda k, x, y: finish(k, x, y), f"id {kind}, lone long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked by a Jaccard similarity of percent / 100 or more."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = cut(sets(docs, "id", "text", n, bands, rows))
    full = found.where("id is not null and n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    keyed = classes.select(F.col("node").alias("id"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    cand = cut(keyed.join(shared, "key"))
    names = classes.select("node", "rep", "set_a", "set_b")
    wanted = names.join(cand.select(F.col("id").alias("node")).distinct(), "node")
    # a row of the class's own set: rows of one id may differ in text
    texts = docs.join(wanted.select(F.col("rep").alias("id")).distinct(), "id")
    shingles = sets(texts, "id", "text", n, bands, rows, whole=True).join(wanted.select("node", "set_a", "set_b"), ["set_a", "set_b"])
    shingles = cut(shingles.dropDuplicates(["node"]).select(F.col("node").alias("id"), "shingles"))
    links = class_links(cand, classes.select(F.col("node").alias("id"), "n_shingles"), shingles, percent)
    comps = components(links.union(_same_id(full, names)))
    least = comps.join(names.select(F.col("node").alias("id"), "rep"), "id")
    least = least.join(least.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select(F.col("id").alias("node"), "least")
    by_class = classes.select("node", "set_a", "set_b", "rep", "copies").join(least, "node", "left").select("set_a", "set_b", "copies", F.coalesce("least", "rep").alias("comp"))
    rows_of = found.select("id", "n_shingles", "set_a", "set_b")
    heavy = heavy_keys(by_class, "copies", full.count())
    out = spread_join(rows_of, by_class, ["set_a", "set_b"], heavy, F.xxhash64("id"))
    comp = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("comp"))).otherwise(F.col("id"))
    return out.select("id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _same_id(full: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b): links between the classes of rows that share an id but not a set."""
    several = full.groupBy("id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).where("lo <> hi").select("id")
    of = cut(full.select("id", "set_a", "set_b").join(several, "id").join(names.select("node", "set_a", "set_b"), ["set_a", "set_b"]).select("id", "node").distinct())
    return of.join(of.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a <> b")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4).withColumnRenamed("id", "doc_id")
