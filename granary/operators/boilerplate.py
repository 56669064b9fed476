"""Repeated lines: counted by hash over the corpus, and taken out of documents."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut
from .skew import heavy_keys, spread_join


def line_counts(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(hash, n, line): occurrences of each stripped non-empty line; line is the first seen. Counts combine before the shuffle."""
    each = docs.select(order, F.posexplode(T.lines(F.col(text))).alias("pos", "raw")).select(order, "pos", T.strip(F.col("raw")).alias("line")).where("line <> ''")
    return each.groupBy(T.line_hash(F.col("line")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min_by("line", F.struct(order, "pos")).alias("line"))


#: Distinct lines that are counted at a time: some tens of MB. Then the counts so far are given out.
LINES_AT_ONCE = 200_000


def hash_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, n): line_counts() without the line, counted where texts are read; only counts are shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([h.hex() for h in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["hash", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                seen.update(hashlib.sha1(x.encode()).digest()[:6] for x in map(str.strip, (t.as_py() or "").split("\n")) if x)
                if len(seen) >= LINES_AT_ONCE:
                    yield given()
        yield given()

    return docs.select(text).mapInArrow(count, "hash string, n long").groupBy("hash").agg(F.sum("n").alias("n"))


#: Listed hashes up to which they are broadcast: some tens of MB a worker.
BROADCAST_HASHES = 500_000


def drop_lines(docs: DataFrame, hashes: DataFrame, ident: str = "doc_id", text: str = "text", most: int = BROADCAST_HASHES) -> DataFrame:
    """Adds kept (text without the lines whose hash is listed) and dropped. hashes: (hash, n).

    At most ``most`` hashes are broadcast, and lines are dropped where texts are read, without a shuffle; longer lists are joined,
    with the same results.
    """
    listed = cut(hashes.select("hash", "n"))
    found = listed.select("hash").limit(most + 1).toArrow()
    if found.num_rows > most:
        return drop_by_join(docs, listed, ident, text)
    sent = docs.sparkSession.sparkContext.broadcast(found["hash"].to_pylist())

    @F.pandas_udf("kept string, dropped long")
    def drop(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hot = set(sent.value)
        for texts in batches:
            kept, dropped = [], []
            for t in texts:
                parts = [] if t is None else t.split("\n")
                stay = [x for x in parts if not (s := x.strip()) or hashlib.sha1(s.encode()).hexdigest()[:12] not in hot]
                kept.append(None if t is None else "\n".join(stay))
                dropped.append(len(parts) - len(stay))
            yield pd.DataFrame({"kept": pd.Series(kept, dtype=object), "dropped": pd.Series(dropped, dtype="int64")})

    return docs.withColumn("_d", drop(F.col(text))).select(*docs.columns, "_d.kept", "_d.dropped")


def drop_by_join(docs: DataFrame, listed: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """drop_lines() for lists of any length. Only positions to drop are joined back. The lines of those that make up a large part of
    all are dealt out by row, so none fills one task."""
    at = docs.select(ident, F.posexplode(T.lines(F.col(text))).alias("pos", "raw")).select(ident, "pos", T.strip(F.col("raw")).alias("line")).where("line <> ''")
    total = listed.agg(F.sum("n")).first()[0] or 0
    met = spread_join(at.select(ident, "pos", T.line_hash(F.col("line")).alias("hash")), listed, ["hash"], heavy_keys(listed, "n", total), F.xxhash64(ident, "pos"))
    drops = met.where("n is not null").groupBy(ident).agg(F.collect_set("pos").alias("_drop"))
    d = docs.join(drops, ident, "left")
    parts = T.lines(F.col(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return d.withColumn("kept", kept).withColumn("dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long")).drop("_drop")
