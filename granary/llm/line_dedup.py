"""Line dedup [native]: lines whose key stands in too many documents go from every document.

Lines are exploded, their normalised keys hashed to 128 bits (two independently seeded 64-bit hashes), the documents
of each hash counted (once a document, so a plain partial count), and the hashes over the threshold joined back to the
exploded (row, position, hash). Only the positions to drop go to a document's own row, where the rest is put together
again in order. Frequent keys are pre-aggregated before the shuffle, and what meets at one key is a count, never a list.
In the join back, keys that hold a ``HEAVY``-th of all lines over the threshold or more (at most ``HEAVY`` keys) are
broadcast, and their lines are dealt out by row instead of by key: no key brings more than that share to one task.

Defined results: null or empty text is one empty line; a key shorter than ``min_chars`` is never dropped; a
document that loses all lines gets the empty text (null text stays null when nothing is dropped). Every input row
counts as a document, repeated rows too, and rows may share or lack an id. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from .common import BLANKS, ascii_lower, cut, table


def line_keys(text: Column) -> Column:
    """The keys of all lines: ends stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))


def _hash(k: Column) -> Column:
    return F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("2"), k).alias("b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(row, kept, n_lines, n_dropped): row is the input row as a struct, kept its text without the dropped lines."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col(f"row.`{id_col}`").alias("k1"), F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("t")
    )
    base = base.withColumn("k2", F.xxhash64("t"))
    lines = base.select("k1", "k2", line_keys(F.col("t")).alias("keys"))
    hashes = F.transform("keys", lambda k: F.when(F.char_length(k) >= min_chars, _hash(k)))
    counts = (
        lines.select(F.explode(F.array_distinct(hashes)).alias("h")).where("h is not null")
        .groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count(F.lit(1)).alias("n_docs"))
    )
    hot = cut(counts.where(F.col("n_docs") >= min_docs))
    total = hot.agg(F.sum("n_docs")).first()[0] or 0
    at = lines.select("k1", "k2", F.posexplode(hashes).alias("pos", "h")).where("h is not null").select("k1", "k2", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    met = spread_join(at, hot, ["a", "b"], heavy_keys(hot, "n_docs", total), F.xxhash64("k1", "k2", "pos")).where("n_docs is not null")
    drops = met.groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"))
    drops = drops.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), "drop")
    joined = base.join(drops, F.col("k1").eqNullSafe(F.col("d1")) & (F.col("k2") == F.col("d2")), "left")
    split = F.split("t", "\n")
    # array_except hashes, so a text of very many lines stays linear
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return joined.select(
        "row", kept.alias("kept"), F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.col("drop").isNull().alias("intact"),
    )


def without_lines(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents with their own columns and the shortened text; those left without any text go."""
    out = dedup_lines(docs, text_col=text_col, **how)
    text = F.when(F.col("intact"), F.col(f"row.`{text_col}`")).otherwise(F.col("kept"))
    out = out.where(F.col("intact") | (F.col("kept") != ""))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS dropped FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
