"""The cleaning chain as one plan: normalise, line filters, quality gate, language gate, dedup by source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import boilerplate, dedup, langid
from .lineage import cut

REASONS = ("kept", "removed_quality", "removed_language", "removed_exact", "removed_near")


def filtered(docs: DataFrame, least: int = 10, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with text normalised and without foreign lines and lines that occur ``least`` times or more; adds foreign_lines and
    boilerplate_lines, what the two filters dropped. Written once, as the lines are counted and dropped in two readings."""
    d = docs.withColumn("_n", T.normalize(F.col(text))).withColumn(text, T.drop_foreign_lines(F.col("_n")))
    d = cut(d.withColumn("foreign_lines", T.lines_dropped(F.col("_n"), F.col(text)).cast("long")).drop("_n"))
    hot = boilerplate.hash_counts(d, text).where(F.col("n") >= least)
    return boilerplate.drop_lines(d, hot, ident, text).withColumn(text, F.col("kept")).withColumnRenamed("dropped", "boilerplate_lines").drop("kept")


def outcomes(docs: DataFrame, model: DataFrame, target: str, order: list[Column], confidence: float = 0.5, near: bool = True) -> DataFrame:
    """docs: filtered() with its columns, doc_id and source_type. One row a document with its words, predicted language and
    status, one of REASONS; texts are measured and scored where they are read and stay behind.

    A document fails at the first gate that it doesn't pass; only those behind both gates take part in dedup.
    """
    t = F.col("text")
    keep = [c for c in docs.columns if c not in ("text", "lang")]
    row = F.struct(*keep, T.good_document(t).alias("good"), T.prose_words(t).alias("words"), T.content_hash(t).alias("exact"), T.prefix_hash(t).alias("prefix"))
    d = langid.predict(docs.select(row.alias("row"), "text"), model, ident="row").select("row.*", "predicted", "confidence")
    d = cut(d)
    passed = F.col("good") & (F.col("predicted") == target) & (F.col("confidence") >= confidence)
    inside = dedup.dedup_status(d.where(passed), F.col("exact"), F.col("prefix"), order, near)
    reason = F.when(F.col("good"), "removed_language").otherwise("removed_quality")
    return inside.unionByName(d.where(~passed).withColumn("status", reason))
