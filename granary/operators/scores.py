"""Generation metrics: ROUGE-L, Distinct-n, repetition, BLEU, chrF."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import text as T


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays, a row of the table at a time."""

    def one(x, y) -> int:
        if x is None or y is None or not len(x) or not len(y):
            return 0
        codes: dict[str, int] = {}
        p, q = (np.array([codes.setdefault(w, len(codes)) for w in s]) for s in (x, y))
        row = np.zeros(len(q) + 1, np.int64)
        for c in p:
            hit = np.where(q == c, row[:-1] + 1, 0)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def rouge_l(pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """Adds lcs, precision, recall and f1 of the words."""
    d = pairs.withColumn("_h", T.words(F.col(hypothesis))).withColumn("_r", T.words(F.col(reference)))
    d = d.withColumn("lcs", lcs_length("_h", "_r"))
    p = F.coalesce(F.try_divide("lcs", F.size("_h")), F.lit(0.0))
    r = F.coalesce(F.try_divide("lcs", F.size("_r")), F.lit(0.0))
    return d.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).drop("_h", "_r")


def distinct_n(rows: DataFrame, text: str, n: int) -> DataFrame:
    w = rows.select(T.words(F.col(text)).alias("w"))
    g = w.select(F.explode(T.ngrams(F.col("w"), n)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.lit(n).alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.coalesce(F.count(F.lit(1)) / F.sum("c"), F.lit(0.0)).alias("ratio"))


def repetition(rows: DataFrame, text: str, n: int) -> DataFrame:
    """Mean share of repeated n-grams over the rows that have any."""
    w = rows.select(T.words(F.col(text)).alias("w")).where(F.size("w") >= n)
    g = w.select(T.ngrams(F.col("w"), n).alias("g"))
    return g.agg(F.lit(n).alias("n"), F.count(F.lit(1)).alias("rows"), F.avg(1 - F.size(F.array_distinct("g")) / F.size("g")).alias("rate"))


def intl_tokens(c: Column) -> Column:
    """Marks that no digit touches on both sides, and all symbols, stand alone; the rest is split at white space."""
    t = F.regexp_replace(c, r"(\P{N})(\p{P})", "$1 $2 ")
    t = F.regexp_replace(t, r"(\p{P})(\P{N})", " $1 $2")
    return T.words(F.regexp_replace(t, r"(\p{S})", " $1 "))


def chars(c: Column) -> Column:
    """The text without white space, whose characters are the tokens."""
    return F.regexp_replace(c, T.WS, "")


def clipped_matches(pairs: DataFrame, keys: list[str], hypothesis: Column, reference: Column, orders: range) -> DataFrame:
    """(n, matches, hyp, ref): n-gram counts of two arrays of tokens, or of two strings by character, each match at most as often as
    the reference has it. Pairs of equal keys count as one. n-grams are counted a key at a time and never leave their task; a fixed
    number of tasks, as few MB of text take long to count and the rows may come in parts by a coarser key (conversations)."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.select(*keys, F.struct(hypothesis.alias("h"), reference.alias("r")).alias("p")).repartition(parts, *keys).groupBy(*keys).agg(F.collect_list("p").alias("p"))

    def grams(texts: list, n: int) -> Counter:
        found: Counter = Counter()
        for t in texts:
            found.update(map("\x01".join, zip(*(t[i:] for i in range(n)), strict=False)) if n > 1 else t)
        return found

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = {n: [0, 0, 0] for n in orders}
            for key in batch.column(0):
                pairs = key.as_py()
                sides = [[p[side] for p in pairs if p[side]] for side in "hr"]
                for n, s in sums.items():
                    h, r = (grams(texts, n) for texts in sides)
                    s[0] += sum(min(c, r[g]) for g, c in h.items() if g in r)
                    s[1] += h.total()
                    s[2] += r.total()
            rows = [(n, *s) for n, s in sums.items() if s[1] or s[2]]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], pa.schema([("n", pa.int32()), *[(x, pa.int64()) for x in names[1:]]]))

    names = ("n", "matches", "hyp", "ref")
    counts = both.select("p").mapInArrow(count, "n int, matches long, hyp long, ref long")
    return counts.groupBy("n").agg(*[F.sum(x).alias(x) for x in names[1:]])


def bleu(counts: list, top: int = 4) -> float:
    """counts: rows of (n, matches, hyp, ref) for n = 1..top. Orders without a match are smoothed exponentially."""
    by = {r["n"]: r for r in counts}
    hyp, ref = by[1]["hyp"], by[1]["ref"]
    logs, smooth = 0.0, 1.0
    for n in range(1, top + 1):
        total = by[n]["hyp"] if n in by else 0
        if not total:
            return 0.0
        if by[n]["matches"]:
            p = by[n]["matches"] / total
        else:
            smooth *= 2
            p = 1 / (smooth * total)
        logs += np.log(p) / top
    return float(100 * min(1.0, np.exp(1 - ref / hyp)) * np.exp(logs))


def chrf(counts: list, beta: float = 2.0) -> float:
    """Precision and recall averaged over the orders that both sides have, as F-beta."""
    p = [r["matches"] / r["hyp"] for r in counts if r["hyp"] and r["ref"]]
    q = [r["matches"] / r["ref"] for r in counts if r["hyp"] and r["ref"]]
    if not p or not sum(p) + sum(q):
        return 0.0
    a, b = sum(p) / len(p), sum(q) / len(q)
    return float(100 * (1 + beta**2) * a * b / (beta**2 * a + b)) if a + b else 0.0


def paired(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Predictions with their references, one to one; if either side lacks a row of the other, reading the result is an error."""
    both = predictions.withColumn("_p", F.lit(True)).join(references.withColumn("_r", F.lit(True)), key, "full")
    one = F.when(F.col("_p") & F.col("_r"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no counterpart of "), F.col(key).cast("string"))).cast("boolean"))
    return both.withColumn("_p", one).where("_p").drop("_p", "_r")


def generation_means(pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """Means over the corpus: words of both sides and ROUGE-L."""
    d = rouge_l(pairs, hypothesis, reference)
    return d.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(T.word_count(F.col(hypothesis))).alias("mean_words"), F.avg(T.word_count(F.col(reference))).alias("mean_reference_words"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("rouge_l"),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share: where the answer begins in an encoded prompt with its answer."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    n = F.least(F.size(a), F.size(b))
    return F.coalesce(F.nullif(F.array_position(F.slice(same, F.lit(1), F.greatest(n, F.lit(0))), F.lit(False)), F.lit(0)) - 1, n).cast("long")
