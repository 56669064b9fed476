"""Joins whose most frequent keys must not land in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with this part of all rows or more is heavy, so there are never more heavy keys than this.
HEAVY = 2000


def heavy_keys(counted: DataFrame, n: str, total: int) -> DataFrame:
    """The rows of counted (one a key) whose n is at least a HEAVY-th of the total of n: at most HEAVY rows."""
    return counted.where(F.col(n) * HEAVY >= total).limit(HEAVY)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, by: Column) -> DataFrame:
    """left with the columns of right (unique in keys) where their keys meet, else nulls.

    heavy: rows of right with keys that many rows of left have, a bounded number. Those rows get theirs by a broadcast and are
    dealt out by the hash ``by`` instead of by key; they are salted so that in the shuffled join they meet nothing.
    """
    values = [c for c in right.columns if c not in keys]
    h = heavy.select(*[F.col(c).alias(f"_h_{c}") for c in (*keys, *values)], F.lit(True).alias("_heavy"))
    met = left.join(F.broadcast(h), [F.col(k) == F.col(f"_h_{k}") for k in keys], "left")
    met = met.withColumn("_salt", F.when(F.col("_heavy"), by).otherwise(F.lit(0)).cast("long"))
    out = met.join(right.withColumn("_salt", F.lit(0).cast("long")), [*keys, "_salt"], "left")
    return out.select(*left.columns, *[F.when(F.col("_heavy"), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c) for c in values])
