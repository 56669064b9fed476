"""First-seen-wins dedup by exact text and by prefix, as one window over the prefix hash.

Only a kept row enters the set of seen hashes, so of each prefix the first row is kept, later rows of the same text
are exact copies and all others near copies. Without near dedup the window runs over the exact hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import exclusive_sum


def dedup_status(docs: DataFrame, exact: Column, prefix: Column, order: list[Column], near: bool = True) -> DataFrame:
    """Adds status: kept, removed_exact or removed_near. Only hashes and the order keys need to be in docs."""
    d = docs.withColumn("_e", exact).withColumn("_p", prefix if near else exact)
    w = Window.partitionBy("_p").orderBy(*order)
    first = F.first("_e").over(w)
    status = F.when(F.row_number().over(w) == 1, "kept").when(F.col("_e") == first, "removed_exact").otherwise("removed_near")
    return d.withColumn("status", status).drop("_e", "_p")


def budget_cut(docs: DataFrame, words: str, major: list[str], minor: str, total: int) -> DataFrame:
    """Rows in order of major (source priority first) and minor until the budget is spent; the row that crosses it is kept."""
    return exclusive_sum(docs, words, major, minor, "_before").where(F.col("_before") < total).drop("_before")
