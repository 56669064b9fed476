"""Running sums over a total order without one global partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exclusive_sum(df: DataFrame, value: str, major: list[str], minor: str, name: str, step: int = 4096) -> DataFrame:
    """Adds the sum of value over all rows before, in the order of major, then the integer minor.

    Rows fall into blocks of step consecutive values of minor; only one sum a block takes part in the global order, and
    within a block the window is local. A hot major key is thus many blocks.
    """
    d = df.withColumn("_block", F.floor(F.col(minor) / step))
    sums = d.groupBy(*major, "_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy(*major, "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*major, "_block"])], before.alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*major, "_block").orderBy(minor).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*major, "_block"])]
    out = d.withColumn("_inner", inner).join(sums, on).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long"))
    return out.select(*df.columns, name)
