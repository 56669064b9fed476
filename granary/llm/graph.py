"""Connected components by label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns (id, comp): the smallest id that each id reaches. Ids without edges are not listed.

    Each round takes the smallest label of the neighbours (a partial minimum, so a hub costs no list) and then the
    label of that label. The rounds grow with the logarithm of the longest path for the star-shaped links made here.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.select(F.col("a").alias("id"), "c"), "id").select("id", "comp", F.least("comp", "c").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("lower"))
        step = cut(step.join(jump, "low").select("id", F.col("comp").alias("old"), F.least("low", "lower").alias("comp")))
        labels = step.select("id", "comp")
        if step.where("old <> comp").isEmpty():
            return labels
