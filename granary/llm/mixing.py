"""Mixing sources to target weights by Sainte-Laguë apportionment [native].

1. Sizes (words) are summed by source; weights fill a total of ``share`` times all sizes like water: a source is
   full at ``limit`` times its size, and what it can't take is shared again by weight among the others.
2. The total is cut into equal blocks of ``block`` words. Blocks go to the highest quotients target / (2 k + 1);
   only quotients near the last winning one are made (three a source on average), the sure ones are counted by formula.
3. A source's blocks go on to its shards (about ``shard_words`` words each, dealt by a seeded hash) in the same way.
4. In a shard, documents lie in a seeded order as one line of words; whole rounds of the line are taken first, then
   its leading blocks, up to the quota. A document's taken words are its overlap with that.

A hot source only has more shards; the one ranking over all sources has three rows a source, not a document.
Defined results: null or empty texts have size 0 and take 0; null sources form the last source; an empty table
gives an empty result. Repeated rows are dealt like any other rows. Ties of quotients go by shard, then by source.
Same input and seed, same result: nothing depends on the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, table

WEIGHTS = (3, 1, 2)


def seeded(id_col: str, seed: str) -> Column:
    """60 bits that depend on the seed and the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_filled(sources: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """sources: (source, source_size). Adds weight and target. One row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    # sources fill up in the order of cap / weight; before each, what is left goes by weight to those not yet full
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("heavy", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # filling one more source raises the level while its cap lies under it and lowers it from then on: the highest holds
    s = s.withColumn("level", F.max(F.col("left") / F.col("heavy")).over(every))
    return s.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap")).select("source", "source_size", "weight", "target")


def sainte_lague(votes: DataFrame, seats: Column, within: list[str], name: str, votes_col: str) -> DataFrame:
    """Adds quota: seats dealt by the highest quotients votes / (2 k + 1) within each group. name orders ties."""
    group = Window.partitionBy(*within)
    v = votes.withColumn("_seats", seats).withColumn("_all", F.sum(votes_col).over(group).cast("double")).withColumn("_n", F.count(F.lit(1)).over(group))
    per = F.when(F.col("_all") > 0, F.col(votes_col) / F.col("_all")).otherwise(0.0)
    # seats = round(votes / d) for some d, and |sum of votes / d - seats| <= n / 2: this encloses every quota
    v = v.withColumn("_sure", F.greatest(F.lit(0), F.floor(per * (F.col("_seats") - F.col("_n") / 2) - 0.5)).cast("long"))
    v = v.withColumn("_most", F.ceil(per * (F.col("_seats") + F.col("_n") / 2) + 0.5).cast("long"))
    v = v.withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    tried = v.withColumn("_k", F.explode(F.sequence("_sure", "_most")))
    order = Window.partitionBy(*within).orderBy((F.col(votes_col) / (2 * F.col("_k") + 1)).desc(), "_k", F.col(name).isNull(), name)
    won = (F.row_number().over(order) <= F.col("_open")) & (F.col(votes_col) > 0)
    tried = tried.withColumn("_won", F.when(won, 1).otherwise(0))
    kept = [c for c in votes.columns if c not in (*within, name)]
    return tried.groupBy(*within, name).agg(*[F.first(c).alias(c) for c in kept], (F.first("_sure") + F.sum("_won")).alias("quota"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5, limit: float = 2.0, block: int = 64, shard_words: int = 1 << 18, seed: str = "mix-1",
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, size, source, source_size, target, taken). taken: the words that the mix takes, repeats counted, up to limit * size.

    keep: the columns of row, all by default; without the text among them no text is shuffled.
    """
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("_id"),
    )
    d = d.withColumn("_at", seeded("_id", seed))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_filled(sizes, weights, share, limit)
    total = F.sum("target").over(Window.partitionBy())
    quotas = sainte_lague(targets.withColumn("_all", F.lit(1)), F.round(total / block).cast("long"), [], "source", "target")
    quotas = quotas.select("source", "source_size", "target", F.col("quota").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"))
    d = d.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source"))).select("d.*", "source_size", "target", "source_quota", "shards")
    d = d.withColumn("shard", F.pmod(F.col("_at"), F.col("shards")))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, F.col("source_quota"), ["source"], "shard", "shard_size")
    d = d.alias("d").join(
        shards.select(F.col("source").alias("s1"), F.col("shard").alias("s2"), "shard_size", "quota").alias("s"),
        F.col("d.source").eqNullSafe(F.col("s1")) & (F.col("d.shard") == F.col("s2")),
    )
    line = Window.partitionBy("source", "shard").orderBy(F.floor(F.col("_at") / F.col("shards")), "_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    want = F.least((F.col("quota") * block).cast("long"), F.floor(F.col("shard_size") * F.lit(float(limit))))
    rounds = F.when(F.col("shard_size") > 0, F.floor(want / F.col("shard_size"))).otherwise(0).cast("long")
    d = d.withColumn("_rounds", rounds).withColumn("_rest", want - rounds * F.col("shard_size")).withColumn("_end", F.sum("size").over(line))
    lead = F.greatest(F.lit(0), F.least("size", F.col("_rest") - (F.col("_end") - F.col("size"))))
    return d.select("row", "size", "source", "source_size", "target", (F.col("_rounds") * F.col("size") + lead).cast("long").alias("taken"))


def mixed(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The mix as documents with their own columns: a row for each time a document is taken, rounded to whole documents."""
    m = mix(docs, text_col=text_col, **how)
    times = F.when(F.col("size") > 0, F.bround(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    m = m.withColumn("_times", times).where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return m.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS spot FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS heavy
  FROM s1 WINDOW f AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(lft / heavy) OVER () AS level FROM s2),
s4 AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM s3),
s5 AS (SELECT *, round(sum(target) OVER () / 64)::BIGINT AS seats, ceil(target / 64 + 12)::BIGINT AS most FROM s4),
b1 AS (
  SELECT source, k, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, k, source IS NULL, source) AS n
  FROM (SELECT *, unnest(generate_series(0, most)) AS k FROM s5 WHERE target > 0)),
q1 AS (SELECT source, count(*)::BIGINT AS quota FROM b1 WHERE n <= seats GROUP BY source),
s6 AS (
  SELECT s4.*, coalesce(quota, 0) AS source_quota, greatest(1, ceil(source_size / 262144))::BIGINT AS shards
  FROM s4 LEFT JOIN q1 ON s4.source IS NOT DISTINCT FROM q1.source),
e AS (SELECT d.*, s6.source_size, s6.target, source_quota, shards, spot % shards AS shard FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
h0 AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS source_quota, any_value(source_size) AS source_size FROM e GROUP BY source, shard),
b2 AS (
  SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, k, shard) AS n
  FROM (SELECT *, unnest(generate_series(0, ceil(source_quota * shard_size / source_size)::BIGINT + 8)) AS k FROM h0 WHERE shard_size > 0)),
q2 AS (SELECT source, shard, count(*)::BIGINT AS quota FROM b2 WHERE n <= source_quota GROUP BY source, shard),
g AS (
  SELECT e.*, shard_size, least(coalesce(quota, 0) * 64, shard_size * 2)::BIGINT AS want
  FROM e JOIN h0 ON e.source IS NOT DISTINCT FROM h0.source AND e.shard = h0.shard
  LEFT JOIN q2 ON e.source IS NOT DISTINCT FROM q2.source AND e.shard = q2.shard),
w AS (
  SELECT *, CASE WHEN shard_size > 0 THEN want // shard_size ELSE 0 END AS rounds,
         sum(size) OVER (PARTITION BY source, shard ORDER BY spot // shards, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM g)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(size, want - rounds * shard_size - (upto - size))))::BIGINT AS taken
FROM w
"""
