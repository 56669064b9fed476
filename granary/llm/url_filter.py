"""URL filters by a sort-merge range join over reversed-host canonical keys [native].

``www.example.net`` becomes the key ``net.example.www.``; a rule's host and all its subdomains are then one
interval ``[net.example., net.example/)``, and the intervals of all rules are nested or disjoint. The ends of the
intervals, each with the stack of rules that are active from there on, are merged with the urls' keys in one sort;
a running ``last`` over that order is the sweep. Paths are compared with the few rules on the stack.

Sweeps run by (top label, salt): nesting never leaves a top label, and the salt splits a top label or host that
holds a large share of the rows. The ends are repeated once for each salt, which is a bound in the rules, not the urls.

Defined results: a null url, one without ``://`` or an empty host fits no rule. Rules without host are ignored.
Of several fitting rules the longest (host and path) wins; equal ones: block before allow. Repeated urls are judged
one by one. Other columns of the input, whatever their names, are kept untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, shuffle_parts

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the top down, each closed by a point."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): where an interval begins or ends, and the rules that are active from there on."""
    r = rules.where(F.length("host") > 0).select(
        host_key(ascii_lower(F.col("host"))).alias("k"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.col("verdict"), F.col("path"), F.concat("host", "path").alias("rule")
        ).alias("r"),
    )
    own = r.groupBy("k").agg(F.collect_set("r").alias("own"))
    # the ancestors of a key are its own prefixes of whole labels, so nesting is found by an equi-join
    labels = F.split(F.expr("substring(k, 1, length(k) - 1)"), r"\.")
    up = own.select("k", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("depth", "anc"))
    stacks = up.join(own.select(F.col("k").alias("anc"), "own"), "anc").groupBy("k").agg(
        F.flatten(F.collect_list("own")).alias("at_start"),
        F.flatten(F.collect_list(F.when(F.col("anc") != F.col("k"), F.col("own")))).alias("at_end"),
    )
    return stacks.select(
        F.inline(
            F.array(
                F.struct(F.col("k").alias("key"), F.col("at_start").alias("stack")),
                F.struct(F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/")).alias("key"), F.col("at_end").alias("stack")),
            )
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """(row, host, path, rule, verdict): row is the input row as a struct."""
    salts = salts or shuffle_parts(pages.sparkSession)
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")).select(
        "row", url_host(F.col(f"row.`{url_col}`")).alias("host"), url_path(F.col(f"row.`{url_col}`")).alias("path")
    )
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    ends = rule_stacks(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    merged = urls.unionByName(ends, allowMissingColumns=True).withColumn("top", F.regexp_extract("key", "^[^./]*", 0))
    sweep = Window.partitionBy("top", "salt").orderBy("key", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = merged.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("row is not null")
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


SQL = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, rverdict DESC) AS n
  FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE n = 1
"""
