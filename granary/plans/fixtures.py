"""Inputs derived from the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import once

LATIN, NAGARI = "abcdefghijklmnopqrstuvwxyz", "कखगघङचछजझञटठडढणतथदधनपफबभमय"
MANUAL = ("src0", "src1", "src2", "src3", "src4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("source_type", F.when(F.col("source").isin(*MANUAL), "manual").otherwise("downloaded"))


def rank() -> list:
    """Manual documents first, then by source and id."""
    return [F.col("source_type") == "downloaded", F.col("source"), F.col("doc_id")]


def nagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents in Devanagari; of every seventh only odd lines."""
    full = F.translate(F.lower("text"), LATIN, NAGARI)
    odd = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.translate(F.lower(x), LATIN, NAGARI)).otherwise(x)), "\n")
    return once(documents(spark, sf_dir), "text", F.when(F.col("doc_id") % 7 == 0, odd).when(F.col("doc_id") % 3 != 0, full).otherwise(F.col("text")))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of eight kinds of noise put before every eighth document, and into its first space."""
    k = F.col("doc_id") % 8
    marks = ["‍", "“…”", "…", "।" * 4, "क़é", " " * 3, "\n\n\n\n", '\n{"k": 1}\n']
    mark = F.element_at(F.array(*[F.lit(m) for m in marks]), (k + 1).cast("int"))
    return documents(spark, sf_dir).withColumn("text", F.concat(F.left("text", F.lit(3)), mark, F.substring("text", 4, 1 << 30), F.lit("  \t"), mark))


# ---- the same in SQL
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NOT_WS}+'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


DOCS = "d AS (SELECT *, CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 'manual' ELSE 'downloaded' END AS source_type FROM documents)"
DV = f"""{DOCS}, dv AS (SELECT * REPLACE (CASE
  WHEN doc_id % 7 = 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 2 = 1 THEN translate(lower(x), '{LATIN}', '{NAGARI}') ELSE x END), chr(10))
  WHEN doc_id % 3 <> 0 THEN translate(lower(text), '{LATIN}', '{NAGARI}') ELSE text END AS text) FROM d)"""
NOISY = f"""{DOCS}, m AS (SELECT *, [chr(8205), chr(8220) || chr(8230) || chr(8221), chr(8230), repeat(chr(2404), 4), chr(2392) || 'e' || chr(769), repeat(chr(160), 3), repeat(chr(10), 4), chr(10) || '{{"k": 1}}' || chr(10)][doc_id % 8 + 1] AS mark FROM d),
noisy AS (SELECT * REPLACE (substr(text, 1, 3) || mark || substr(text, 4) || '  ' || chr(9) || mark AS text) FROM m)"""
PROSE = f"list_transform(string_split(text, chr(10)), lambda x: {n_words('x')})"
PROSE_WORDS = f"list_sum(list_concat([0], list_filter({PROSE}, lambda x: x >= 8)))::BIGINT"
PROSE_LINES = f"len(list_filter({PROSE}, lambda x: x >= 8))::BIGINT"
GOOD = f"({PROSE_LINES} >= 3 AND {PROSE_WORDS} >= 120)"
EXACT = "substr(sha1(text), 1, 16)"
PREFIX = f"substr(sha1(regexp_replace(substr(text, 1, 300), '{WS}', '', 'g')), 1, 16)"
RANK = "source_type = 'downloaded', source, doc_id"
STATUS = f"""{DOCS}, g AS (SELECT *, {EXACT} AS e, {PREFIX} AS p, {PROSE_WORDS} AS words FROM d WHERE {GOOD}),
s AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'kept' WHEN e = first_value(e) OVER w THEN 'removed_exact' ELSE 'removed_near' END AS status
      FROM g WINDOW w AS (PARTITION BY p ORDER BY {RANK}))"""
BUCKET = "CASE WHEN words < 200 THEN '<200' WHEN words < 400 THEN '<400' WHEN words < 800 THEN '<800' WHEN words < 1600 THEN '<1600' WHEN words < 3200 THEN '<3200' WHEN words < 6400 THEN '<6400' ELSE '>=6400' END"
SPLIT = "CASE WHEN pos < 0.96::DOUBLE THEN 'train' WHEN pos < 0.96::DOUBLE + 0.02::DOUBLE THEN 'validation' ELSE 'test' END"
POS = "('0x' || substr(sha1('1337:' || ident), 1, 8))::BIGINT / 4294967295.0::DOUBLE"
