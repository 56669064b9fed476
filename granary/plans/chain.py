"""Queries of the whole cleaning chain: every removal reason, line counters, keep rates and languages behind the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chain, langid
from . import fixtures as X
from .cleaning import _LATIN, _NORMAL
from .evaluation import _LANG
from .registry import query

_FOREIGN = f"({X.n_words('x')} >= 4 AND {_LATIN} > 0.8)"
_SCORED = _LANG.replace("FROM documents)", "FROM (SELECT doc_id * 2 AS doc_id, lang, text FROM dv WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id * 2 + 1, lang, text FROM x))", 1)
_CHAIN = f"""{X.DV}, n AS (SELECT doc_id, source, source_type, lang, {_NORMAL} AS text FROM dv),
f AS (SELECT * REPLACE (array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {_FOREIGN}), chr(10)) AS text), len(string_split(text, chr(10))) AS n_before FROM n),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM f),
c AS (SELECT *, {X.strip('raw')} AS line FROM l), h AS (SELECT line FROM c WHERE line <> '' GROUP BY line HAVING count(*) >= 10),
k AS (SELECT c.doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE h.line IS NULL) AS text, count(*) FILTER (WHERE h.line IS NOT NULL)::BIGINT AS boilerplate_lines FROM c LEFT JOIN h ON c.line = h.line GROUP BY c.doc_id),
x AS (SELECT f.doc_id, source, source_type, lang, coalesce(k.text, '') AS text, coalesce(boilerplate_lines, 0) AS boilerplate_lines, (n_before - greatest(len(string_split(f.text, chr(10))), 1))::BIGINT AS foreign_lines FROM f LEFT JOIN k ON f.doc_id = k.doc_id),
lp AS (WITH {_SCORED} SELECT doc_id // 2 AS doc_id, predicted, confidence FROM r WHERE doc_id % 2 = 1),
y AS (SELECT x.*, predicted, {X.GOOD} AS good, predicted = 'en' AND confidence >= 0.5 AS spoken, {X.EXACT} AS e, {X.PREFIX} AS p, {X.PROSE_WORDS} AS words FROM x JOIN lp ON x.doc_id = lp.doc_id),
o AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'kept' WHEN e = first_value(e) OVER w THEN 'removed_exact' ELSE 'removed_near' END AS status FROM y WHERE good AND spoken WINDOW w AS (PARTITION BY p ORDER BY {X.RANK})
UNION ALL SELECT *, CASE WHEN good THEN 'removed_language' ELSE 'removed_quality' END FROM y WHERE NOT (good AND spoken))"""


def outcomes(spark, sf_dir: str) -> DataFrame:
    d = X.nagari(spark, sf_dir).select("doc_id", "source", "source_type", "lang", "text")
    model = langid.train(d.where("doc_id % 2 = 0"))
    return chain.outcomes(chain.filtered(d), model, "en", X.rank())


def _counts() -> list:
    return [F.count(F.lit(1)).alias("n_input"), *[F.count_if(F.col("status") == s).alias(s) for s in chain.REASONS]]


_COUNTS = ", ".join(["count(*)::BIGINT AS n_input", *[f"count(*) FILTER (WHERE status = '{s}')::BIGINT AS {s}" for s in chain.REASONS]])


@query(f"WITH {_CHAIN} SELECT source_type, {_COUNTS}, sum(foreign_lines)::BIGINT AS foreign_lines, sum(boilerplate_lines)::BIGINT AS boilerplate_lines FROM o GROUP BY source_type")
def q_clean_chain(spark, sf_dir):
    """Documents in, kept and removed by each gate, and the lines that the filters dropped before any gate."""
    return outcomes(spark, sf_dir).groupBy("source_type").agg(*_counts(), F.sum("foreign_lines").alias("foreign_lines"), F.sum("boilerplate_lines").alias("boilerplate_lines"))


@query(f"""WITH {_CHAIN}, g AS (SELECT source, {_COUNTS}, coalesce(sum(words) FILTER (WHERE status = 'kept'), 0)::BIGINT AS words FROM o GROUP BY source)
SELECT source, n_input, kept, words, round_even(words * 1.15::DOUBLE, 0)::BIGINT AS est_tokens, kept / n_input::DOUBLE AS keep_rate FROM g""")
def q_chain_sources(spark, sf_dir):
    """What the whole chain keeps of each source."""
    kept = F.col("status") == "kept"
    g = outcomes(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_input"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.col("words"))), F.lit(0)).alias("words"))
    return g.select("source", "n_input", "kept", "words", F.bround(F.col("words") * F.lit(1.15)).cast("long").alias("est_tokens"), (F.col("kept") / F.col("n_input")).alias("keep_rate"))


@query(f"WITH {_CHAIN} SELECT predicted, count(*)::BIGINT AS n FROM o WHERE good GROUP BY predicted ORDER BY n DESC, predicted LIMIT 12")
def q_chain_languages(spark, sf_dir):
    """The most frequent predicted languages of documents behind the quality gate: twelve is the feature."""
    return outcomes(spark, sf_dir).where("good").groupBy("predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicted").limit(12)
