"""Queries of the cleaning stage: measures, gates, line filters, dedup, splits and their counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boilerplate, dedup
from . import fixtures as X
from .registry import query

GATED = ["doc_id", "source", "source_type", "words"]


def gated(spark, sf_dir: str) -> DataFrame:
    """Documents behind the quality gate with their prose words and hashes; texts stay behind."""
    d = X.documents(spark, sf_dir).where(T.good_document(F.col("text")))
    return d.select("doc_id", "source", "source_type", T.prose_words(F.col("text")).alias("words"), T.content_hash(F.col("text")).alias("exact"), T.prefix_hash(F.col("text")).alias("prefix"))


def statuses(spark, sf_dir: str) -> DataFrame:
    return dedup.dedup_status(gated(spark, sf_dir), F.col("exact"), F.col("prefix"), X.rank())


@query(f"""WITH {X.DOCS}, m AS (SELECT *, {X.PROSE_WORDS} AS words FROM d)
SELECT doc_id, words AS prose_words, {X.PROSE_LINES} AS prose_lines, {X.EXACT} AS content_hash, {X.PREFIX} AS prefix_hash, {X.BUCKET} AS bucket FROM m""")
def q_doc_measures(spark, sf_dir):
    t = F.col("text")
    return X.documents(spark, sf_dir).select(
        "doc_id", T.prose_words(t).alias("prose_words"), T.prose_lines(t).alias("prose_lines"), T.content_hash(t).alias("content_hash"),
        T.prefix_hash(t).alias("prefix_hash"), T.length_bucket(T.prose_words(t)).alias("bucket"),
    )


@query(f"WITH {X.DOCS} SELECT doc_id, {X.GOOD} AS good FROM d")
def q_quality_gate(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", T.good_document(F.col("text")).alias("good"))


@query(f"""WITH {X.DOCS}, m AS (SELECT *, {X.GOOD} AS good, {X.PROSE_WORDS} AS words FROM d)
SELECT source, count(*)::BIGINT AS n_input, count(*) FILTER (WHERE good)::BIGINT AS n_kept, coalesce(sum(words) FILTER (WHERE good), 0)::BIGINT AS words,
round_even(coalesce(sum(words) FILTER (WHERE good), 0) * 1.15::DOUBLE, 0)::BIGINT AS est_tokens, count(*) FILTER (WHERE good) / count(*)::DOUBLE AS keep_rate FROM m GROUP BY source""")
def q_source_keep_rate(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("source", T.good_document(F.col("text")).alias("good"), T.prose_words(F.col("text")).alias("w"))
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_input"), F.count_if("good").alias("n_kept"), F.coalesce(F.sum(F.when(F.col("good"), F.col("w"))), F.lit(0)).alias("words"))
    return g.select("source", "n_input", "n_kept", "words", T.token_estimate(F.col("words")).alias("est_tokens"), (F.col("n_kept") / F.col("n_input")).alias("keep_rate"))


def _chars(text: str) -> str:
    """A SQL expression of these characters."""
    return " || ".join(f"chr({ord(c)})" for c in text)


def _normal_sql() -> str:
    t = f"translate(nfc_normalize(text), {_chars(T.INVISIBLE)}, '')"
    t = f"replace(translate({t}, {_chars(T.PUNCT_FROM)}, {_chars(T.PUNCT_TO)}), chr(8230), '...')"
    for c in T.REPEATED:  # RE2 has no back-references
        t = f"regexp_replace({t}, '[{c}]{{3,}}', '{c}', 'g')"
    line = X.strip(r"regexp_replace(x, '[ \t]+', ' ', 'g')")
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda x: {line}), chr(10))"
    return X.strip(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")


_NORMAL = _normal_sql()


@query(f"""WITH {X.NOISY}, n AS (SELECT doc_id, text, {_NORMAL} AS t FROM noisy)
SELECT doc_id, length(text)::BIGINT AS chars_before, length(t)::BIGINT AS chars_after, (length(text) - length(t))::BIGINT AS removed, text <> t AS changed, sha1(t) AS sha FROM n""")
def q_normalize_report(spark, sf_dir):
    d = X.noisy(spark, sf_dir).select("doc_id", "text", T.normalize(F.col("text")).alias("t"))
    return d.select(
        "doc_id", F.length("text").cast("long").alias("chars_before"), F.length("t").cast("long").alias("chars_after"),
        (F.length("text") - F.length("t")).cast("long").alias("removed"), (F.col("text") != F.col("t")).alias("changed"), F.sha1("t").alias("sha"),
    )


_CLEAN_LINE = X.strip(r"regexp_replace(x, '[ \t' || chr(160) || chr(8203) || ']+', ' ', 'g')")
_BLOCK = "|".join(T.BLOCKLIST).replace("'", "''")


@query(f"""WITH {X.NOISY}, l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {_CLEAN_LINE}) AS a FROM noisy),
k AS (SELECT doc_id, list_filter(a, lambda x: x <> '' AND NOT regexp_matches(x, '{T.JSON_LINE}') AND NOT regexp_matches(x, '{_BLOCK}', 'i')) AS a FROM l)
SELECT doc_id, len(a)::BIGINT AS n_lines, sha1(array_to_string(a, chr(10))) AS sha FROM k""")
def q_clean_text(spark, sf_dir):
    d = X.noisy(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("t"))
    return d.select("doc_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("long").alias("n_lines"), F.sha1("t").alias("sha"))


_NAG = r"[\x{0900}-\x{097F}]"
_LATIN = f"coalesce(len(regexp_extract_all(x, '[A-Za-z]')) / nullif(len(regexp_extract_all(x, '[A-Za-z]')) + len(regexp_extract_all(x, '{_NAG}')), 0)::DOUBLE, 0.0)"


@query(f"""WITH {X.DV}, t AS (SELECT doc_id, text AS x FROM dv)
SELECT doc_id, coalesce(len(regexp_extract_all(x, '{_NAG}')) / nullif(length(regexp_replace(x, '{X.WS}', '', 'g')), 0)::DOUBLE, 0.0) AS native_ratio, {_LATIN} AS latin_ratio FROM t""")
def q_script_ratio(spark, sf_dir):
    return X.nagari(spark, sf_dir).select("doc_id", T.script_ratio(F.col("text")).alias("native_ratio"), T.latin_ratio(F.col("text")).alias("latin_ratio"))


@query(f"""WITH {X.DV}, k AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT ({X.n_words('x')} >= 4 AND {_LATIN} > 0.8)), chr(10)) AS t FROM dv)
SELECT doc_id, sha1(t) AS sha, ((len(string_split(text, chr(10))) - 1) - (greatest(len(string_split(t, chr(10))), 1) - 1))::BIGINT AS dropped FROM k""")
def q_foreign_lines(spark, sf_dir):
    d = X.nagari(spark, sf_dir).select("doc_id", "text", T.drop_foreign_lines(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha1("t").alias("sha"), T.lines_dropped(F.col("text"), F.col("t")).cast("long").alias("dropped"))


_LINES = f"""{X.DOCS}, l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM d),
c AS (SELECT doc_id, pos, raw, {X.strip('raw')} AS line FROM l), h AS (SELECT *, substr(sha1(line), 1, 12) AS hash FROM c WHERE line <> ''),
b AS (SELECT hash, count(*)::BIGINT AS n, arg_min(line, (doc_id, pos)) AS line FROM h GROUP BY hash)"""


@query(f"WITH {_LINES} SELECT hash, n, substr(line, 1, 160) AS example FROM b WHERE n >= 10")
def q_boilerplate_lines(spark, sf_dir):
    return boilerplate.line_counts(X.documents(spark, sf_dir)).where("n >= 10").select("hash", "n", F.substring("line", 1, 160).alias("example"))


@query(f"""WITH {_LINES} SELECT sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_distinct, count(*) FILTER (WHERE n >= 10)::BIGINT AS n_hot,
coalesce(sum(n) FILTER (WHERE n >= 10), 0)::BIGINT AS n_hot_lines, coalesce(sum(n) FILTER (WHERE n >= 10), 0) / sum(n)::DOUBLE AS hot_share FROM b""")
def q_boilerplate_summary(spark, sf_dir):
    hot = F.coalesce(F.sum(F.when(F.col("n") >= 10, F.col("n"))), F.lit(0))
    return boilerplate.hash_counts(X.documents(spark, sf_dir)).agg(
        F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("n") >= 10).alias("n_hot"), hot.alias("n_hot_lines"), (hot / F.sum("n")).alias("hot_share")
    )


@query(f"WITH {_LINES} SELECT hash, n, line AS example FROM b ORDER BY n DESC, hash LIMIT 60")
def q_boilerplate_top(spark, sf_dir):
    """The report of the most frequent lines: its limit is the feature."""
    return boilerplate.line_counts(X.documents(spark, sf_dir)).orderBy(F.desc("n"), "hash").limit(60).select("hash", "n", F.col("line").alias("example"))


@query(f"""WITH {_LINES}, k AS (SELECT c.doc_id, c.pos, c.raw, b.hash IS NOT NULL AS hot FROM c LEFT JOIN b ON c.line <> '' AND substr(sha1(c.line), 1, 12) = b.hash AND b.n >= 10)
SELECT doc_id, sha1(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hot), '')) AS sha, count(*) FILTER (WHERE hot)::BIGINT AS dropped FROM k GROUP BY doc_id""")
def q_drop_boilerplate(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    hot = boilerplate.hash_counts(d).where("n >= 10")
    return boilerplate.drop_lines(d.select("doc_id", "text"), hot).select("doc_id", F.sha1("kept").alias("sha"), "dropped")


@query(f"WITH {X.STATUS} SELECT doc_id, source_type, status FROM s")
def q_dedup_status(spark, sf_dir):
    return statuses(spark, sf_dir).select("doc_id", "source_type", "status")


@query(f"WITH {X.STATUS.replace('PARTITION BY p', 'PARTITION BY e')} SELECT doc_id, status FROM s")
def q_dedup_exact_only(spark, sf_dir):
    return dedup.dedup_status(gated(spark, sf_dir), F.col("exact"), F.col("prefix"), X.rank(), near=False).select("doc_id", "status")


@query(f"WITH {X.STATUS} SELECT source_type, status, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def q_dedup_counts(spark, sf_dir):
    return statuses(spark, sf_dir).groupBy("source_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {X.STATUS}, a AS (SELECT d.source_type, coalesce(s.status, 'removed_quality') AS status FROM d LEFT JOIN s USING (doc_id))
SELECT source_type, count(*)::BIGINT AS n_input, count(*) FILTER (WHERE status = 'kept')::BIGINT AS kept, count(*) FILTER (WHERE status = 'removed_quality')::BIGINT AS removed_quality,
count(*) FILTER (WHERE status = 'removed_exact')::BIGINT AS removed_exact, count(*) FILTER (WHERE status = 'removed_near')::BIGINT AS removed_near FROM a GROUP BY source_type""")
def q_clean_summary(spark, sf_dir):
    n_input = X.documents(spark, sf_dir).groupBy("source_type").agg(F.count(F.lit(1)).alias("n_input"))
    by = statuses(spark, sf_dir).groupBy("source_type").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "removed_exact", "removed_near")])
    j = n_input.join(by, "source_type", "left").fillna(0)
    return j.withColumn("removed_quality", F.col("n_input") - F.col("kept") - F.col("removed_exact") - F.col("removed_near"))


@query(f"WITH {X.STATUS} SELECT {X.BUCKET} AS bucket, count(*)::BIGINT AS n FROM s WHERE status = 'kept' GROUP BY 1")
def q_length_histogram(spark, sf_dir):
    return statuses(spark, sf_dir).where("status = 'kept'").groupBy(T.length_bucket(F.col("words")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.STATUS} SELECT sum(words)::BIGINT AS words, sum(words) FILTER (WHERE source_type = 'manual')::BIGINT AS manual_words, sum(words) FILTER (WHERE source_type = 'manual') / sum(words)::DOUBLE AS manual_fraction FROM s WHERE status = 'kept'")
def q_manual_fraction(spark, sf_dir):
    manual = F.sum(F.when(F.col("source_type") == "manual", F.col("words")))
    return statuses(spark, sf_dir).where("status = 'kept'").agg(F.sum("words").alias("words"), manual.alias("manual_words"), (manual / F.sum("words")).alias("manual_fraction"))


_SPLITS = f"{X.DOCS}, i AS (SELECT *, {X.EXACT} AS ident, {X.PROSE_WORDS} AS words FROM d), p AS (SELECT *, {X.POS} AS pos FROM i), sp AS (SELECT *, {X.SPLIT} AS split FROM p)"


def splits(spark, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = X.documents(spark, sf_dir).select("doc_id", "source", "source_type", T.content_hash(t).alias("ident"), T.prose_words(t).alias("words"))
    return d.withColumn("split", T.assign_split(F.col("ident")))


@query(f"WITH {_SPLITS} SELECT doc_id, ident, pos, split FROM sp")
def q_assign_split(spark, sf_dir):
    return splits(spark, sf_dir).select("doc_id", "ident", T.split_position(F.col("ident")).alias("pos"), "split")


@query(f"""WITH {_SPLITS} SELECT split, source, source_type, count(*)::BIGINT AS docs, sum(words)::BIGINT AS words, round_even(sum(words) * 1.15::DOUBLE, 0)::BIGINT AS est_tokens,
coalesce(sum(words) FILTER (WHERE source_type = 'manual'), 0)::BIGINT AS manual_words FROM sp GROUP BY GROUPING SETS ((split), (split, source), (split, source_type), ())""")
def q_split_summary(spark, sf_dir):
    splits(spark, sf_dir).createOrReplaceTempView("granary_splits")
    g = spark.sql("""SELECT split, source, source_type, count(*) AS docs, sum(words) AS words, coalesce(sum(words) FILTER (WHERE source_type = 'manual'), 0L) AS manual_words
        FROM granary_splits GROUP BY GROUPING SETS ((split), (split, source), (split, source_type), ())""")
    return g.withColumn("est_tokens", T.token_estimate(F.col("words")))


@query(f"""WITH {X.DOCS}, w AS (SELECT doc_id, source, {X.n_words('text')}::BIGINT AS n, source_type = 'downloaded' AS pr FROM d WHERE source_type = 'downloaded'),
t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) SELECT doc_id, source, n FROM t WHERE before < 100000""")
def q_budget_cut(spark, sf_dir):
    d = X.documents(spark, sf_dir).where("source_type = 'downloaded'").select("doc_id", "source", T.word_count(F.col("text")).cast("long").alias("n"))
    return dedup.budget_cut(d, "n", ["source"], "doc_id", 100_000).select("doc_id", "source", "n")
