"""Smaller queries of each stage: scans, work units, samples, batches, logs and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import measures as M
from ..functions import text as T
from ..operators.running import exclusive_sum
from ..sources import readers as R
from . import corpus
from . import fixtures as X
from .evaluation import _HTML
from .registry import query


@query(f"WITH {X.DOCS} SELECT doc_id, source FROM d ORDER BY {X.RANK} LIMIT 50")
def q_first_documents(spark, sf_dir):
    """A limited scan: the first documents in scan order."""
    return X.documents(spark, sf_dir).orderBy(*X.rank()).limit(50).select("doc_id", "source")


@query(f"WITH {X.DOCS} SELECT source, min(doc_id) AS doc_id, arg_min({X.n_words('text')}, doc_id)::BIGINT AS words, arg_min(length(text), doc_id)::BIGINT AS chars FROM d GROUP BY source")
def q_probe_sources(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("source", "doc_id", T.word_count(F.col("text")).cast("long").alias("w"), F.length("text").cast("long").alias("c"))
    return d.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("w", "doc_id").alias("words"), F.min_by("c", "doc_id").alias("chars"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, (doc_id // 256) AS part, row_number() OVER (PARTITION BY source, doc_id // 256 ORDER BY doc_id) AS k FROM documents) WHERE k > 3")
def q_resume_offset(spark, sf_dir):
    """Records after the offset already consumed, offsets kept for each source and part."""
    w = Window.partitionBy("source", F.floor(F.col("doc_id") / 256)).orderBy("doc_id")
    return X.table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("k")).where("k > 3").select("source", "doc_id")


_LINE = X.strip(r"regexp_replace(x, '[ \t' || chr(160) || chr(8203) || ']+', ' ', 'g')")
_BLOCK = "|".join(T.BLOCKLIST).replace("'", "''")
_CLEANED = f"array_to_string(list_filter(list_transform(string_split({_HTML}, chr(10)), lambda x: {_LINE}), lambda x: x <> '' AND NOT regexp_matches(x, '{T.JSON_LINE}') AND NOT regexp_matches(x, '{_BLOCK}', 'i')), chr(10))"


_PAGES = f"""p AS (SELECT page_id, url, html, {_CLEANED} AS text FROM pages), g AS (SELECT *, {X.PROSE_WORDS} AS w, {X.PROSE_LINES} AS l,
coalesce(len(regexp_extract_all(text, '[A-Za-z]')) / nullif(length(regexp_replace(text, '{X.WS}', '', 'g')), 0)::DOUBLE, 0.0) AS ratio FROM p),
q AS (SELECT page_id, url, {X.EXACT} AS doc_id, w AS words, regexp_extract(html, '(?is)<title>\\s*(.*?)\\s*</title>', 1) AS title,
CASE WHEN NOT regexp_matches(url, '{R.EXCLUDED}', 'i') AND starts_with(url, 'http') AND l >= 2 AND w >= 40 AND ratio >= 0.5 THEN 'kept' WHEN text = '' THEN 'failed' ELSE 'rejected' END AS outcome FROM g)"""


@query(f"WITH {_PAGES} SELECT page_id, doc_id, words, title, outcome FROM q")
def q_page_documents(spark, sf_dir):
    """A landed page as a document, behind the quality gate and the least share of its script, or why it is none."""
    p = X.table(spark, sf_dir, "pages").select("page_id", "url", T.clean(R.html_text(F.col("html"))).alias("t"), R.html_title(F.col("html")).alias("title"))
    return R.page_documents(p, "url", "t", "[A-Za-z]", 40, 2).select("page_id", "doc_id", "words", "title", "outcome")


@query(f"WITH {_PAGES} SELECT regexp_extract(url, '://([^/?#]*)', 1) AS source, count(*)::BIGINT AS attempted, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}')::BIGINT AS {o}" for o in ("kept", "rejected", "failed")) + " FROM q GROUP BY 1")
def q_crawl_outcomes(spark, sf_dir):
    """Pages of each host: attempted, kept, rejected by a gate, failed to give a text."""
    p = X.table(spark, sf_dir, "pages").select("url", T.clean(R.html_text(F.col("html"))).alias("t"))
    d = R.page_documents(p, "url", "t", "[A-Za-z]", 40, 2).select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"), "outcome")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("attempted"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("kept", "rejected", "failed")])


@query("SELECT label FROM (SELECT strftime(unnest(generate_series(date '2023-01-01', date '2024-12-01', interval 1 month)), '%Y-%m') AS label) WHERE label NOT IN (SELECT DISTINCT strftime(ts, '%Y-%m') FROM events)")
def q_pending_months(spark, sf_dir):
    """Work units without a completion marker."""
    done = X.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("label")).distinct()
    return R.month_windows(spark, "2023-01-01", "2025-01-01").select("label").join(done, "label", "left_anti")


@query(f"WITH {X.DOCS} SELECT doc_id, (row_number() OVER (ORDER BY {X.RANK}) - 1)::BIGINT AS place, ((row_number() OVER (ORDER BY {X.RANK}) - 1) // 250)::BIGINT AS shard FROM d")
def q_shard_rotation(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("doc_id", "source", (F.col("source_type") == "downloaded").alias("later"), F.lit(1).alias("one"))
    return exclusive_sum(d, "one", ["later", "source"], "doc_id", "place").select("doc_id", "place", F.floor(F.col("place") / 250).alias("shard"))


@query("SELECT step, i, (('0x' || substr(md5('7:' || step || ':' || i), 1, 8))::BIGINT % 100000) AS start FROM (SELECT unnest(generate_series(0::BIGINT, 49)) AS step), (SELECT unnest(generate_series(0, 7)) AS i)")
def q_random_windows(spark, sf_dir):
    """Starts of training windows as a function of seed and step, so a run resumes without state."""
    s = spark.range(50).select(F.col("id").alias("step"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("7"), "step", "i")), 1, 8), 16, 10).cast("long")
    return s.select("step", "i", (h % 100_000).alias("start"))


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{X.NOT_WS}+') AS w FROM documents) SELECT doc_id, array_to_string(w[1:20], ' ') AS prompt, array_to_string(w[21:30], ' ') AS reference FROM t WHERE len(w) >= 30")
def q_prompt_reference(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") >= 30)
    return d.select("doc_id", F.array_join(F.slice("w", 1, 20), " ").alias("prompt"), F.array_join(F.slice("w", 21, 10), " ").alias("reference"))


@query(f"WITH {corpus._PAIRS}, t AS (SELECT {X.n_words('prompt')} + {X.n_words('answer')} AS n FROM pr) SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE n > 200)::BIGINT AS dropped, min(n) FILTER (WHERE n <= 200)::BIGINT AS shortest, avg(n) FILTER (WHERE n <= 200) AS mean, max(n) FILTER (WHERE n <= 200)::BIGINT AS longest FROM t")
def q_token_lengths(spark, sf_dir):
    n = corpus.pairs(spark, sf_dir).select((T.word_count(F.col("prompt")) + T.word_count(F.col("answer"))).cast("long").alias("n"))
    fit = F.when(F.col("n") <= 200, F.col("n"))
    return n.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") > 200).alias("dropped"), F.min(fit).alias("shortest"), F.avg(fit).alias("mean"), F.max(fit).alias("longest"))


@query("""WITH b AS (SELECT event_type, event_id // 16 AS batch, avg(value) AS loss, count(*) FILTER (WHERE user_id % 2 = 0) AS correct, count(*) AS scored FROM events GROUP BY ALL)
SELECT event_type, sum(correct)::BIGINT AS correct, sum(scored)::BIGINT AS scored, sum(correct) / sum(scored)::DOUBLE AS accuracy, round(avg(loss), 9) AS mean_loss FROM b GROUP BY event_type""")
def q_answer_accuracy(spark, sf_dir):
    """Token accuracy over all tokens; the loss is the mean of batch means, unweighted."""
    b = X.table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("event_id") / 16).alias("batch"))
    b = b.agg(F.avg("value").alias("loss"), F.count_if(F.col("user_id") % 2 == 0).alias("correct"), F.count(F.lit(1)).alias("scored"))
    return b.groupBy("event_type").agg(F.sum("correct").alias("correct"), F.sum("scored").alias("scored"), (F.sum("correct") / F.sum("scored")).alias("accuracy"), F.round(F.avg("loss"), 9).alias("mean_loss"))


@query("SELECT * FROM (VALUES ('▁', '_', false), ('▁der', 'der', false), ('<0x0A>', '<0x0A>', true), ('<0x0A', '<0x0A', false), ('a▁b', 'a b', false)) v(piece, shown, is_byte)")
def q_display_pieces(spark, sf_dir):
    p = spark.createDataFrame([("▁",), ("▁der",), ("<0x0A>",), ("<0x0A",), ("a▁b",)], "piece string")
    return p.select("piece", T.display_piece(F.col("piece")).alias("shown"), F.col("piece").rlike("^<0x..>$").alias("is_byte"))


@query(f"WITH {X.DOCS}, g AS (SELECT source, {X.GOOD} AS good, {X.PROSE_WORDS} AS words FROM d) SELECT source, count(*)::BIGINT AS consumed, count(*) FILTER (WHERE good)::BIGINT AS kept, coalesce(sum(words) FILTER (WHERE good), 0)::BIGINT AS words FROM g GROUP BY source")
def q_download_progress(spark, sf_dir):
    """Records of each source that were read, that passed the quality gate, and the words of those."""
    d = X.table(spark, sf_dir, "documents").select("source", T.good_document(F.col("text")).alias("good"), T.prose_words(F.col("text")).alias("w"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("consumed"), F.count_if("good").alias("kept"), F.coalesce(F.sum(F.when(F.col("good"), F.col("w"))), F.lit(0)).alias("words"))


@query("SELECT step, kept FROM (VALUES (1000, false), (2000, false), (3000, true), (4000, true)) v(step, kept)")
def q_checkpoint_retention(spark, sf_dir):
    return R.latest(spark.createDataFrame([(1000,), (2000,), (3000,), (4000,)], "step int"), 2)


@query("SELECT batch, micro, batch // micro AS steps FROM (VALUES (64::BIGINT, 16::BIGINT), (512, 32)) v(batch, micro)")
def q_accumulation(spark, sf_dir):
    d = spark.createDataFrame([(64, 16), (512, 32)], "batch long, micro long")
    return d.select("batch", "micro", M.accumulation_steps(F.col("batch"), F.col("micro")).alias("steps"))


@query("SELECT source, '| ' || source || ' | ' || count(*) || ' | ' || sum(n_chars)::BIGINT || ' |' AS line FROM documents GROUP BY source")
def q_markdown_rows(spark, sf_dir):
    g = X.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    return g.select("source", F.concat(F.lit("| "), F.concat_ws(" | ", "source", "n", "c"), F.lit(" |")).alias("line"))


@query("SELECT a.doc_id, a.toxic AS first, b.toxic AS second, a.toxic <> b.toxic AS moved FROM labels a JOIN labels b ON a.doc_id = b.doc_id")
def q_run_deltas(spark, sf_dir):
    """Two runs of one evaluation, example by example."""
    a = X.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("first"))
    b = X.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("second"))
    return a.join(b, "doc_id").withColumn("moved", F.col("first") != F.col("second"))


@query(f"WITH {X.DOCS} SELECT doc_id, {X.strip('text')} = text AS stripped, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' ') AS words FROM d")
def q_word_sets(spark, sf_dir):
    t = F.col("text")
    return X.documents(spark, sf_dir).select("doc_id", (T.strip(t) == t).alias("stripped"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z]+)"), F.lit(1)))), " ").alias("words"))
