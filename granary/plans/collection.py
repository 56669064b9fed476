"""Queries of collection, vocabulary choice, generation means, answer boundaries, logs and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import boilerplate, reasoning, scores, vocab
from ..sources import readers as R
from . import fixtures as X
from .cleaning import _BLOCK, _CLEAN_LINE, _LATIN, _LINES, _NAG
from .registry import query

_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query("""WITH RECURSIVE t AS (SELECT page_id AS node, 0 AS depth FROM pages WHERE page_id = 0 UNION SELECT p.page_id, t.depth + 1 FROM t JOIN pages p ON p.page_id // 3 = t.node AND p.page_id > 0 WHERE t.depth < 4)
SELECT node, min(depth)::INT AS depth FROM t GROUP BY node""")
def q_sitemap_walk(spark, sf_dir):
    """Pages as a tree of sitemaps, each visited once, four rounds deep."""
    p = X.table(spark, sf_dir, "pages").select("page_id")
    edges = p.where("page_id > 0").select(F.floor(F.col("page_id") / 3).alias("parent"), F.col("page_id").alias("child"))
    return R.bfs(edges, p.where("page_id = 0").select(F.col("page_id").alias("node")), 4, 1_000_000)


@query(f"SELECT source, arg_min(url, page_id) AS url, min(page_id) AS page_id FROM (SELECT {_HOST} AS source, url, page_id FROM pages WHERE page_id % 3 > 0) GROUP BY source")
def q_sitemap_pick(spark, sf_dir):
    """The first candidate of each host that answers."""
    p = X.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"), "url", "page_id", (F.col("page_id") % 3 > 0).alias("ok"))
    return R.first_hit(p, "source", "page_id", "ok").drop("ok")


@query(f"""WITH r AS (SELECT {_HOST} AS source, min(page_id) AS first_page, count(*) % 2 = 0 AS enabled FROM pages GROUP BY 1)
SELECT p.page_id, r.source, r.first_page FROM pages p JOIN r ON regexp_extract(p.url, '://([^/?#]*)', 1) = r.source WHERE enabled""")
def q_frontier_registry(spark, sf_dir):
    """Urls of a frontier with what the registry says of their source; the registry is a list of sites."""
    p = X.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"))
    registry = p.groupBy("source").agg(F.min("page_id").alias("first_page"), (F.count(F.lit(1)) % 2 == 0).alias("enabled"))
    return p.join(registry.where("enabled").drop("enabled"), "source").select("page_id", "source", "first_page")


@query("""WITH n AS (SELECT event_type, ts, ((row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1) // 100)::BIGINT AS page FROM events),
p AS (SELECT event_type, page, count(*)::BIGINT AS n, epoch_us(min(ts)) AS cursor_us FROM n GROUP BY ALL)
SELECT *, coalesce(lag(cursor_us) OVER (PARTITION BY event_type ORDER BY page) = cursor_us, false) AS stalled FROM p""")
def q_date_pages(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("cursor_us"))
    return R.date_pages(e, "event_type", "cursor_us", "event_id", 100).withColumnRenamed("cursor", "cursor_us")


@query("SELECT event_type, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1000000::BIGINT ELSE min(epoch_us(ts)) END AS start FROM events GROUP BY event_type")
def q_archive_start(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return R.archive_start(e, e.agg(F.min("event_type").alias("event_type")).withColumn("pinned", F.lit(1_000_000).cast("long")), "event_type", "us")


_RATIO = f"len(regexp_extract_all(text, '{_NAG}')) / nullif(length(regexp_replace(text, '{X.WS}', '', 'g')), 0)::DOUBLE"


@query(f"""WITH {X.DV}, c AS (SELECT doc_id AS row_id, source, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_CLEAN_LINE}),
lambda x: x <> '' AND NOT regexp_matches(x, '{T.JSON_LINE}') AND NOT regexp_matches(x, '{_BLOCK}', 'i')), chr(10)) AS text FROM dv WHERE {X.strip('text')} <> '')
SELECT row_id, source, {X.EXACT} AS doc_id, {X.PROSE_WORDS} AS words, coalesce({_RATIO}, 0.0) AS ratio FROM c WHERE {X.GOOD} AND coalesce({_RATIO}, 0.0) >= 0.5""")
def q_record_documents(spark, sf_dir):
    """Records of a public dataset as documents, behind the quality gate and the least share of the script."""
    d = X.nagari(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "source", "text", F.lit(None).cast("string").alias("url"))
    return R.record_documents(d, "text", "url", T.DEVANAGARI).select("row_id", "source", "doc_id", "words", "ratio")


@query(f"""WITH {X.DV}, l AS (SELECT source_type, unnest(string_split(text, chr(10))) AS x, text FROM dv),
c AS (SELECT source_type, {X.strip('x')} AS line, ({X.n_words('x')} >= 4 AND {_LATIN} > 0.8) AS far FROM l),
h AS (SELECT line, count(*) AS n FROM c WHERE line <> '' GROUP BY line),
f AS (SELECT doc_id, source_type, string_split(text, chr(10)) AS a, list_filter(string_split(text, chr(10)), lambda x: NOT ({X.n_words('x')} >= 4 AND {_LATIN} > 0.8)) AS b FROM dv),
g AS (SELECT source_type, sum(len(a) - greatest(len(b), 1))::BIGINT AS dropped_foreign FROM f GROUP BY 1),
b AS (SELECT source_type, count(*) FILTER (WHERE h.n >= 10)::BIGINT AS dropped_boilerplate FROM c LEFT JOIN h ON c.line = h.line AND c.line <> '' GROUP BY 1)
SELECT source_type, dropped_foreign, dropped_boilerplate FROM g JOIN b USING (source_type)""")
def q_line_counters(spark, sf_dir):
    """Lines that the two line filters drop, of all documents, before any gate."""
    d = X.nagari(spark, sf_dir).select("doc_id", "source_type", "text")
    far = d.groupBy("source_type").agg(F.sum(T.lines_dropped(F.col("text"), T.drop_foreign_lines(F.col("text")))).alias("dropped_foreign"))
    kept = boilerplate.drop_lines(d, boilerplate.hash_counts(d).where("n >= 10"))
    return far.join(kept.groupBy("source_type").agg(F.sum("dropped").alias("dropped_boilerplate")), "source_type")


@query(f"WITH {_LINES} SELECT (row_number() OVER (ORDER BY hash))::INT AS place, hash FROM b WHERE n >= 10")
def q_hot_hash_list(spark, sf_dir):
    """The list of repeated lines as it is stored, in the order of the hashes; it has as many rows as lines over the threshold."""
    hot = boilerplate.hash_counts(X.documents(spark, sf_dir)).where("n >= 10").select("hash")
    return hot.select(F.row_number().over(Window.orderBy("hash")).alias("place"), "hash")


@query(f"SELECT source, sum({X.n_words('text')})::BIGINT AS tokens, (rank() OVER (ORDER BY sum({X.n_words('text')}) DESC, source))::INT AS place FROM documents GROUP BY source")
def q_sources_by_tokens(spark, sf_dir):
    g = X.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.word_count(F.col("text"))).alias("tokens"))
    return g.select("source", "tokens", F.rank().over(Window.orderBy(F.desc("tokens"), "source")).alias("place"))


_CAND = f"""w AS (SELECT unnest(regexp_extract_all(text, '{X.NOT_WS}+')) AS word FROM documents), f AS (SELECT word, count(*)::BIGINT AS n FROM w GROUP BY word),
e AS (SELECT s AS vocab_size, word, n, ceil(length(word) / (s // 1000)::DOUBLE)::BIGINT AS p, (length(word) > 12)::BIGINT AS b FROM f, (VALUES (2000), (4000), (6000)) z(s)),
v AS (SELECT vocab_size, count(*)::BIGINT AS distinct_words, sum(n)::BIGINT AS words, sum(n * p)::BIGINT AS tokens, sum(n * p) / sum(n)::DOUBLE AS fertility, sum(n * length(word)) / sum(n * p)::DOUBLE AS chars_per_token,
sum(n) FILTER (WHERE p = 1) / sum(n)::DOUBLE AS whole_share, sum(n) FILTER (WHERE p > 1) / sum(n)::DOUBLE AS continued_share, sum(n * b) / sum(n * p)::DOUBLE AS byte_share FROM e GROUP BY vocab_size)"""


def candidates(spark, sf_dir):
    """Three vocabularies whose pieces have a fixed length, so SQL can encode with them too."""
    f = vocab.word_frequencies(X.table(spark, sf_dir, "documents"), "text")
    e = f.withColumn("vocab_size", F.explode(F.array(*[F.lit(s) for s in (2000, 4000, 6000)])))
    e = e.withColumn("pieces", F.ceil(F.length("word") / F.floor(F.col("vocab_size") / 1000)))
    return vocab.evaluate_candidates(e.withColumn("known_pieces", F.col("pieces") - (F.length("word") > 12).cast("long")))


@query(f"WITH {_CAND} SELECT * FROM v")
def q_vocab_evaluation(spark, sf_dir):
    return candidates(spark, sf_dir)


@query(f"WITH {_CAND} SELECT * FROM v WHERE vocab_size = (SELECT min(vocab_size) FROM v WHERE vocab_size <= 5000 AND fertility <= 1.03 * (SELECT min(fertility) FROM v WHERE vocab_size <= 5000))")
def q_vocab_lookup(spark, sf_dir):
    return vocab.lookup_selected(candidates(spark, sf_dir), 5000)


_TURN = "a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role <> 'user'), j AS (SELECT a.*, reply FROM a JOIN b USING (conv_id, turn))"


def turns(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", "text")
    return a.join(c.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")), ["conv_id", "turn"])


@query(f"""WITH {_TURN}, m AS (SELECT {X.n_words('text')} AS x, {X.n_words('reply')} AS y FROM j)
SELECT count(*)::BIGINT AS pairs, avg(x) AS mean_words, avg(y) AS mean_reference_words FROM m""")
def q_generation_means(spark, sf_dir):
    d = turns(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text", "reply")
    both = scores.paired(d.select("k", "text"), d.select("k", "reply"), "k")
    return scores.generation_means(both, "text", "reply").select("pairs", "mean_words", "mean_reference_words")


@query(f"""WITH {_TURN}, w AS (SELECT conv_id, turn, regexp_extract_all(text, '{X.NOT_WS}+') AS p, regexp_extract_all(text || ' ' || reply, '{X.NOT_WS}+') AS q, regexp_extract_all(reply, '{X.NOT_WS}+') AS r FROM j)
SELECT conv_id, turn, len(p)::BIGINT AS boundary, len(list_filter(generate_series(1, least(len(p), len(r))), lambda i: p[1:i] = r[1:i]))::BIGINT AS shared_start FROM w""")
def q_answer_boundary(spark, sf_dir):
    """Where the answer begins in the tokens of a prompt with its answer, and how far prompt and answer begin alike."""
    d = reasoning.text_view(turns(spark, sf_dir).withColumnsRenamed({"text": "prompt", "reply": "answer"}))
    p, q, r = (T.words(F.col(c)) for c in ("prompt", "text", "answer"))
    d = d.select("conv_id", "turn", p.alias("p"), q.alias("q"), r.alias("r"))
    return d.select("conv_id", "turn", scores.common_prefix(F.col("p"), F.col("q")).alias("boundary"), scores.common_prefix(F.col("p"), F.col("r")).alias("shared_start"))


@query("""WITH l AS (SELECT event_type AS run, event_id AS step, CASE WHEN event_id % 10 = 0 THEN value END AS val_loss, user_id::DOUBLE AS tps, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT run, min(val_loss) AS best, arg_min(step, (val_loss, step)) FILTER (WHERE val_loss IS NOT NULL) AS best_step, avg(tps) FILTER (WHERE k > 1) AS throughput,
((max(step) * 2 - max(step))::DOUBLE / avg(tps) FILTER (WHERE k > 1)) AS "left" FROM l GROUP BY run""")
def q_log_summary(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    total = e.groupBy("event_type").agg((F.max("event_id") * 2).alias("tokens_total"))
    log = e.join(F.broadcast(total), "event_type").select(  # a row a type
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("val_loss"),
        F.col("user_id").cast("double").alias("tokens_per_second"), F.col("event_id").alias("tokens_seen"), "tokens_total",
    )
    return R.log_summary(log, "run")


@query("""WITH f AS (SELECT CASE WHEN l_returnflag LIKE '%A%' THEN 'full' WHEN l_returnflag <> 'N' THEN 'minimal' END AS profile, l_orderkey AS bytes FROM lineitem)
SELECT profile, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM f WHERE profile IS NOT NULL GROUP BY ROLLUP (profile)""")
def q_manifest_totals(spark, sf_dir):
    f = X.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("path"), F.col("l_orderkey").alias("bytes"))
    profile = F.when(F.col("path").contains("A"), "full").when(F.col("path") != "N", "minimal")
    return R.manifest_totals(f, profile)
