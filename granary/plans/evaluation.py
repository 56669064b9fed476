"""Queries of collection, evaluation, reasoning data and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import measures as M
from ..functions import text as T
from ..operators import langid, reasoning
from ..sources import readers as R
from . import fixtures as X
from .registry import query

_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"SELECT {_HOST} AS source, p.url FROM pages p WHERE page_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id % 2 = 0 AND s.url = p.url) GROUP BY ALL")
def q_frontier_pending(spark, sf_dir):
    p = X.table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"))
    front = R.frontier(p.where("page_id % 2 = 1").select("source", "url", F.col("page_id").alias("pos")), 1_000_000)
    return R.pending(front, p.where("page_id % 2 = 0")).select("source", "url")


@query(f"""WITH u AS (SELECT {_HOST} AS source, url, min(page_id) AS pos FROM pages GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, url) AS n FROM u)
SELECT source, url, pos FROM r WHERE n <= 2""")
def q_frontier_cap(spark, sf_dir):
    p = X.table(spark, sf_dir, "pages")
    return R.frontier(p.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("source"), "url", F.col("page_id").alias("pos")), 2)


@query(f"SELECT page_id, url, NOT regexp_matches(url, '{R.EXCLUDED}', 'i') AND starts_with(url, 'http') AS wanted FROM pages")
def q_url_wants(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", "url", R.wanted(F.col("url")).alias("wanted"))


@query("SELECT * FROM (VALUES (0, 'src7', 50::BIGINT), (1, 'src0', 50), (2, 'src12', 50)) v(pos, name, x) JOIN (SELECT source, count(*)::BIGINT AS docs FROM documents GROUP BY source) c ON c.source = name".replace("SELECT * FROM", "SELECT pos, name, docs FROM"))
def q_source_lookup(spark, sf_dir):
    registry = X.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("docs"))
    return R.lookup(registry, ["src7", "src0", "src12"])


SITEMAP = "<urlset><url><loc> https://a.example/x?y=1 </loc></url><LOC>https://a.example/map.xml.gz?z</LOC><loc>https://a.example/sub.XML</loc></urlset>"


@query("SELECT * FROM (VALUES ('https://a.example/x?y=1', false), ('https://a.example/map.xml.gz?z', true), ('https://a.example/sub.XML', true)) v(url, is_sitemap)")
def q_sitemap_locs(spark, sf_dir):
    return R.sitemap_entries(spark.createDataFrame([(SITEMAP,)], "xml string"))


_HTML = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript"):
    _HTML = rf"regexp_replace({_HTML}, '(?is)<{_tag}[\s>].*?</{_tag}>', chr(10), 'g')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', chr(10), 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_char}')"
_HTML = rf"regexp_replace({_HTML}, '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT page_id, regexp_extract(html, '(?is)<title>\\s*(.*?)\\s*</title>', 1) AS title, sha1({_HTML}) AS sha, {X.n_words(_HTML)}::BIGINT AS words FROM pages")
def q_html_documents(spark, sf_dir):
    p = X.table(spark, sf_dir, "pages").select("page_id", "html", R.html_text(F.col("html")).alias("t"))
    return p.select("page_id", R.html_title(F.col("html")).alias("title"), F.sha1("t").alias("sha"), T.word_count(F.col("t")).cast("long").alias("words"))


@query("""SELECT strftime(m, '%Y-%m') AS label, greatest(m, date '2023-11-15') AS start, least(m + interval 1 month, date '2025-02-10')::DATE AS stop,
(SELECT count(*) FROM events WHERE date_trunc('month', ts) = m)::BIGINT AS n_events FROM (SELECT unnest(generate_series(date '2023-11-01', date '2025-02-10', interval 1 month))::DATE AS m)""")
def q_month_windows(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("label")).agg(F.count(F.lit(1)).alias("n_events"))
    return R.month_windows(spark, "2023-11-15", "2025-02-10").join(e, "label", "left").fillna(0, ["n_events"])


@query("""WITH l AS (SELECT event_id AS step, value AS loss FROM events)
SELECT step, series, v AS value FROM (SELECT step, 'loss' AS series, loss AS v FROM l UNION ALL SELECT step, 'lr', 0.1::DOUBLE * loss FROM l UNION ALL SELECT step, 'val_loss', loss FROM l WHERE step % 100 = 0) WHERE v IS NOT NULL""")
def q_train_log_series(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").withColumnRenamed("event_id", "step")
    return R.log_series(e.select("step", F.col("value").alias("loss"), (F.lit(0.1) * F.col("value")).alias("lr"), F.when(F.col("step") % 100 == 0, F.col("value")).alias("val_loss"), F.lit(None).cast("double").alias("tokens_per_second")))


@query("SELECT event_type AS split, sum(value)::DOUBLE AS nll, avg(value) AS ce, exp(least(avg(value), 700)) AS perplexity, sum(value) / ln(2) / (count(*) * 4) AS bpb FROM events GROUP BY event_type")
def q_lm_eval(spark, sf_dir):
    g = X.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("split")).agg(F.sum("value").alias("nll"), F.avg("value").alias("ce"), F.count(F.lit(1)).alias("n"))
    return g.select("split", "nll", "ce", M.perplexity(F.col("ce")).alias("perplexity"), M.bits_per_byte(F.col("nll"), F.col("n") * 4).alias("bpb"))


_LR = "0.00006::DOUBLE + 0.5::DOUBLE * (1 + cos(pi() * (step - 500) / 15500.0::DOUBLE)) * (0.0006::DOUBLE - 0.00006::DOUBLE)"


@query(f"SELECT step, CASE WHEN step < 500 THEN 0.0006::DOUBLE * (step + 1) / 500.0::DOUBLE WHEN step >= 16000 THEN 0.00006::DOUBLE ELSE {_LR} END AS lr FROM (SELECT unnest(generate_series(0::BIGINT, 16500, 125)) AS step)")
def q_lr_schedule(spark, sf_dir):
    s = spark.range(0, 16501, 125).withColumnRenamed("id", "step")
    return s.select("step", M.learning_rate(F.col("step"), 6e-4, 500, 16000, 0.1).alias("lr"))


@query("""WITH c(vocab, context, width, layers, hidden, tied, bias) AS (VALUES (16000::BIGINT, 512::BIGINT, 384::BIGINT, 10::BIGINT, 1536::BIGINT, true, 0::BIGINT), (16000, 512, 384, 10, 1536, false, 1)),
p AS (SELECT *, vocab * width AS token_embedding, context * width AS positional_embedding, layers * (4 * width + 3 * width * width + 3 * width * bias + width * width + width * bias + 2 * width * hidden + (hidden + width) * bias) AS blocks,
2 * width AS final_norm, CASE WHEN tied THEN 0 ELSE vocab * width END AS lm_head FROM c)
SELECT tied, token_embedding, positional_embedding, blocks, final_norm, lm_head::BIGINT AS lm_head, (token_embedding + positional_embedding + blocks + final_norm + lm_head)::BIGINT AS total, (blocks + final_norm + lm_head)::BIGINT AS non_embedding FROM p""")
def q_param_count(spark, sf_dir):
    c = spark.createDataFrame([(16000, 512, 384, 10, 1536, True, False), (16000, 512, 384, 10, 1536, False, True)], "vocab long, context long, width long, layers long, hidden long, tied boolean, bias boolean")
    parts = M.parameter_counts(*[F.col(x) for x in ("vocab", "context", "width", "layers", "hidden", "tied", "bias")])
    return c.select("tied", *[v.cast("long").alias(k) for k, v in parts.items()])


_ATT = """g AS (SELECT l AS layer, h AS head, b AS batch, q, k FROM range(2) a(l), range(3) c(h), range(2) d(b), range(16) e(q), range(16) f(k) WHERE k <= q),
w AS (SELECT *, CASE WHEN head = 0 THEN (CASE WHEN k = q THEN 1.0 ELSE 0.0 END)::DOUBLE ELSE (k + 1 + head) / (sum(k + 1 + head) OVER (PARTITION BY layer, head, batch, q))::DOUBLE END AS weight FROM g),
r AS (SELECT layer, head, batch, q, -sum(weight * ln(greatest(weight, 1e-12))) AS entropy, sum(weight * (q - k)) AS distance, sum(weight) FILTER (WHERE k = q) AS self, sum(weight) FILTER (WHERE k = q - 1) AS previous FROM w WHERE q > 0 GROUP BY ALL),
b AS (SELECT layer, head, batch, avg(entropy) AS entropy, avg(entropy / ln(q + 1)) AS normalised, avg(distance) AS distance, avg(self) AS self_share, avg(previous) AS previous_share FROM r GROUP BY ALL),
s AS (SELECT layer, head, avg(entropy) AS entropy, avg(normalised) AS normalised, avg(distance) AS distance, avg(self_share) AS self_share, avg(previous_share) AS previous_share FROM b GROUP BY ALL)"""
_CLASS = "CASE WHEN distance < 0.05 * 16 AND NOT normalised > 0.7 THEN 'local' WHEN normalised > 0.7 AND NOT distance < 0.05 * 16 THEN 'diffuse' WHEN distance > 0.25 * 16 THEN 'long-range' ELSE 'mixed' END"


def attention(spark) -> DataFrame:
    """Per head: means over batches of means over queries (the first query, which sees one key, aside)."""
    g = spark.range(2).withColumnRenamed("id", "layer")
    for name, n in (("head", 3), ("batch", 2), ("q", 16)):
        g = g.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    g = g.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q"))))
    row = Window.partitionBy("layer", "head", "batch", "q")
    raw = F.col("k") + 1 + F.col("head")
    w = g.withColumn("weight", F.when(F.col("head") == 0, (F.col("k") == F.col("q")).cast("double")).otherwise(raw / F.sum(raw).over(row)))
    r = w.where("q > 0").groupBy("layer", "head", "batch", "q").agg(
        (-F.sum(F.col("weight") * F.ln(F.greatest("weight", F.lit(1e-12))))).alias("entropy"), F.sum(F.col("weight") * (F.col("q") - F.col("k"))).alias("distance"),
        F.sum(F.when(F.col("k") == F.col("q"), F.col("weight"))).alias("self"), F.sum(F.when(F.col("k") == F.col("q") - 1, F.col("weight"))).alias("previous"),
    )
    b = r.groupBy("layer", "head", "batch").agg(F.avg("entropy").alias("entropy"), F.avg(F.col("entropy") / F.ln(F.col("q") + 1)).alias("normalised"), F.avg("distance").alias("distance"), F.avg("self").alias("self_share"), F.avg("previous").alias("previous_share"))
    return b.groupBy("layer", "head").agg(*[F.avg(c).alias(c) for c in ("entropy", "normalised", "distance", "self_share", "previous_share")])


@query(f"WITH {_ATT} SELECT layer, head, round(entropy, 9) AS entropy, round(normalised, 9) AS normalised, round(distance, 9) AS distance, self_share, previous_share FROM s")
def q_attention_stats(spark, sf_dir):
    return attention(spark).select("layer", "head", *[F.round(c, 9).alias(c) for c in ("entropy", "normalised", "distance")], "self_share", "previous_share")


@query(f"WITH {_ATT} SELECT {_CLASS} AS label, count(*)::BIGINT AS heads FROM s GROUP BY 1")
def q_head_class(spark, sf_dir):
    return attention(spark).groupBy(M.head_class(F.col("distance"), F.col("normalised"), 16).alias("label")).agg(F.count(F.lit(1)).alias("heads"))


COUNTS = {"train": 240, "validation": 32, "test": 32}


@query()
def q_reasoning_examples(spark, sf_dir):
    return reasoning.generate(spark, COUNTS)


@query()
def q_reasoning_describe(spark, sf_dir):
    return reasoning.describe(reasoning.generate(spark, COUNTS))


@query(f"""WITH e AS (SELECT ['test', 'train', 'validation'][(conv_id % 3 + 1)::INT] AS split, text AS prompt, regexp_extract_all(text, '{X.NOT_WS}+')[1:4] AS entities FROM conversations),
v AS (SELECT DISTINCT split, 'name' AS what, unnest(entities) AS v FROM e UNION SELECT DISTINCT split, 'prompt', prompt FROM e),
g AS (SELECT * FROM (VALUES ('name'), ('prompt')) x(what), (VALUES ('test', 'train'), ('test', 'validation'), ('train', 'validation')) y(a, b))
SELECT g.what, g.a, g.b, (SELECT count(*) FROM v p JOIN v q ON p.v = q.v AND p.what = q.what WHERE p.what = g.what AND p.split = g.a AND q.split = g.b)::BIGINT AS shared FROM g""")
def q_leakage(spark, sf_dir):
    """Turns as examples of three splits: names and prompts that two splits have in common."""
    c = X.table(spark, sf_dir, "conversations")
    split = F.element_at(F.array(*[F.lit(s) for s in ("test", "train", "validation")]), (F.col("conv_id") % 3 + 1).cast("int"))
    return reasoning.leakage(c.select(split.alias("split"), F.col("text").alias("prompt"), F.slice(T.words(F.col("text")), 1, 4).alias("entities")))


def predictions(spark, sf_dir: str) -> DataFrame:
    """Answers to labelled items: right, right with a mark, another word of the prompt, or nothing of it."""
    c = X.table(spark, sf_dir, "conversations").where("role = 'user'")
    k = (F.col("conv_id") + F.col("turn")) % 4
    answer = F.concat(F.lit("राम"), F.element_at(F.array(F.lit("ा"), F.lit("े"), F.lit("न")), (F.col("conv_id") % 3 + 1).cast("int")))
    first = F.regexp_extract("text", T.NOT_WS + "+", 0)
    wrong = F.when(F.endswith(answer, F.lit("ा")), F.lit("रामे")).otherwise(F.lit("क"))
    prediction = F.when(k == 0, answer).when(k == 1, F.concat(F.lit(" "), answer, F.lit(" ।"))).when(k == 2, F.concat(first, F.lit(" है"))).otherwise(wrong)
    template = F.when(F.col("turn") % 3 == 0, "numeric_equality").otherwise("chain_pair")
    return reasoning.scored(c.select("conv_id", "turn", template.alias("template"), (F.col("conv_id") % 3 + 2).cast("int").alias("n_entities"), (F.col("conv_id") % 2 + 1).alias("hops"), F.col("text").alias("prompt"), answer.alias("answer"), prediction.alias("prediction")))


_MARKS = "[ \\t\\n।.,!?\"'']"
_NORM = lambda x: X.strip(f"regexp_replace({X.strip(x)}, '^{_MARKS}+|{_MARKS}+$', '', 'g')")
_SCORED = f"""c AS (SELECT *, (conv_id + turn) % 4 AS kk, 'राम' || ['ा', 'े', 'न'][conv_id % 3 + 1] AS answer, regexp_extract(text, '{X.NOT_WS}+') AS fw FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'numeric_equality' ELSE 'chain_pair' END AS template, (conv_id % 3 + 2)::INT AS n_entities, conv_id % 2 + 1 AS hops, text AS prompt, answer,
  {_NORM("CASE kk WHEN 0 THEN answer WHEN 1 THEN ' ' || answer || ' ।' WHEN 2 THEN fw || ' है' ELSE (CASE WHEN conv_id % 3 = 0 THEN 'रामे' ELSE 'क' END) END")} AS prediction FROM c),
f AS (SELECT *, {_NORM(f"regexp_extract(prediction, '{X.NOT_WS}+')")} AS first_word FROM p),
o AS (SELECT *, prediction = answer AS strict, prediction = answer OR (right(answer, 1) = 'ा' AND prediction = left(answer, length(answer) - 1) || 'े') OR (right(answer, 1) = 'े' AND prediction = left(answer, length(answer) - 1) || 'ा') AS lenient,
  first_word = answer OR (right(answer, 1) = 'ा' AND first_word = left(answer, length(answer) - 1) || 'े') OR (right(answer, 1) = 'े' AND first_word = left(answer, length(answer) - 1) || 'ा') AS first_word_match,
  CASE WHEN template = 'numeric_equality' THEN 0.5 ELSE 1 / greatest(1, n_entities)::DOUBLE END AS chance FROM f)"""


@query(f"""WITH {_SCORED} SELECT template, hops, n_entities, count(*)::BIGINT AS n, round_even(avg(strict::INT), 4) AS strict, round_even(avg(lenient::INT), 4) AS lenient, round_even(avg(first_word_match::INT), 4) AS first_word, round_even(avg(chance), 4) AS chance
FROM o GROUP BY GROUPING SETS ((), (template), (hops), (n_entities))""")
def q_reasoning_accuracy(spark, sf_dir):
    predictions(spark, sf_dir).createOrReplaceTempView("granary_predictions")
    return spark.sql("""SELECT template, hops, n_entities, count(*) AS n, bround(avg(int(strict)), 4) AS strict, bround(avg(int(lenient)), 4) AS lenient,
        bround(avg(int(first_word_match)), 4) AS first_word, bround(avg(chance), 4) AS chance FROM granary_predictions GROUP BY GROUPING SETS ((), (template), (hops), (n_entities))""")


@query(f"""WITH {_SCORED}, t AS (SELECT *, CASE WHEN lenient THEN 'success' WHEN first_word <> '' AND contains(prompt, first_word) THEN 'wrong_entity' ELSE 'off_format' END AS class FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY CASE WHEN class = 'success' THEN -hops ELSE 0 END, conv_id, turn) AS k FROM t) SELECT class, k, conv_id, turn, hops, first_word FROM k WHERE k <= 5""")
def q_failure_triage(spark, sf_dir):
    """The hardest successes and the first failures of each class: five of each is the feature."""
    w = Window.partitionBy("class").orderBy(F.when(F.col("class") == "success", -F.col("hops")).otherwise(0), "conv_id", "turn")
    t = reasoning.triage(predictions(spark, sf_dir)).withColumn("k", F.row_number().over(w))
    return t.where("k <= 5").select("class", F.col("k").cast("long").alias("k"), "conv_id", "turn", "hops", "first_word")


_LANG = """s AS (SELECT doc_id, lang, lower(trim(replace(substr(text, 1, 2000), chr(10), ' '))) AS s FROM documents),
g AS (SELECT doc_id, lang, substr(s, i, 3) AS gram FROM (SELECT doc_id, lang, s, unnest(generate_series(1, length(s) - 2)) AS i FROM s WHERE length(s) >= 20)),
c AS (SELECT lang, gram, count(*) AS c FROM g WHERE doc_id % 2 = 0 GROUP BY ALL), v AS (SELECT count(DISTINCT gram) AS v FROM c), t AS (SELECT lang, sum(c) AS total FROM c GROUP BY lang),
m AS (SELECT gram, t.lang, ln((coalesce(c.c, 0) + 1) / (total + v)::DOUBLE) AS logp FROM (SELECT DISTINCT gram FROM c) x CROSS JOIN t CROSS JOIN v LEFT JOIN c USING (gram, lang)),
d AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL), sc AS (SELECT doc_id, m.lang, sum(d.c * logp) / sum(d.c) AS mean FROM d JOIN m USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, arg_max(lang, (mean, lang)) AS predicted, max(mean) AS best FROM sc GROUP BY doc_id),
p AS (SELECT doc_id, predicted, 1 / sum(exp(20 * (mean - best))) AS confidence FROM sc JOIN b USING (doc_id) GROUP BY ALL),
r AS (SELECT s.doc_id, s.lang, coalesce(predicted, 'unknown') AS predicted, round(coalesce(confidence, 0), 6) AS confidence FROM s LEFT JOIN p USING (doc_id))"""


def languages(spark, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = langid.train(d.where("doc_id % 2 = 0"))
    p = langid.predict(d.select(F.struct("doc_id", "lang").alias("row"), "text"), model, ident="row")  # texts are read once, nothing is joined back
    return p.select("row.*", "predicted", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_LANG} SELECT doc_id, predicted, confidence, predicted = lang AND confidence >= 0.5 AS accepted FROM r")
def q_lang_predict(spark, sf_dir):
    return languages(spark, sf_dir).select("doc_id", "predicted", "confidence", ((F.col("predicted") == F.col("lang")) & (F.col("confidence") >= 0.5)).alias("accepted"))


@query(f"WITH {_LANG} SELECT lang, predicted, count(*)::BIGINT AS n FROM r GROUP BY ALL ORDER BY n DESC LIMIT 12")
def q_lang_confusion(spark, sf_dir):
    return languages(spark, sf_dir).groupBy("lang", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang", "predicted").limit(12)


ARTIFACTS = [("hi", "perplexity", 28.43), ("hi", "bpb", 0.493), ("ne", "perplexity", 45.23), ("ne", "fertility", 1.4151)]


@query("SELECT * FROM (VALUES ('bpb', '0.493', '--'), ('fertility', '--', '1.4151'), ('perplexity', '28.43', '45.23')) v(metric, hi, ne)")
def q_model_comparison(spark, sf_dir):
    a = spark.createDataFrame(ARTIFACTS, "model string, metric string, value double")
    p = a.groupBy("metric").pivot("model", ["hi", "ne"]).agg(F.first(F.col("value").cast("string")))
    return p.fillna("--", ["hi", "ne"])


@query()
def q_manifest(spark, sf_dir):
    m = R.manifest(spark, f"{sf_dir}/region.parquet")
    return m.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "bytes", "sha256")


@query("SELECT event_type, time_bucket(interval 5 minutes, ts) AS start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def q_event_windows(spark, sf_dir):
    w = X.table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("w.start").alias("start"), "n", F.round("total", 6).alias("total"))
