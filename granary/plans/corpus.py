"""Queries of the measuring stages: word frequencies, vocabularies, totals, packing, windows and generation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import scores, vocab
from ..operators.running import exclusive_sum
from . import fixtures as X
from .registry import query

_FREQ = f"{X.DOCS}, w AS (SELECT unnest(regexp_extract_all(text, '{X.NOT_WS}+')) AS word FROM d), f AS (SELECT word, count(*)::BIGINT AS n FROM w GROUP BY word)"


def frequencies(spark, sf_dir: str) -> DataFrame:
    return vocab.word_frequencies(X.documents(spark, sf_dir), "text")


@query(f"WITH {_FREQ} SELECT word, n FROM f WHERE n >= 5")
def q_word_freq(spark, sf_dir):
    return frequencies(spark, sf_dir).where("n >= 5")


@query(f"""WITH {_FREQ}, c AS (SELECT n, count(*)::BIGINT AS words FROM f GROUP BY n)
SELECT n, words, (coalesce(sum(words) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_rank,
max(n) OVER () / (coalesce(sum(words) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::DOUBLE AS zipf FROM c""")
def q_zipf(spark, sf_dir):
    """Ranks by class of equal frequency: the window is over distinct frequencies, which grow with the root of the corpus."""
    c = frequencies(spark, sf_dir).groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    first = F.coalesce(F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return c.select("n", "words", first.alias("first_rank"), (F.max("n").over(Window.partitionBy()) / first).alias("zipf"))


@query(f"WITH {_FREQ} SELECT count(*)::BIGINT AS n_distinct, count(*) FILTER (WHERE n = 1)::BIGINT AS hapax, sum(n)::BIGINT AS total, count(*) FILTER (WHERE n = 1) / count(*)::DOUBLE AS hapax_share FROM f")
def q_hapax(spark, sf_dir):
    one = F.count_if(F.col("n") == 1)
    return frequencies(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_distinct"), one.alias("hapax"), F.sum("n").alias("total"), (one / F.count(F.lit(1))).alias("hapax_share"))


@query(f"""WITH {_FREQ}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, word) AS k FROM f)
SELECT sum(n) FILTER (WHERE k <= 10) / sum(n)::DOUBLE AS top10, sum(n) FILTER (WHERE k <= 100) / sum(n)::DOUBLE AS top100, sum(n) FILTER (WHERE k <= 1000) / sum(n)::DOUBLE AS top1000 FROM r""")
def q_coverage_shares(spark, sf_dir):
    f = frequencies(spark, sf_dir)
    top = f.orderBy(F.desc("n"), "word").limit(1000).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "word")))
    sums = top.agg(*[F.sum(F.when(F.col("k") <= k, F.col("n"))).alias(f"s{k}") for k in (10, 100, 1000)])
    both = sums.join(f.agg(F.sum("n").alias("total")), F.lit(True))  # one row each
    return both.select(*[(F.col(f"s{k}") / F.col("total")).alias(f"top{k}") for k in (10, 100, 1000)])


@query(f"WITH {_FREQ} SELECT word AS piece, n FROM f ORDER BY n DESC, word LIMIT 20")
def q_top_pieces(spark, sf_dir):
    return frequencies(spark, sf_dir).orderBy(F.desc("n"), "word").limit(20).select(F.col("word").alias("piece"), "n")


# Published candidate vocabularies (size, tokens per word).
CANDIDATES = [(8000, 1.4155), (12000, 1.3245), (16000, 1.2745), (24000, 1.2185)]


@query("SELECT * FROM (VALUES (17566, 16000), (24000, 24000), (100, 8000)) t(cap, vocab_size)")
def q_vocab_selection(spark, sf_dir):
    c = spark.createDataFrame(CANDIDATES, "vocab_size int, fertility double")
    parts = [vocab.select_vocabulary(c, cap).select(F.lit(cap).alias("cap"), "vocab_size") for cap in (17566, 24000, 100)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def trained(spark, sf_dir: str, size: int = 600) -> list[str]:
    lines = vocab.training_lines(X.documents(spark, sf_dir))
    return vocab.train_bpe(vocab.word_frequencies(lines), size)


@query()
def q_bpe_vocab(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(trained(spark, sf_dir))), "id int, piece string")


@query()
def q_bpe_encode_stats(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    words = d.select("source_type", F.explode(T.words(F.col("text"))).alias("word")).groupBy("source_type", "word").agg(F.count(F.lit(1)).alias("n"))
    e = vocab.encode_measures(words, trained(spark, sf_dir))
    bytes_ = F.size(F.filter("ids", lambda i: (i >= 4) & (i < 260)))
    g = e.groupBy("source_type").agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.size("ids")).alias("tokens"), F.sum(F.col("n") * bytes_).alias("byte_tokens"))
    return g.withColumn("fertility", F.col("tokens") / F.col("words"))


@query(f"""WITH {X.DOCS}, m AS (SELECT *, {X.n_words('text')} AS w FROM d)
SELECT source_type, source, count(*)::BIGINT AS docs, sum(w)::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes,
sum(w) >= 500000000 AS enough, coalesce(sum(w) FILTER (WHERE source_type = 'manual'), 0) / sum(w)::DOUBLE >= 0.2 AS manual_enough FROM m GROUP BY GROUPING SETS ((source_type), (source_type, source), ())""")
def q_corpus_totals(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("source_type", "source", T.word_count(F.col("text")).alias("w"), F.length("text").alias("c"), F.octet_length("text").alias("b"))
    d.createOrReplaceTempView("granary_measures")
    return spark.sql("""SELECT source_type, source, count(*) AS docs, sum(w) AS words, sum(c) AS chars, sum(b) AS bytes, sum(w) >= 500000000 AS enough,
        coalesce(sum(w) FILTER (WHERE source_type = 'manual'), 0) / sum(w) >= 0.2D AS manual_enough
        FROM granary_measures GROUP BY GROUPING SETS ((source_type), (source_type, source), ())""")


_PACK = f"""{X.DOCS}, t AS (SELECT doc_id, source_type, source, {X.n_words('text')}::BIGINT + 1 AS n_tokens, strlen(text) AS b, text, {X.EXACT} AS ident FROM d WHERE text <> ''),
s AS (SELECT *, {X.POS} AS pos FROM t), p AS (SELECT *, {X.SPLIT} AS split FROM s),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (ORDER BY {X.RANK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p)"""


def packed(spark, sf_dir: str) -> DataFrame:
    """Token counts with one end token a document; empty texts are skipped."""
    t = F.col("text")
    d = X.documents(spark, sf_dir).where("text <> ''")
    return d.select("doc_id", (F.col("source_type") == "downloaded").alias("later"), "source", (T.word_count(t).cast("long") + 1).alias("n_tokens"), F.octet_length(t).cast("long").alias("bytes"), T.assign_split(T.content_hash(t)).alias("split"))


@query(f"WITH {_PACK} SELECT doc_id, n_tokens, start FROM o")
def q_pack_offsets(spark, sf_dir):
    return exclusive_sum(packed(spark, sf_dir), "n_tokens", ["later", "source"], "doc_id", "start").select("doc_id", "n_tokens", "start")


@query(f"WITH {_PACK} SELECT split, sum(n_tokens)::BIGINT AS n_tokens, count(*)::BIGINT AS n_documents, sum(b)::BIGINT AS utf8_bytes, (sum(n_tokens) - count(*))::BIGINT AS n_encoded FROM p GROUP BY split")
def q_pack_meta(spark, sf_dir):
    g = packed(spark, sf_dir).groupBy("split").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("bytes").alias("utf8_bytes"))
    return g.withColumn("n_encoded", F.col("n_tokens") - F.col("n_documents"))


@query(f"""WITH {_PACK}, n AS (SELECT split, sum(n_tokens)::BIGINT AS n FROM p GROUP BY split)
SELECT split, n AS n_tokens, ((n - 1) // 512)::BIGINT AS windows, ((n - 1) // 512 // 16)::BIGINT AS batches, ((n - 1) // 512 // 16 * 16 * 512)::BIGINT AS scored FROM n""")
def q_eval_windows(spark, sf_dir):
    """Windows of 512 need one token to look ahead; a last batch of fewer than 16 windows is left out."""
    n = packed(spark, sf_dir).groupBy("split").agg(F.sum("n_tokens").alias("n_tokens"))
    w = F.floor((F.col("n_tokens") - 1) / 512)
    return n.select("split", "n_tokens", w.alias("windows"), F.floor(w / 16).alias("batches"), (F.floor(w / 16) * 16 * 512).alias("scored"))


@query("SELECT i, ((i * (available - 1)) // (lim - 1))::BIGINT AS batch, available, lim FROM (VALUES (10::BIGINT, 4::BIGINT), (100, 7), (1000, 20)) v(available, lim), LATERAL (SELECT unnest(generate_series(0, lim - 1)) AS i)")
def q_spread_windows(spark, sf_dir):
    v = spark.createDataFrame([(10, 4), (100, 7), (1000, 20)], "available long, lim long")
    v = v.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lim") - 1)))
    return v.select("i", F.floor(F.col("i") * (F.col("available") - 1) / (F.col("lim") - 1)).alias("batch"), "available", "lim")


_TOK = f"tk AS (SELECT conv_id, turn, generate_subscripts(regexp_extract_all(text, '{X.NOT_WS}+'), 1)::INT - 1 AS pos, unnest(regexp_extract_all(text, '{X.NOT_WS}+')) AS token FROM conversations)"


@query(f"WITH {_TOK} SELECT conv_id, turn, pos, token, lead(token) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS target FROM tk")
def q_next_token(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.words(F.col("text"))).alias("pos", "token"))
    return c.withColumn("target", F.lead("token").over(Window.partitionBy("conv_id").orderBy("turn", "pos")))


_PAIRS = "pr AS (SELECT * FROM (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


def pairs(spark, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "prompt", "answer")


def masked(p: DataFrame) -> DataFrame:
    """ids of prompt and answer words, and labels: -100 over the prompt, the next token elsewhere."""
    d = p.withColumn("a", T.words(F.col("prompt"))).withColumn("b", T.words(F.col("answer"))).withColumn("ids", F.concat("a", "b"))
    return d.withColumn("labels", F.transform("ids", lambda x, i: F.when(i >= F.size("a"), x).otherwise("-100")))


@query(f"WITH {_PAIRS}, t AS (SELECT *, regexp_extract_all(prompt, '{X.NOT_WS}+') AS a, regexp_extract_all(answer, '{X.NOT_WS}+') AS b FROM pr) SELECT conv_id, turn, (len(a) + len(b))::BIGINT AS n_tokens, len(b)::BIGINT AS n_scored, sha1(array_to_string(list_concat(list_transform(a, lambda x: '-100'), b), ' ')) AS labels_sha FROM t")
def q_answer_mask(spark, sf_dir):
    d = masked(pairs(spark, sf_dir))
    scored = F.size(F.filter("labels", lambda x: x != "-100"))
    return d.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"), F.size("b").cast("long").alias("n_scored"), F.sha1(F.array_join("labels", " ")).alias("labels_sha"))


@query(f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, {X.n_words('prompt')} + {X.n_words('answer')} AS n, conv_id // 64 AS shard FROM pr),
b AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY n, conv_id, turn) - 1) // 8 AS batch FROM t)
SELECT shard, batch::BIGINT AS batch, count(*)::BIGINT AS rows, max(n)::BIGINT AS width, sum(n)::BIGINT AS tokens, (max(n) * count(*) - sum(n))::BIGINT AS padding FROM b WHERE n <= 400 GROUP BY shard, batch""")
def q_padded_batches(spark, sf_dir):
    """Batches of 8 rows of like length, padded to the longest; over-long rows are left out after dealing."""
    d = pairs(spark, sf_dir).select("conv_id", "turn", (T.word_count(F.col("prompt")) + T.word_count(F.col("answer"))).cast("long").alias("n"), F.floor(F.col("conv_id") / 64).alias("shard"))
    d = d.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("shard").orderBy("n", "conv_id", "turn")) - 1) / 8)).where("n <= 400")
    return d.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("width"), F.sum("n").alias("tokens"), (F.max("n") * F.count(F.lit(1)) - F.sum("n")).alias("padding"))


def _grams_sql(n: int) -> str:
    return f"[array_to_string(w[i:i+{n - 1}], chr(1)) for i in range(1, len(w) - {n - 2})]"


_ANSWERS = f"aw AS (SELECT regexp_extract_all(text, '{X.NOT_WS}+') AS w FROM conversations WHERE role = 'assistant')"


@query(f"WITH {_ANSWERS} " + " UNION ALL ".join(f"SELECT {n} AS n, count(DISTINCT g)::BIGINT AS n_distinct, count(*)::BIGINT AS total, count(DISTINCT g) / count(*)::DOUBLE AS ratio FROM (SELECT unnest({_grams_sql(n)}) AS g FROM aw)" for n in (1, 2, 3)))
def q_ngram_distinct(spark, sf_dir):
    a = X.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return scores.distinct_n(a, "text", 1).unionByName(scores.distinct_n(a, "text", 2)).unionByName(scores.distinct_n(a, "text", 3))


@query(f"WITH {_ANSWERS} " + " UNION ALL ".join(f"SELECT {n} AS n, count(*)::BIGINT AS rows, avg(1 - len(list_distinct(g)) / len(g)::DOUBLE) AS rate FROM (SELECT {_grams_sql(n)} AS g FROM aw WHERE len(w) >= {n})" for n in (2, 4)))
def q_repetition(spark, sf_dir):
    a = X.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return scores.repetition(a, "text", 2).unionByName(scores.repetition(a, "text", 4))


@query()
def q_rouge_l(spark, sf_dir):
    return scores.rouge_l(pairs(spark, sf_dir), "answer", "prompt").select("conv_id", "turn", "lcs", "precision", "recall", "f1")


_INTL = r"regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({0}, '(\P{{N}})(\p{{P}})', '\1 \2 ', 'g'), '(\p{{P}})(\P{{N}})', ' \1 \2', 'g'), '(\p{{S}})', ' \1 ', 'g'), '" + X.NOT_WS.replace("{", "{{").replace("}", "}}") + "+')"


def _clipped_sql(h: str, r: str, grams, orders) -> str:
    sides = " UNION ALL ".join(f"SELECT conv_id, turn, {n} AS n, '{s}' AS side, unnest({grams(n)}) AS g FROM (SELECT conv_id, turn, {x} AS w FROM pr)" for n in orders for s, x in (("h", h), ("r", r)))
    return f"""WITH {_PAIRS}, e AS ({sides}), c AS (SELECT n, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r FROM e GROUP BY conv_id, turn, n, g)
SELECT n, sum(least(h, r))::BIGINT AS matches, sum(h)::BIGINT AS hyp, sum(r)::BIGINT AS ref FROM c GROUP BY n"""


PAIR = ["conv_id", "turn"]


@query(_clipped_sql(_INTL.format("answer"), _INTL.format("prompt"), _grams_sql, (1, 2, 3, 4)))
def q_bleu_counts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return scores.clipped_matches(p, PAIR, scores.intl_tokens(F.col("answer")), scores.intl_tokens(F.col("prompt")), range(1, 5))


@query(_clipped_sql(f"string_split(regexp_replace(answer, '{X.WS}', '', 'g'), '')", f"string_split(regexp_replace(prompt, '{X.WS}', '', 'g'), '')", _grams_sql, range(1, 7)))
def q_chrf_counts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return scores.clipped_matches(p, PAIR, scores.chars(F.col("answer")), scores.chars(F.col("prompt")), range(1, 7))


@query()
def q_bleu_chrf(spark, sf_dir):
    b, c = q_bleu_counts(spark, sf_dir).collect(), q_chrf_counts(spark, sf_dir).collect()  # ten rows
    w = scores.clipped_matches(pairs(spark, sf_dir), PAIR, T.words(F.col("answer")), T.words(F.col("prompt")), range(1, 3)).collect()
    return spark.createDataFrame([(scores.bleu(b), scores.chrf(c), scores.chrf([*c, *w]))], "bleu double, chrf double, chrf_pp double")
