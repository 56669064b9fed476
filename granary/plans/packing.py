"""Queries of the packed stream, its windows, padded batches, and token measures by split."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import packing
from . import fixtures as X
from .cleaning import _SPLITS
from .corpus import _PACK, _PAIRS, masked, pairs
from .evaluation import _ATT, attention
from .registry import query

_STREAM = f"""{_PACK}, tl AS (SELECT doc_id, start, list_append(regexp_extract_all(text, '{X.NOT_WS}+'), '{packing.END}') AS w FROM o),
st AS (SELECT doc_id, (start + generate_subscripts(w, 1) - 1)::BIGINT AS pos, unnest(w) AS token FROM tl)"""


def ordered(spark, sf_dir: str):
    return X.documents(spark, sf_dir).where("text <> ''").select("doc_id", (F.col("source_type") == "downloaded").alias("later"), "source", "text")


def stream(spark, sf_dir: str):
    return packing.token_stream(ordered(spark, sf_dir), T.words(F.col("text")), ["later", "source"], "doc_id")


@query(f"WITH {_STREAM} SELECT doc_id, pos, token FROM st")
def q_token_stream(spark, sf_dir):
    """The packed stream itself, every token with its place."""
    return stream(spark, sf_dir)


@query(f"""WITH {_STREAM}, z AS (SELECT pos // 512 AS win, pos % 512 AS i, token FROM st UNION ALL SELECT pos // 512 - 1, 512, token FROM st WHERE pos % 512 = 0 AND pos > 0)
SELECT win, (win // 16)::BIGINT AS batch, sha1(string_agg(token, ' ' ORDER BY i) FILTER (WHERE i < 512)) AS inputs_sha, sha1(string_agg(token, ' ' ORDER BY i) FILTER (WHERE i > 0)) AS targets_sha
FROM z WHERE win < ((SELECT count(*) FROM st) - 1) // 512 // 16 * 16 GROUP BY win""")
def q_token_windows(spark, sf_dir):
    """Windows of 512 tokens in batches of 16, with their targets one token later."""
    w = packing.packed_windows(ordered(spark, sf_dir), "text", ["later", "source"], "doc_id", 512, 16)
    return w.select("win", "batch", *[F.sha1(c).alias(f"{c}_sha") for c in ("inputs", "targets")])


@query(f"""WITH {_PAIRS}, t AS (SELECT *, regexp_extract_all(prompt, '{X.NOT_WS}+') AS a, regexp_extract_all(answer, '{X.NOT_WS}+') AS b, conv_id // 64 AS shard FROM pr),
e AS (SELECT *, len(a) + len(b) AS n, list_concat(a, b) AS ids, list_concat(list_transform(a, lambda x: '-100'), b) AS labels FROM t),
g AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY n, conv_id, turn) - 1) // 8 AS batch FROM e), m AS (SELECT *, max(n) OVER (PARTITION BY shard, batch) AS width FROM g WHERE n <= 400)
SELECT shard, batch::BIGINT AS batch, conv_id, turn, width::INT AS width, sha1(array_to_string(list_resize(ids, width, '<pad>'), ' ')) AS ids_sha, sha1(array_to_string(list_resize(labels, width, '-100'), ' ')) AS labels_sha FROM m""")
def q_padded_rows(spark, sf_dir):
    """The rows of batches of 8 of like length as they are fed, padded to the longest of the batch."""
    d = masked(pairs(spark, sf_dir)).withColumn("n", F.size("ids")).withColumn("shard", F.floor(F.col("conv_id") / 64))
    d = d.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("shard").orderBy("n", "conv_id", "turn")) - 1) / 8)).where("n <= 400")
    p = packing.padded(d, "ids", "labels", ["shard", "batch"], "<pad>")
    return p.select("shard", "batch", "conv_id", "turn", "width", *[F.sha1(F.array_join(c, " ")).alias(f"{c}_sha") for c in ("ids", "labels")])


@query(f"""WITH {_SPLITS} SELECT split, source_type, count(*)::BIGINT AS docs, sum({X.n_words('text')})::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes
FROM sp GROUP BY GROUPING SETS ((split), (split, source_type))""")
def q_split_tokens(spark, sf_dir):
    """All words, characters and bytes of each split and kind of source (not only those of prose lines)."""
    t = F.col("text")
    d = X.documents(spark, sf_dir).select("source_type", T.assign_split(T.content_hash(t)).alias("split"), T.word_count(t).alias("w"), F.length(t).alias("c"), F.octet_length(t).alias("b"))
    g = d.groupingSets([["split"], ["split", "source_type"]], "split", "source_type")
    return g.agg(F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.sum("b").alias("bytes"))


@query(f"WITH {_ATT} SELECT layer, head, round(normalised, 9) AS normalised FROM s WHERE head > 0 ORDER BY round(normalised, 9), layer, head LIMIT 1")
def q_least_entropy_head(spark, sf_dir):
    """The head of the least entropy among those that look beyond the token itself."""
    a = attention(spark).where("head > 0").select("layer", "head", F.round("normalised", 9).alias("normalised"))
    return a.orderBy("normalised", "layer", "head").limit(1)
