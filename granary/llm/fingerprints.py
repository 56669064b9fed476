"""Document fingerprints by SpotSigs [native].

An anchor (a common word of one of four languages) starts a chain of the ``chain`` content words that follow it; common
words between are passed over, and neither they nor the kind of white space are part of the chain. The set of a text's chains, hashed to 64 bits, is its fingerprint. Two texts are as
alike as the Jaccard similarity of their sets; ``similar_pairs`` finds pairs by partitioning the sets by length, where
sets whose lengths differ by more than the threshold are never met.

Chains come from one regular expression over the text, a look-ahead whose group is the chain with what stands between, so
chains overlap freely and only chains, not words, become rows of an array. Of anchors in a row only the last is matched, as
all start the same chain.

Defined results: null text is the empty text; a text without chains has the empty set, and two empty sets have
likeness 1 only if their texts are equal, else 0. Rows of one id share the text that sorts first; null ids come last
in the ring of neighbours. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, shuffle_parts, table

#: Common words: English, German, French, Spanish.
ANCHORS = (
    "the of and to in a is that it for on was with as by this are at from or be an have not they his her has had but were which "
    "der die das und ist von den des zu mit auf ein eine im dem nicht auch sich als "
    "le la les un une de du et est que dans pour qui sur par au aux ne pas avec "
    "el los las y en por con para del se una su al lo como más o"
).split()
CHAIN = 2
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def chain_pattern(anchors: list[str], chain: int) -> str:
    stop = f"(?:{'|'.join(sorted(set(anchors)))})"
    common = rf"(?:{stop}{GAP})*+"  # a content word is no anchor, so nothing is given back
    content = rf"(?!{stop}(?![^\x20\x09-\x0D])){WORD}"
    return rf"(?<![^\x20\x09-\x0D])(?={stop}{GAP}({content}(?:{GAP}{common}{content}){{{chain - 1}}}))"


def spots(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """The distinct chains of a text, as sorted 64-bit hashes of their content words with one space between."""
    anchors = sorted(set(anchors or ANCHORS))
    found = F.regexp_extract_all(ascii_lower(text), F.lit(chain_pattern(anchors, chain)), F.lit(1))
    content = lambda s: F.array_join(F.filter(F.split(s, GAP), lambda w: ~w.isin(anchors)), " ")
    return F.sort_array(F.array_distinct(F.transform(F.array_distinct(found), lambda s: F.xxhash64(content(s)))))


def digest(spots_col: Column) -> Column:
    """The set as one value: its size and a hash of all its elements."""
    return F.concat_ws(":", F.size(spots_col), F.sha2(F.array_join(spots_col.cast("array<string>"), ","), 256))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Jaccard similarity of two sets. same: whether the texts are equal, for sets without elements."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.when(same, 1.0).otherwise(0.0))


def part_of(c: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at or below c: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def with_next(d: DataFrame, id_col: str, columns: list[str], derived: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Adds the derived columns and next_<column> of the row with the next lower id; after the lowest comes the highest.

    Ids are cut at about equal counts (approximate percentiles); a window runs within each part, and each part has one
    more row, a copy of the first row of the part below, so that no row looks over the edge. Rows are dealt out once.
    """
    parts = parts or min(1024, 4 * shuffle_parts(d.sparkSession))
    c = F.col(id_col)
    cuts = d.agg(F.percentile_approx(c, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    d = d.withColumn("_part", F.when(c.isNull(), F.lit(-1)).otherwise(part_of(c, sorted(set(cuts)))))
    order = F.struct(*[F.col(x) for x in columns])
    tops = d.groupBy("_part").agg(F.max(c).alias("_top"))
    # at most parts + 1 rows, so they may be broadcast; only their texts are then dealt out
    heads = d.join(F.broadcast(tops.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & c.eqNullSafe(F.col("_top")))
    heads = heads.groupBy("_part").agg(F.min(order).alias("_head"))
    ring = Window.orderBy("_part")  # a row a part
    ends = Window.partitionBy()
    ghosts = heads.select(
        "_part", F.coalesce(F.lag("_head").over(ring), F.max_by("_head", "_part").over(ends)).alias("_head")
    ).select("_part", F.lit(True).alias("_ghost"), "_head.*")
    every = d.withColumn("_ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True).withColumns(derived)
    down = Window.partitionBy("_part").orderBy("_ghost", c.desc_nulls_last(), *columns)
    for x in [*columns, *derived]:
        every = every.withColumn(f"next_{x}", F.lead(x).over(down))
    return every.where(~F.col("_ghost")).drop("_part", "_ghost")


def edited(text: Column, following: Column) -> Column:
    """text with its last third replaced by as many code points from the start of the following text (or all it has)."""
    n = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - n), F.substring(following, F.lit(1), n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, spots)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), spots(text, **how).alias("spots"))


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """prints: (id, spots). (a, b, similarity) between classes of equal sets, each named by its smallest id.

    Sets lie in partitions of length: a set meets only its own and the next longer partition, as no other can be similar
    enough. Within them sets meet at the rarest chains of either (n - threshold * n + 1 of n), which a similar pair
    must share, so frequent chains pair nothing.
    """
    sets = prints.where(F.size("spots") > 0).groupBy("spots").agg(F.min("id").alias("id")).withColumn("n", F.size("spots"))
    each = sets.select("id", "n", F.explode("spots").alias("spot"))
    rare = each.groupBy("spot").count()
    ranked = each.join(rare, "spot").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("count", "spot"))).alias("r"))
    first = F.expr("slice(r, 1, n - cast(ceil(%r * n - 1e-9) as int) + 1)" % threshold)
    bucket = F.floor(F.log("n") / -F.log(F.lit(threshold)) + 1e-9)
    keys = ranked.select("id", "n", bucket.alias("bucket"), F.explode(first).alias("k")).select("id", "n", "bucket", F.col("k.spot").alias("spot"))
    longer = keys.select(F.col("id").alias("id2"), F.col("n").alias("n2"), F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"), "spot")
    met = keys.join(longer, ["bucket", "spot"]).where((F.col("n") <= F.col("n2")) & (F.col("id") != F.col("id2")) & (F.col("n") >= F.col("n2") * threshold - 1e-9))
    met = met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    full = met.join(sets.select(F.col("id").alias("a"), F.col("spots").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("spots").alias("y")), "b")
    return full.select("a", "b", likeness(F.col("x"), F.col("y"), F.lit(True)).alias("similarity")).where(F.col("similarity") >= threshold)


def op10_spotsigs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(docs, "doc_id", ["doc_id", "text"], {"spots": spots(F.col("text"))})
    near = near.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    near = near.withColumn("edited_spots", spots(F.col("edited")))
    return near.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("spots")).alias("fingerprint"), digest(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots"), F.col("text") == F.col("next_text")).alias("near_next"),
    )
