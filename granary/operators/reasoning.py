"""Synthetic comparison questions: pools, generators, leakage, answers and their scoring.

Draws are hashes of (seed, split, row, what), so any row can be made anywhere and again. Equality with another
generator's draws is no goal; balanced families, disjoint pools, unique ids and right answers are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import measures as M
from ..functions import text as T

PROMPT, ANSWER = "प्रश्न:", "उत्तर:"
FAMILIES = ["chain_pair_3", "chain_pair_4", "chain_superlative_3", "chain_superlative_4", "numeric_equality", "numeric_pair", "numeric_superlative_3", "numeric_superlative_4"]
SHARES = (("train", 0.6), ("validation", 0.2), ("test", 0.2))
NAMES = [a + b for a in ("राम", "गीत", "मोह", "सीम", "अनु", "दीप") for b in ("ा", "ेश", "न", "िका", "राज", "ल", "ी")]
#: attribute, statement, most, least, pair
CHAINS = [("height", "{a} {b} से लंबा है।", "सबसे लंबा कौन है?", "सबसे छोटा कौन है?", "{a} और {b} में से लंबा कौन है?"), ("speed", "{a} {b} से तेज है।", "सबसे तेज कौन है?", "सबसे धीमा कौन है?", "{a} और {b} में से तेज कौन है?")]
#: attribute, statement, most, least, pair, equal
NUMBERS = [("price", "{a} की कीमत {v} रुपये है।", "सबसे महँगा क्या है?", "सबसे सस्ता क्या है?", "{a} और {b} में से महँगा क्या है?", "क्या {a} और {b} की कीमत बराबर है?"), ("age", "{a} की उम्र {v} साल है।", "सबसे बड़ा कौन है?", "सबसे कम उम्र किसकी है?", "{a} और {b} में से बड़ा कौन है?", "क्या {a} और {b} की उम्र बराबर है?")]
LOW, HIGH = 10, 99
YES, NO = "हाँ", "नहीं"


def partition_pool(spark: SparkSession, names: list[str], seed: int = 1337) -> DataFrame:
    """(split, name): the pool in seeded order, cut at the rounded shares; the last split takes the rest. Pools are fixed lists."""
    n, cuts, upto = len(names), [], 0.0
    for split, share in SHARES[:-1]:
        upto += share
        cuts.append((split, round(n * upto)))
    d = spark.createDataFrame([(x,) for x in names], "name string")
    k = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "name"), "name"))
    split = F.lit(SHARES[-1][0])
    for name, cut in reversed(cuts):
        split = F.when(F.col("k") <= cut, name).otherwise(split)
    out = d.withColumn("k", k).withColumn("split", split).select("split", "name")
    small = [r["split"] for r in out.groupBy("split").count().where("count < 4").collect()]
    if small:
        raise ValueError(f"too few names in {small}")
    return out


def _draw(what: str, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64("seed", "split", "row", F.lit(what)), n).cast("int")


def _filled(pattern: Column, **values: Column) -> Column:
    for k, v in values.items():
        pattern = F.replace(pattern, F.lit("{" + k + "}"), v)
    return pattern


def _by(rows: list[tuple], i: int) -> Column:
    """Column i of the drawn attribute."""
    return F.element_at(F.array(*[F.lit(r[i]) for r in rows]), F.col("attr") + 1)


def generate(spark: SparkSession, counts: dict[str, int], seed: int = 1337) -> DataFrame:
    """Examples of each split, families in turn, ids unique within a split."""
    pool = partition_pool(spark, NAMES, seed).groupBy("split").agg(F.sort_array(F.collect_list("name")).alias("pool"))
    wanted = spark.createDataFrame(list(counts.items()), "split string, n int")
    rows = wanted.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n") * 2 - 1))).withColumn("seed", F.lit(seed)).join(F.broadcast(pool), "split")  # three rows
    d = rows.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("row") % 8 + 1)))
    d = d.withColumn("n_entities", F.when(F.col("family").endswith("_4"), 4).when(F.col("family").endswith("_3"), 3).otherwise(2))
    shuffled = F.array_sort(F.transform("pool", lambda x: F.struct(F.xxhash64("seed", "split", "row", x).alias("h"), x.alias("x"))))
    d = d.withColumn("entities", F.transform(F.slice(shuffled, F.lit(1), F.col("n_entities")), lambda s: s["x"]))
    d = d.withColumn("attr", _draw("attribute", 2)).withColumn("coin", _draw("coin", 2)).withColumn("flip", _draw("flip", 2))
    # distinct values: a seeded order of the range; the second of an equal pair repeats the first
    span = F.transform(F.sequence(F.lit(LOW), F.lit(HIGH)), lambda v: F.struct(F.xxhash64("seed", "split", "row", v).alias("h"), v.alias("v")))
    d = d.withColumn("values", F.transform(F.slice(F.array_sort(span), F.lit(1), F.col("n_entities")), lambda s: s["v"]))
    d = d.withColumn("values", F.when((F.col("family") == "numeric_equality") & (F.col("coin") == 1), F.array(F.get("values", 0), F.get("values", 0))).otherwise(F.col("values")))
    chain = F.col("family").startswith("chain")
    e, v, n = F.col("entities"), F.col("values"), F.col("n_entities")
    chained = F.transform(F.sequence(F.lit(0), n - 2), lambda i: _filled(_by(CHAINS, 1), a=F.get(e, i), b=T.oblique(F.get(e, i + 1))))
    stated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _filled(_by(NUMBERS, 1), a=T.oblique(F.get(e, i)), v=T.native_digits(F.get(v, i))))
    d = d.withColumn("premises", F.when(chain, chained).otherwise(stated))
    # pairs of a chain that no premise names together: (0,2) of three; (0,2) (1,3) (0,3) of four
    i = F.when((n == 4) & (_draw("pair", 3) == 1), 1).otherwise(0)
    j = F.when(n == 3, 2).when(_draw("pair", 3) == 0, 2).otherwise(3)
    first, second = F.get(e, i), F.get(e, j)
    ask_chain = _filled(_by(CHAINS, 4), a=T.oblique(F.when(F.col("flip") == 0, first).otherwise(second)), b=T.oblique(F.when(F.col("flip") == 0, second).otherwise(first)))
    a, b = F.get(e, 0), F.get(e, 1)
    high = F.get(e, (F.array_position(v, F.array_max(v)) - 1).cast("int"))
    low = F.get(e, (F.array_position(v, F.array_min(v)) - 1).cast("int"))
    most = F.col("coin") == 0
    kinds = [
        ("chain_pair", "chain_pair", ask_chain, first, j - i),
        ("chain_superlative", None, F.when(most, _by(CHAINS, 2)).otherwise(_by(CHAINS, 3)), F.when(most, F.get(e, 0)).otherwise(F.get(e, n - 1)), n - 1),
        ("numeric_equality", "numeric_equality", _filled(_by(NUMBERS, 5), a=T.oblique(a), b=T.oblique(b)), F.when(F.col("coin") == 1, YES).otherwise(NO), F.lit(1)),
        ("numeric_pair", "numeric_pair", _filled(_by(NUMBERS, 4), a=T.oblique(a), b=T.oblique(b)), high, F.lit(1)),
        ("numeric_superlative", None, F.when(most, _by(NUMBERS, 2)).otherwise(_by(NUMBERS, 3)), F.when(most, high).otherwise(low), F.lit(1)),
    ]

    def pick(k: int) -> Column:
        out = F.lit(None)
        for kind in kinds:
            value = kind[k] if kind[k] is not None else F.concat(F.lit(kind[0] + "_"), F.when(most, "most").otherwise("least"))
            out = F.when(F.col("family").startswith(kind[0]), F.lit(value) if isinstance(value, str) else value).otherwise(out)
        return out

    d = d.withColumn("template", pick(1)).withColumn("question", pick(2)).withColumn("answer", pick(3)).withColumn("hops", pick(4).cast("int"))
    d = d.withColumn("attribute", F.when(chain, _by(CHAINS, 0)).otherwise(_by(NUMBERS, 0)))
    order = F.array_sort(F.transform("premises", lambda p: F.struct(F.xxhash64("seed", "split", "row", p, F.lit("order")).alias("h"), p.alias("p"))))
    body = F.array_join(F.concat(F.transform(order, lambda s: s["p"]), F.array("question")), " ")
    d = d.withColumn("prompt", F.concat(F.lit(PROMPT + " "), body, F.lit("\n" + ANSWER)))
    d = d.withColumn("example_id", T.content_hash(F.col("prompt")))
    # twice as many rows are drawn as wanted; repeated prompts go, and each family keeps its share
    d = d.withColumn("again", F.row_number().over(Window.partitionBy("split", "example_id").orderBy("row"))).where("again = 1")
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("split", "family").orderBy("row"))).where(F.col("k") <= F.ceil(F.col("n") / 8))
    # a family that can't be filled is an error, not a shorter result
    have = F.count(F.lit(1)).over(Window.partitionBy("split", "family"))
    d = d.withColumn("k", F.when(have >= F.ceil(F.col("n") / 8), F.col("k")).otherwise(F.raise_error(F.concat(F.lit("too few distinct examples: "), "split", F.lit(" "), "family")).cast("int"))).where("k > 0")
    return d.select("split", "family", "example_id", "template", "attribute", "n_entities", "hops", "prompt", "answer", "entities", "values")


def text_view(examples: DataFrame) -> DataFrame:
    """Adds text, the prompt with its answer; it is derived and never stored."""
    return examples.withColumn("text", F.concat_ws(" ", "prompt", "answer"))


def describe(examples: DataFrame) -> DataFrame:
    length = F.length("prompt")
    return examples.groupBy("split", "template").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("answer").alias("answers"), F.min(length).alias("shortest"), F.avg(length).alias("mean_length"), F.max(length).alias("longest"),
        F.count_if(F.col("answer") == YES).alias("yes"),
    )


def leakage(examples: DataFrame) -> DataFrame:
    """(what, a, b, shared) for every two splits: names and prompts they have in common."""
    names = examples.select("split", F.explode("entities").alias("v")).withColumn("what", F.lit("name"))
    every = names.unionByName(examples.select("split", F.col("prompt").alias("v"), F.lit("prompt").alias("what"))).distinct()
    both = every.groupBy("what", "v").agg(F.sort_array(F.collect_set("split")).alias("s"))  # three splits at most
    s = F.col("s")
    later = lambda i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(F.get(s, i).alias("a"), b.alias("b")))
    found = both.where(F.size("s") > 1).select("what", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 2), later))).alias("p"))
    counts = found.groupBy("what", "p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    spark = examples.sparkSession
    grid = spark.createDataFrame([(w, a, b) for w in ("name", "prompt") for a, b in (("test", "train"), ("test", "validation"), ("train", "validation"))], "what string, a string, b string")
    return grid.join(counts, ["what", "a", "b"], "left").fillna(0, ["shared"])


def scored(rows: DataFrame) -> DataFrame:
    """rows: examples with prediction. Adds first_word, strict, lenient, first_word_match and chance."""
    d = rows.withColumn("prediction", T.normal_answer(F.col("prediction")))
    d = d.withColumn("first_word", T.normal_answer(F.coalesce(F.get(T.words(F.col("prediction")), 0), F.lit(""))))
    ok = T.oblique_variants(F.col("answer"))
    return d.withColumns({
        "strict": F.col("prediction") == F.col("answer"), "lenient": F.array_contains(ok, F.col("prediction")),
        "first_word_match": F.array_contains(ok, F.col("first_word")), "chance": M.chance_level(F.col("template"), F.col("n_entities")),
    })


def triage(rows: DataFrame) -> DataFrame:
    """Adds class: success, wrong_entity (names something of the prompt) or off_format."""
    named = (F.col("first_word") != "") & F.contains("prompt", "first_word")
    return rows.withColumn("class", F.when(F.col("lenient"), "success").when(named, "wrong_entity").otherwise("off_format"))
