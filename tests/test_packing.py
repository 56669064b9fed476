"""The cleaning chain and the packed stream on cases that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chain, langid, packing

WORDS = "the old house by the river stood empty for many years until".split()


def test_chain_gives_each_document_its_first_reason(spark):
    page = lambda i: "\n".join(" ".join([*WORDS, f"{w}{i}"]) for w in "abcdefghijkl")
    rows = [(1, "manual", page(1)), (2, "downloaded", page(1)), (3, "downloaded", page(1) + "\nshort end"), (4, "manual", "too short"), (5, "manual", None), (6, "manual", ""), (7, "manual", page(7))]
    d = spark.createDataFrame(rows, "doc_id long, source_type string, text string")
    model = langid.train(spark.createDataFrame([("en", page(0))], "lang string, text string"))
    order = [F.col("source_type") == "downloaded", F.col("doc_id")]
    got = {r["doc_id"]: r["status"] for r in chain.outcomes(chain.filtered(d, least=100), model, "en", order).collect()}
    # Latin lines of four words or more are foreign to the chain: none is left
    assert set(got.values()) == {"removed_quality"}
    nagari = d.withColumn("text", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "कखगघङचछजझञटठडढणतथदधनपफबभमय"))
    own = langid.train(nagari.where("doc_id = 1").withColumn("lang", F.lit("en")))
    got = {r["doc_id"]: r["status"] for r in chain.outcomes(chain.filtered(nagari, least=100), own, "en", order).collect()}
    assert got == {1: "kept", 2: "removed_exact", 3: "removed_near", 4: "removed_quality", 5: "removed_quality", 6: "removed_quality", 7: "kept"}
    other = chain.outcomes(chain.filtered(nagari, least=100), own, "de", order)
    assert {r["status"] for r in other.where("good").collect()} == {"removed_language"} and other.count() == 7
    assert chain.outcomes(chain.filtered(nagari.where("false")), own, "en", order).count() == 0


def test_stream_and_windows_by_hand(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", "x y"), (1, "b", ""), (5, "a", "p q r"), (9, "b", "z")], "doc_id long, source string, text string")
    s = packing.token_stream(d, T.words(F.col("text")), ["source"], "doc_id")
    want = "p q r <end> <end> x y <end> z <end>".split()
    assert [(r["pos"], r["token"]) for r in s.orderBy("pos").collect()] == list(enumerate(want))
    got = packing.windows(s, len(want), 2, 2).orderBy("win").collect()
    assert [(r["win"], r["batch"], r["inputs"], r["targets"]) for r in got] == [(i, i // 2, want[2 * i : 2 * i + 2], want[2 * i + 1 : 2 * i + 3]) for i in range(4)]
    assert packing.windows(s, len(want), 2, 3).count() == 3 and packing.windows(s.where("false"), 0, 2, 3).count() == 0
    packing.write_stream(s, f"{tmp_path}/stream", len(want))
    assert spark.read.parquet(f"{tmp_path}/stream").count() == len(want)
    with pytest.raises(ValueError, match="11 expected"):
        packing.write_stream(s, f"{tmp_path}/short", 11)


def test_windows_are_cut_from_whole_texts(spark):
    """The same windows as from the token stream, without a row for each token."""
    from granary.plans.catalog import QUERIES

    long = " ".join(f"w{i}" for i in range(23))
    rows = [(2, "b", long), (1, "b", ""), (None, "b", "n o"), (1, None, "x y\x1cz\n"), (5, "a", " p q\tr "), (9, "b", None), (10_000, "b", "a b c"), (3, "a", long), (4, "a", "one")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    s = packing.token_stream(d.where("text is not null"), T.words(F.col("text")), ["source"], "doc_id")
    for width, batch in ((1, 1), (2, 3), (4, 2), (7, 1), (100, 1)):
        want = [(r["win"], r["batch"], " ".join(r["inputs"]), " ".join(r["targets"])) for r in packing.windows(s, s.count(), width, batch).orderBy("win").collect()]
        got = packing.packed_windows(d, "text", ["source"], "doc_id", width, batch)
        assert [tuple(r) for r in got.orderBy("win").collect()] == want and (want or width == 100)
    assert packing.packed_windows(d.where("false"), "text", ["source"], "doc_id", 2, 1).count() == 0
    plan = QUERIES["q_token_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
