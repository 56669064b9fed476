"""Collection, language, generation and report operators whose behaviour SQL over the tables doesn't show."""

import math

import pytest
from pyspark.sql import functions as F

from granary.operators import boilerplate, langid, lineage, reasoning, scores, skew
from granary.sources import readers as R
from granary.streaming import incremental as I


def test_leakage_takes_every_pair_of_splits(spark):
    rows = [("train", ["a", "b"], "p1"), ("validation", ["a", "c"], "p1"), ("test", ["a", "b"], "p2")]
    got = {(r["what"], r["a"], r["b"]): r["shared"] for r in reasoning.leakage(spark.createDataFrame(rows, "split string, entities array<string>, prompt string")).collect()}
    assert got == {("name", "test", "train"): 2, ("name", "test", "validation"): 1, ("name", "train", "validation"): 1, ("prompt", "test", "train"): 0, ("prompt", "test", "validation"): 0, ("prompt", "train", "validation"): 1}


def test_generation_fails_when_a_family_is_short(spark):
    assert reasoning.text_view(reasoning.generate(spark, {"train": 16})).where("text = concat(prompt, ' ', answer)").count() == 16
    with pytest.raises(Exception, match="too few distinct examples"):
        reasoning.generate(spark, {"test": 400_000}).count()


def test_language_by_broadcast_equals_the_join(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    d = d.unionByName(spark.createDataFrame([(-1, "en", None), (-2, "en", "short"), (-3, "en", "\u4f60" * 50)], "doc_id long, lang string, text string"))
    model = langid.train(d.where("doc_id % 2 = 0")).cache()
    one, other = ({r["doc_id"]: (r["predicted"], round(r["confidence"], 9)) for r in langid.predict(d, model, most=most).collect()} for most in (10**6, 0))
    assert one == other and one[-1] == one[-2] == one[-3] == ("unknown", 0.0)
    assert {r["predicted"] for r in langid.predict(d, model.where("false")).collect()} == {"unknown"}


def test_lines_of_heavy_hashes_are_dropped_too(spark):
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("same\n"), F.when(F.col("id") % 40 == 0, "rare\n").otherwise(""), F.concat(F.lit("own"), "id")).alias("text"))
    got = boilerplate.drop_lines(d, boilerplate.line_counts(d).where("n >= 5")).collect()
    assert all(r["kept"] == f"own{r['doc_id']}" and r["dropped"] == 1 + (r["doc_id"] % 40 == 0) for r in got)
    none = boilerplate.drop_lines(d, boilerplate.line_counts(d).where("n > 1000"))
    assert none.where("dropped > 0 OR kept <> text").count() == 0


def test_spread_join_is_a_left_join(spark):
    left = spark.range(1000).select((F.col("id") % 7 % 3).alias("k"), F.lit(1).cast("long").alias("j"), "id")
    right = spark.createDataFrame([(0, 1, "a", 500), (2, 1, None, 200), (9, 1, "z", 1)], "k long, j long, v string, n long")
    for heavy in (right.where("false"), skew.heavy_keys(right, "n", 701), right):
        got = skew.spread_join(left, right, ["k", "j"], heavy, F.xxhash64("id"))
        want = left.join(right, ["k", "j"], "left").select(*got.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_missing_files_are_no_errors(spark, tmp_path):
    assert R.landed_records(spark, f"{tmp_path}/nowhere", "body") is None
    spark.createDataFrame([("t", 5), (None, 6)], "body string, url int").write.parquet(f"{tmp_path}/landed")
    assert sorted(R.landed_records(spark, f"{tmp_path}/landed", "body").collect(), key=lambda r: r[0] or "") == [(None, ""), ("t", "")]
    assert R.landed_records(spark, f"{tmp_path}/landed", "url").where("text IS NOT NULL").count() == 0  # no text field
    assert R.read_artifact(spark, f"{tmp_path}/nothing.json", "loss double, name string").collect() == [(None, None)]
    (tmp_path / "one.json").write_text('{\n "loss": 1.5,\n "name": "\u0915"\n}', encoding="utf-8")
    assert R.read_artifact(spark, f"{tmp_path}/one.json", "loss double, name string").collect() == [(1.5, "\u0915")]


def test_sinks_of_stats_and_examples(spark, tmp_path):
    R.write_stats(spark.createDataFrame([("\u0915\u093e", 2)], "lang string, n int"), f"{tmp_path}/stats")
    (part,) = (tmp_path / "stats").glob("part-*.json")
    assert part.read_text(encoding="utf-8") == '{"lang":"\u0915\u093e","n":2}\n'
    e = reasoning.text_view(reasoning.generate(spark, {"train": 8, "test": 8}))
    R.write_examples(e, f"{tmp_path}/examples")
    back = spark.read.json(f"{tmp_path}/examples")
    assert back.count() == 16 and "text" not in back.columns and {r["split"] for r in back.select("split").distinct().collect()} == {"train", "test"}


def test_pairs_of_predictions_must_be_whole(spark):
    p, r = (spark.createDataFrame([(i, f"{c}{i}") for i in range(4)], f"k int, {c} string") for c in ("p", "r"))
    assert scores.paired(p, r, "k").count() == 4
    for a, b in ((p.where("k > 0"), r), (p, r.where("k > 0"))):
        with pytest.raises(Exception, match="no counterpart of 0"):
            scores.paired(a, b, "k").collect()


def test_common_prefix(spark):
    rows = [(["a", "b"], ["a", "b", "c"], 2), ([], ["a"], 0), (["a"], ["b"], 0), (["a", None], ["a", None], 2), (["a", "x", "c"], ["a", "y", "c"], 1)]
    d = spark.createDataFrame(rows, "a array<string>, b array<string>, want int")
    assert all(r["got"] == r["want"] for r in d.withColumn("got", scores.common_prefix(F.col("a"), F.col("b"))).collect())


def test_walk_of_a_graph_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in R.bfs(edges, roots, 9, 100).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in R.bfs(edges, roots, 1, 100).collect()} == {("a", 0), ("b", 1)}
    assert R.bfs(edges, roots, 9, 3).count() == 3 and R.bfs(edges, roots.where("false"), 9, 3).count() == 0


def test_stalled_pages(spark):
    posts = spark.createDataFrame([("s", 5, i) for i in range(6)] + [("s", 9, 7)], "source string, day int, id int")
    got = [tuple(r) for r in R.date_pages(posts, "source", "day", "id", 3).orderBy("page").collect()]
    assert got == [("s", 0, 3, 5, False), ("s", 1, 3, 5, True), ("s", 2, 1, 5, True)]


def test_metric_log_is_append_only(spark, tmp_path):
    for step in (1, 2):
        spark.createDataFrame([(step, 1.0 / step)], "step long, loss double").write.mode("append").parquet(f"{tmp_path}/in")
        q = I.append_metrics(I.document_stream(spark, f"{tmp_path}/in", "step long, loss double"), f"{tmp_path}/log", f"{tmp_path}/ck")
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/log").select("step", "loss").collect())) == [(1, 1.0), (2, 0.5)]
    q = I.document_stream(spark, f"{tmp_path}/in", "step long, loss double").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck2").start()
    I.stop_after_batch(q)
    assert not q.isActive and q.exception() is None


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session)


def test_languages_are_predicted_where_texts_are_read(spark):
    """each trigram was a row of its own in training, and texts were read twice to join the languages back."""
    from granary.plans.evaluation import languages

    d = languages(spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan and d.count() == 200
    s = "a\U0001f600\U0010ffff\x00é\nक"
    assert langid.grams(langid.codes(s)) == [s[i : i + 3] for i in range(5)]
    rows = [("x", s * 5), ("y", "b" * 20), ("y", "c" * 19), ("x", None)]
    counts = {(r["lang"], r["gram"]): round(r["logp"], 9) for r in langid.train(spark.createDataFrame(rows, "lang string, text string")).collect()}
    grams = {(s * 5).replace("\n", " ")[i : i + 3] for i in range(33)} | {"bbb"}
    assert {g for _, g in counts} == grams and counts["y", "bbb"] == round(math.log(19 / (18 + len(grams))), 9)


def test_records_are_cleaned_once(spark):
    """F4 to F8: the filters behind the cleaning ran it again for every mention of the text."""
    d = spark.createDataFrame([(1, "ab", None)], "k long, text string, url string")
    plan = R.record_documents(d, "text", "url", "[a-z]")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sponsored") + plan.count("Sponsored") == 1


def test_lines_are_dropped_where_texts_are_read(spark):
    """No text is shuffled and no row made for each line; long lists are joined, with the same results."""
    from granary.plans.catalog import QUERIES

    texts = ["a\n\xa0b \nc", "b\n\nb\x1c", None, "", "\n", " a\n b　\n​b", "only\r\n", "a"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = {r["hash"]: r["n"] for r in boilerplate.line_counts(d).collect()}
    assert {r["hash"]: r["n"] for r in boilerplate.hash_counts(d).collect()} == counts and sorted(counts.values()) == [1, 1, 1, 3, 4]
    for least in (1, 3, 4, 99):
        hot = boilerplate.hash_counts(d).where(F.col("n") >= least)
        here, joined = ([tuple(r) for r in boilerplate.drop_lines(d, hot, most=most).orderBy("doc_id").collect()] for most in (100, 0))
        assert here == joined
    assert [r["kept"] for r in boilerplate.drop_lines(d, boilerplate.hash_counts(d).where("n >= 3")).orderBy("doc_id").collect()] == ["c", "", None, "", "\n", "​b", "only\r\n", ""]
    plan = QUERIES["q_drop_boilerplate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan
