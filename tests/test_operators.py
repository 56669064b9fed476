"""Operators against hand-made cases and sequential re-computation."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import dedup, reasoning, scores, vocab
from granary.operators.running import exclusive_sum
from granary.sources import readers as R
from granary.streaming import incremental as I


def sequential(rows):
    exact, prefix, out = set(), set(), {}
    for i, p, e in rows:
        if e in exact:
            out[i] = "removed_exact"
        elif p in prefix:
            out[i] = "removed_near"
        else:
            out[i] = "kept"
            exact.add(e)
            prefix.add(p)
    return out


def test_dedup_equals_the_sequential_loop(spark):
    rng = random.Random(5)
    rows = [(i, f"p{(k := rng.randrange(60)) % 20}", f"p{k % 20}e{k}") for i in range(500)]
    d = spark.createDataFrame(rows, "i int, p string, e string").repartition(5)
    got = {r["i"]: r["status"] for r in dedup.dedup_status(d, F.col("e"), F.col("p"), [F.col("i")]).collect()}
    assert got == sequential(rows)
    rows = [(0, "p", "x"), (1, "p", "y"), (2, "p", "y"), (3, "p", "x"), (4, "q", "z")]
    d = spark.createDataFrame(rows, "i int, p string, e string")
    got = [r["status"] for r in dedup.dedup_status(d, F.col("e"), F.col("p"), [F.col("i")]).orderBy("i").collect()]
    assert got == ["kept", "removed_near", "removed_near", "removed_exact", "kept"]


def test_budget_keeps_the_crossing_document(spark):
    d = spark.createDataFrame([(0, 1, 60), (0, 2, 50), (0, 3, 10)], "pr int, i int, n long")
    assert [r["i"] for r in dedup.budget_cut(d, "n", ["pr"], "i", 100).orderBy("i").collect()] == [1, 2]


def test_running_sum_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, rng.randrange(9)) for i in range(300)]
    got = {r["i"]: r["s"] for r in exclusive_sum(spark.createDataFrame(rows, "m string, i int, v long"), "v", ["m"], "i", "s", step=16).collect()}
    total = 0
    for _, i, v in sorted(rows):
        assert got[i] == total
        total += v


def test_rouge(spark):
    r = scores.rouge_l(spark.createDataFrame([("the cat sat on the mat", "the cat lay on a mat")], "h string, r string"), "h", "r").first()
    assert (r["lcs"], round(r["f1"], 6)) == (4, 0.666667)


def test_bleu_and_chrf_of_equal_and_different_texts(spark):
    same = [{"n": n, "matches": 9, "hyp": 9, "ref": 9} for n in range(1, 5)]
    assert round(scores.bleu(same), 6) == 100 and round(scores.chrf(same), 6) == 100
    none = [{"n": n, "matches": 0, "hyp": 9, "ref": 9} for n in range(1, 5)]
    assert scores.bleu(none) < 5 and scores.chrf(none) == 0


def test_bpe_round_trip(spark):
    words = spark.createDataFrame([("lower", 9), ("lowest", 5), ("newer", 7), ("wider", 3)], "word string, n long")
    pieces = vocab.train_bpe(words, 290, coverage=1.0)
    assert pieces == vocab.train_bpe(words.repartition(3), 290, coverage=1.0) and pieces[:4] == vocab.SPECIALS and len(set(pieces)) == len(pieces)
    rank = {p: i for i, p in enumerate(pieces) if i >= 260}
    assert "".join(pieces[i] for i in vocab.encode_word("lower", rank)) == "▁lower"
    assert [pieces[i] for i in vocab.encode_word("é", rank)][-2:] == ["<0xC3>", "<0xA9>"]


def test_bpe_learns_from_all_words(spark):
    words = spark.range(210_000).selectExpr("concat('w', lpad(id, 6, '0')) as word", "3L as n").unionByName(spark.createDataFrame([("éé", 1)], "word string, n long"))
    assert "é" in vocab.train_bpe(words, 290, coverage=1.0)
    some = [(f"{a}{b}{c}", 3) for a in "abcdefghijklmnopqrst" for b in "uvwxyzabcdefghijklmn" for c in range(55)]
    # brute force: all pairs counted anew before each merge
    split, merges = [(list(vocab.MARK + w), n) for w, n in some[::40] + [("aaaa", 9), ("aaa", 5)]], []
    few = spark.createDataFrame(some[::40] + [("aaaa", 9), ("aaa", 5)], "word string, n long").repartition(3)
    for _ in range(30):
        pairs = {}
        for s, n in split:
            for p in zip(s, s[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append("".join(best))
        for s, _ in split:
            k = 0
            while k < len(s) - 1:
                if (s[k], s[k + 1]) == best:
                    s[k : k + 2] = ["".join(best)]
                k += 1
    assert vocab.train_bpe(few, 600, coverage=1.0)[260:290] == merges


def test_training_lines_up_to_a_limit(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of the document {i}" for j in range(30))) for i in range(60)], "doc_id long, text string")
    whole = {r["line"] for r in vocab.training_lines(docs).collect()}
    for limit in (0, 1, 100, len(whole) - 1, len(whole), len(whole) + 1):
        got = [r["line"] for r in vocab.training_lines(docs.repartition(5), limit=limit).collect()]
        assert len(got) == min(limit, len(whole)) and set(got) <= whole
        assert sorted(got) == sorted(r["line"] for r in vocab.training_lines(docs.repartition(2).orderBy("text"), limit=limit).collect())


def test_reasoning_answers_follow_from_the_premises(spark):
    rows = reasoning.generate(spark, {"train": 160, "validation": 16, "test": 16}).collect()
    assert len({(r["split"], r["example_id"]) for r in rows}) == len(rows)
    for r in rows:
        e, v = r["entities"], r["values"]
        if r["template"] == "numeric_equality":
            assert r["answer"] == (reasoning.YES if v[0] == v[1] else reasoning.NO)
        elif r["template"] in ("numeric_pair", "numeric_superlative_most"):
            assert r["answer"] == e[v.index(max(v))] and len(set(v)) == len(v)
        elif r["template"] == "numeric_superlative_least":
            assert r["answer"] == e[v.index(min(v))]
        elif r["template"] == "chain_superlative_least":
            assert r["answer"] == e[-1]
        else:
            assert r["answer"] in e[:2] and r["hops"] >= 2
        assert all(reasoning.T is not None and x[:-1] in r["prompt"] for x in e)


def test_pools_are_disjoint(spark):
    pool = reasoning.partition_pool(spark, reasoning.NAMES).collect()
    assert len(pool) == len(set(r["name"] for r in pool)) == len(reasoning.NAMES)
    with pytest.raises(ValueError):
        reasoning.partition_pool(spark, reasoning.NAMES[:6])


def test_shards_round_trip_and_strictness(spark, tmp_path):
    import zstandard

    for d, n in (("manual", 3), ("downloaded", 2)):
        (tmp_path / d).mkdir()
        lines = "".join(f'{{"text": "{d} {i}", "source_type": "{d}", "source": "s"}}\n' for i in range(n))
        (tmp_path / d / "00000.jsonl.zst").write_bytes(zstandard.compress(lines.encode()))
    docs = R.validated(R.read_shards(spark, str(tmp_path / "manual"), str(tmp_path / "downloaded")))
    assert [r["text"] for r in docs.orderBy("rank").collect()] == ["manual 0", "manual 1", "manual 2", "downloaded 0", "downloaded 1"]
    assert [r["text"] for r in R.first_rows(docs, 1).collect()] == ["manual 0"]
    R.write_shards(docs.drop("rank"), str(tmp_path / "out"), by=["source_type"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    with pytest.raises(Exception, match="source_type"):
        R.validated(docs.withColumn("source_type", F.lit("other"))).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"step": 1, "loss": 2.0}\nbroken\n{"loss": 1.0}\n{"step": 2, "val_loss": 1.5}\n')
    assert {(r["series"], r["step"]) for r in R.log_series(R.read_log(spark, str(tmp_path / "log.jsonl"))).collect()} == {("loss", 1), ("val_loss", 2)}
    (tmp_path / "x.vocab").write_text('<pad>\t0\n"\t-1\n')
    assert [r["piece"] for r in R.read_vocabulary(spark, str(tmp_path / "x.vocab")).orderBy("id").collect()] == ["<pad>", '"']
    reg = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r["name"] for r in R.lookup(reg, ["b", "a"]).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="c"):
        R.lookup(reg, ["c"])


def test_streams_equal_batches(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    q = I.write_available(I.clean_stream(I.document_stream(spark, str(tmp_path / "in"), d.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    from granary.functions import text as T

    want = d.where(T.good_document(F.col("text"))).select(T.prefix_hash(F.col("text")).alias("p")).distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_posts_by_month(spark, tmp_path):
    import json

    from granary.sources.rest import MonthlyPosts

    post = lambda i, d: {"id": i, "date": d, "title": {"rendered": "t"}, "content": {"rendered": "c"}}
    pages = {"2024-01-0": [post(1, "2024-01-20T00:00:00"), post(1, "2024-01-20T00:00:00"), post(2, "2024-01-02T00:00:00")], "2024-02-0": [post(3, "2024-02-01T00:00:00")], "2024-02-1": []}
    for name, p in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(p))
    spark.dataSource.register(MonthlyPosts)
    got = spark.read.format("monthly_posts").option("path", str(tmp_path)).option("start", "2024-01-15").option("end", "2024-03-01").load()
    assert sorted((r["id"], r["month"]) for r in got.collect()) == [(1, "2024-01"), (3, "2024-02")]


def test_functions_in_sql(spark):
    from granary.functions.register import register

    register(spark)
    r = spark.sql("SELECT nfc('é') AS a, words(' x  y ') AS w, word_count(' x  y ') AS n, script_ratio('कa ', '[ऀ-ॿ]') AS s, lcs_length(array('a', 'b'), array('b')) AS l").first()
    assert (r["a"], r["w"], r["n"], r["s"], r["l"]) == ("é", ["x", "y"], 2, 0.5, 1)


def test_ngrams_are_matched_without_a_row_each(spark):
    """every n-gram was a row of an aggregation, six times the characters of all pairs."""
    rows = [(1, 0, "a b a", "a a b"), (1, 0, "b", "c b b"), (1, 1, None, "x"), (2, 0, "", None), (3, 0, "q\U0001f600q", "\U0001f600q")]
    d = spark.createDataFrame(rows, "k long, j long, h string, r string")
    words = scores.clipped_matches(d, ["k", "j"], T.words(F.col("h")), T.words(F.col("r")), range(1, 4))
    # pairs of one key count together: b stands in it twice and three times
    assert sorted(tuple(r) for r in words.collect()) == [(1, 4, 5, 8), (2, 1, 2, 4), (3, 0, 1, 2)]
    by_char = scores.clipped_matches(d, ["k", "j"], scores.chars(F.col("h")), scores.chars(F.col("r")), range(2, 4))
    assert sorted(tuple(r) for r in by_char.collect()) == [(2, 2, 4, 5), (3, 0, 2, 2)]
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_words_are_counted_where_texts_are_read(spark, monkeypatch):
    """No row for each word, the same counts where a task's words are given out several times; the looked up row is made once."""
    from granary.plans.catalog import QUERIES

    texts = ["a b\x1ca c\xa0\x85b", "", None, " \n\t ", "a​b c", "d e f g a a", "क ख क"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = Counter(w for t in texts for w in (t or "").split())
    for at_once in (2, 200_000):
        monkeypatch.setattr(vocab, "WORDS_AT_ONCE", at_once)
        assert {r["word"]: r["n"] for r in vocab.word_frequencies(d, "text").collect()} == want
    assert "explode" not in vocab.word_frequencies(d, "text")._jdf.queryExecution().optimizedPlan().toString()
    plan = QUERIES["q_vocab_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parquet" not in plan and "Join" in plan
