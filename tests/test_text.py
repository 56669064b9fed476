"""Hand-computed values of the text functions."""

import math
import time

import pytest
from pyspark.sql import functions as F

from granary.functions import measures as M
from granary.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [
    ("क़", "क़"), ("é", "é"), ("“नमस्ते”—x", '"नमस्ते"-x'),
    ("क‍ष", "कष"), ("।" * 4, "।"), ("!!", "!!"), ("a…b", "a.b"), ("x  \t y \n\n\n\n z", "x y\n\nz"),
    (" a b ", "a b"), ("०१२", "०१२"), ("e​́", "é"),
])
def test_normalize(spark, given, want):
    assert one(spark, T.normalize, given) == want


def test_normalize_is_not_idempotent_over_an_invisible_between(spark):
    assert one(spark, T.normalize, one(spark, T.normalize, "e​́")) == "é"


def test_hashes_and_split(spark):
    assert one(spark, T.content_hash, "alpha") == "be76331b95dfc399"
    assert one(spark, T.line_hash, "beta") == "a295e0bdde19"
    assert one(spark, T.prefix_hash, "a b\nc") == "a9993e364706816a"
    p = one(spark, lambda c: T.split_position(T.content_hash(c)), "alpha")
    assert round(p, 6) == 0.343029
    assert one(spark, lambda c: T.assign_split(T.content_hash(c)), "beta") == "train"


def test_foreign_lines(spark):
    assert one(spark, T.drop_foreign_lines, "a b c") == "a b c"
    assert one(spark, T.drop_foreign_lines, "a b c d") == ""
    assert one(spark, T.drop_foreign_lines, "aa bb cc dd कख") == "aa bb cc dd कख"  # exactly 0.8
    assert one(spark, lambda c: T.lines_dropped(c, T.drop_foreign_lines(c)), "a b c d\ne f g h") == 1


def test_clean_drops_furniture(spark):
    assert one(spark, T.clean, ' a   b\n\n{"k": 1}\nShare\nविज्ञापन\nshares stay') == "a b\nshares stay"


def test_answers(spark):
    assert one(spark, T.normal_answer, " राम। ") == "राम"
    assert one(spark, T.oblique_variants, "डिब्बा") == ["डिब्बा", "डिब्बे"]
    assert one(spark, T.native_digits, "105") == "१०५"
    assert one(spark, T.display_piece, "▁") == "_"


def test_schedule(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 499, 500, 8250, 16000)], "s long").select(M.learning_rate(F.col("s"), 6e-4, 500, 16000, 0.1).alias("x")).collect()
    assert all(math.isclose(r["x"], w, rel_tol=1e-12) for r, w in zip(rows, (1.2e-6, 6e-4, 6e-4, 3.3e-4, 6e-5), strict=True))


def test_bits_per_byte_needs_bytes(spark):
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(M.bits_per_byte(F.lit(1.0), F.lit(0))).collect()


def test_white_space_is_that_of_python(spark):
    code_points = [i for i in range(0x3100)] + [0xE000, 0xFEFF, 0xFFFD, 0x1F600, 0x10FFFF]
    d = spark.createDataFrame([(i, chr(i)) for i in code_points], "id long, c string")
    got = d.select("id", F.regexp_count("c", F.lit(T.WS)).alias("space"), F.regexp_count("c", F.lit(T.NOT_WS)).alias("other")).collect()
    assert all(r["space"] == chr(r["id"]).isspace() and r["other"] == 1 - r["space"] for r in got)


def test_words_are_counted_about_as_fast_as_spaces(spark):
    """F4 to F21: in the flat class of white space cores waited for each other, 8 times the time of a plain class with 4 of them."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").repartition(8).persist()

    def least(c) -> float:
        took = []
        for _ in range(3):
            start = time.monotonic()
            d.agg(F.sum(c)).collect()
            took.append(time.monotonic() - start)
        return min(took)

    assert least(F.length("text")) < least(T.word_count(F.col("text"))) < 4 * least(F.regexp_count("text", F.lit("[^ ]+"))) + 0.2
    d.unpersist()
