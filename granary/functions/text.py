"""Text functions as Column expressions. Only NFC needs Python (an Arrow UDF); all else stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space as Python's str.split() has it (Java's \s lacks most of it).
#: Classes are nested by how often their characters occur, as Java tries the members of a flat class from its last set inwards, each by an
#: interface call on which all cores contend: what is no white space is known by its first range or two in nearly all texts.
WS = r"[\x00-\x20\x7f-\xa0\x{1680}-\x{3000}&&[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
NOT_WS = r"[!-~[\xa1-\x{167f}[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]]]"

# Characters deleted and mapped by normalisation.
INVISIBLE = "​‌‍‎‏­﻿⁠"
PUNCT_FROM = "‘’‚‛“”„‟–—―−    　"
PUNCT_TO = "''''\"\"\"\"----     "
REPEATED = "।॥!?.,-"

# Lines that are site furniture, matched anywhere unless anchored, without regard to case.
BLOCKLIST = [
    r"^विज्ञापन$",
    r"एप डाउनलोड कर",
    r"ऐप डाउनलोड कर",
    r"वीडियो विज्ञापन",
    r"प्रीमियम मेंबरशिप",
    r"पढ़ना जारी रखने के लिए",
    r"खबरें लगातार पढ़ने",
    r"यह भी पढ़ें",
    r"संबंधित (खबरें|समाचार)",
    r"हमें फॉलो कर",
    r"शेयर कर",
    r"^विज्ञापन",
    r"प्रकाशित मिति",
    r"सम्बन्धित समाचार",
    r"तपाईंको प्रतिक्रिया",
    r"^प्रतिक्रिया",
    r"फेसबुक(मा)? ",
    r"^\s*(Advertisement|ADVERTISEMENT|Sponsored|Read more|Share|Comments?)\s*$",
    r"^\s*(Copyright|All rights reserved|©)",
    r"^\s*(Home|Menu|Search|Login|Subscribe)\s*$",
]
JSON_LINE = r"^\s*[\{\[].*[\}\]]\s*$"
DEVANAGARI = r"[\x{0900}-\x{097F}]"


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NOT_WS + "+"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalize(c: Column) -> Column:
    """NFC, invisibles out, punctuation unified, runs of three marks to one, spaces and blank lines collapsed."""
    t = F.translate(nfc(c), INVISIBLE, "")
    t = F.replace(F.translate(t, PUNCT_FROM, PUNCT_TO), F.lit("…"), F.lit("..."))
    t = F.regexp_replace(t, rf"([{REPEATED}])\1{{2,}}", "$1")
    t = F.array_join(F.transform(lines(t), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean(c: Column) -> Column:
    """Lines with spaces collapsed; empty, JSON-shaped and blocklisted lines go."""
    kept = F.filter(
        F.transform(lines(c), lambda x: strip(F.regexp_replace(x, "[ \t ​]+", " "))),
        lambda x: (x != "") & ~x.rlike(JSON_LINE) & ~x.rlike("(?iu)" + "|".join(BLOCKLIST)),
    )
    return F.array_join(kept, "\n")


def count_of(c: Column, chars: str) -> Column:
    """How many characters of a class; by length, as regexp_count() makes a string of each match."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{chars}+", ""))


def script_ratio(c: Column, chars: str = DEVANAGARI) -> Column:
    """Share of a script among characters that are no white space."""
    n = F.length(F.regexp_replace(c, WS, ""))
    return F.coalesce(F.try_divide(count_of(c, chars), n), F.lit(0.0))


def latin_ratio(c: Column, chars: str = DEVANAGARI) -> Column:
    latin = count_of(c, "[A-Za-z]")
    return F.coalesce(F.try_divide(latin, latin + count_of(c, chars)), F.lit(0.0))


def drop_foreign_lines(c: Column, most: float = 0.8, min_words: int = 4) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~((word_count(x) >= min_words) & (latin_ratio(x) > most))), "\n")


def lines_dropped(before: Column, after: Column) -> Column:
    """Difference of line breaks, which counts one too few when every line went (kept as is)."""
    return (F.size(lines(before)) - 1) - (F.size(lines(after)) - 1)


def prose_words(c: Column, min_words: int = 8) -> Column:
    counts = F.transform(lines(c), word_count)
    return F.aggregate(counts, F.lit(0), lambda a, x: a + F.when(x >= min_words, x).otherwise(0)).cast("long")


def prose_lines(c: Column, min_words: int = 8) -> Column:
    return F.size(F.filter(lines(c), lambda x: word_count(x) >= min_words)).cast("long")


def good_document(c: Column, words: int = 120, n_lines: int = 3) -> Column:
    return (prose_lines(c) >= n_lines) & (prose_words(c) >= words)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 16)


def prefix_hash(c: Column) -> Column:
    return F.substring(F.sha1(F.regexp_replace(F.substring(c, 1, 300), WS, "")), 1, 16)


def line_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def length_bucket(n: Column) -> Column:
    out = F.when(n < 200, "<200")
    for top in (400, 800, 1600, 3200, 6400):
        out = out.when(n < top, f"<{top}")
    return out.otherwise(">=6400")


def split_position(ident: Column, seed: int = 1337) -> Column:
    head = F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), ident)), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(4294967295.0)


def assign_split(ident: Column, train: float = 0.96, validation: float = 0.02, seed: int = 1337) -> Column:
    p = split_position(ident, seed)
    return F.when(p < train, "train").when(p < F.lit(train) + F.lit(validation), "validation").otherwise("test")


def token_estimate(n: Column, per_word: float = 1.15) -> Column:
    return F.bround(n * F.lit(per_word)).cast("long")


def normal_answer(c: Column) -> Column:
    marks = r"[ \t\n।.,!?\"']"
    return strip(F.regexp_replace(strip(c), f"^{marks}+|{marks}+$", ""))


def oblique(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("ा")), F.concat(F.left(c, F.length(c) - 1), F.lit("े"))).otherwise(c)


def oblique_variants(c: Column) -> Column:
    other = F.when(F.endswith(c, F.lit("ा")), F.concat(F.left(c, F.length(c) - 1), F.lit("े"))).when(
        F.endswith(c, F.lit("े")), F.concat(F.left(c, F.length(c) - 1), F.lit("ा"))
    )
    return F.array_distinct(F.array(c, F.coalesce(other, c)))


def native_digits(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", "०१२३४५६७८९")


def display_piece(c: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.replace(c, F.lit("▁"), F.lit(" "))), F.lit("")), F.lit("_"))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array, empty when it is shorter than n."""
    return F.when(
        F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), "\x01"))
    ).otherwise(F.array().cast("array<string>"))
