"""Toxicity by class-conditional Kneser-Ney models.

Two models of an expression's characters, one of toxic and one of ordinary documents, are interpolated with absolute
discounts over contexts of 2 to 5 characters. The longest order has the documents' counts, every lower one continuation counts:
before how many different characters an n-gram stands (n-grams that begin a word have none before them and keep their counts).
Below 2 characters both share one backoff model of the pooled continuation counts. Where neither class knows a context the two
likelihoods are equal, so a rare ordinary word says little, while an unseen form of a known toxic word is still recognised
by its characters. A document counts once for each distinct word.

Length-normalised log-likelihoods (per character) are compared for the whole text and for every expression in it: a document's
evidence is the text's own difference plus that of its most toxic expression, so a single one isn't drowned in a long text.
A token of more than ``WHOLE`` characters is parted at punctuation and symbols; a part that is still longer (scripts without
spaces) would drown what it holds, so as an expression it counts as the most toxic of its stretches of ``STRETCH`` characters,
which keep those before them as context. A logistic curve fitted on labelled rows apart from those that made the counts turns
evidence into a score.

Fit: a bounded sample of labelled training rows (``fit_rows`` + ``tune_rows``, the first by a hash of the id), drawn from the
labels alone; only these rows' texts move. The n-grams are counted on the workers. Where they are more than ``MAX_GRAMS``, the
later half of the fit rows is left out, and so on until they fit, before anything comes to the driver or is broadcast.
Every document is scored over all its words.

Defined results: null or empty text has no evidence (score of the curve at 0). Null labels and labels of null ids are not
used, those of unknown ids find no text; an id with several labels has the largest. Without labels of both classes every score
is 0.0. Extra columns are not read; each row is scored, repeated ones alike.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, give_back, table, tidy

LONG, SHARED, DISCOUNT = 5, 2, 0.9
MAX_GRAMS = 4_000_000
WHOLE, STRETCH = 64, 12
#: Distinct tokens whose values a worker keeps; past it the memory starts anew.
KEPT = 500_000
MARKS = ".,;:!?\"'()[]{}«»…"


def expressions(text: str | None) -> list[str]:
    words = (x.strip(MARKS) for x in (text or "").lower().split())
    return [p for w in words if w for p in ([w] if len(w) <= WHOLE else between_marks(w))]


def between_marks(token: str) -> list[str]:
    """The words of a token, parted at punctuation and symbols."""
    return "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in token).split()


def grams(word: str) -> Iterator[str]:
    """Every character of ^word$ with the 0 to LONG characters before it."""
    s = f"^{word}$"
    for j in range(1, len(s)):
        for k in range(min(j, LONG) + 1):
            yield s[j - k : j + 1]


class Model:
    """log P(toxic) - log P(ordinary) of a character after its context, as ratios of known n-grams and of backoffs."""

    def __init__(self, ratio: dict[str, float], backoff: dict[str, float]):
        self.ratio, self.backoff = ratio, backoff
        self.known: dict[str, tuple[float, int, float]] = {}

    def word(self, w: str) -> tuple[float, int, float]:
        """(sum, characters with the end, the most toxic part's difference per character)."""
        sums = [0.0, *accumulate(self.characters(w))]
        if len(w) > WHOLE:
            return sums[-1], len(w) + 1, max(y - x for x, y in zip(sums, sums[STRETCH:], strict=False)) / STRETCH
        return sums[-1], len(w) + 1, sums[-1] / (len(w) + 1)

    def token(self, t: str) -> tuple[float, int, float]:
        got = self.known.get(t)
        if got is None:
            if len(self.known) > KEPT:
                self.known.clear()
            each = [self.word(w) for w in expressions(t)]
            got = self.known[t] = (sum(x[0] for x in each), sum(x[1] for x in each), max((x[2] for x in each), default=-math.inf))
        return got

    def characters(self, w: str) -> Iterator[float]:
        """Of every character of the word and of its end."""
        s = f"^{w}$"
        for j in range(1, len(s)):
            total = 0.0
            for k in range(min(j, LONG), SHARED - 1, -1):
                r = self.ratio.get(s[j - k : j + 1])
                if r is not None:
                    total += r
                    break
                total += self.backoff.get(s[j - k : j], 0.0)
            yield total

    def evidence(self, text: str | None) -> float:
        total, n, worst = 0.0, 0, -math.inf
        for t, c in Counter((text or "").lower().split()).items():
            x, m, w = self.token(t)
            total += c * x
            n += c * m
            if w > worst:
                worst = w
        return worst + total / n if n else 0.0


class Counts:
    """Rows of (n-gram, ordinary documents, toxic documents), held by column: in tuples they would take several times the memory."""

    def __init__(self, g: list[str], a: np.ndarray, b: np.ndarray):
        self.g, self.a, self.b = g, a, b

    @classmethod
    def of(cls, rows: Iterable[tuple[str, int, int]]) -> Counts:
        every = list(rows)
        return cls([r[0] for r in every], np.array([r[1] for r in every], np.int64), np.array([r[2] for r in every], np.int64))

    def __len__(self) -> int:
        return len(self.g)

    def __iter__(self) -> Iterator[tuple[str, int, int]]:
        return zip(self.g, self.a.tolist(), self.b.tolist(), strict=True)


def fit_model(counts: Counts | Iterable[tuple[str, int, int]]) -> Model:
    """counts: (n-gram, ordinary documents, toxic documents) of all n-grams of up to LONG + 1 characters. Values are arrays by
    n-gram and by context, so what the driver holds is little more than the n-grams themselves."""
    counts = counts if isinstance(counts, Counts) else Counts.of(counts)
    gs, seen = counts.g, (counts.a, counts.b)
    n = len(gs)
    place = {g: i for i, g in enumerate(gs)}
    # an n-gram less its first character is an n-gram itself: its place, and -1 below single characters
    low = np.fromiter((place[g[1:]] if len(g) > 1 else -1 for g in gs), np.int64, n)
    del place
    at: dict[str, int] = {}
    context = np.fromiter((at.setdefault(g[:-1], len(at)) for g in gs), np.int64, n)
    size = np.fromiter(map(len, gs), np.int64, n)
    raw = (size > LONG) | np.fromiter((g[0] == "^" for g in gs), bool, n)
    has = low >= 0

    def counted(own: np.ndarray) -> np.ndarray:
        """Documents at the longest order and at a word's beginning, before how many different characters elsewhere."""
        return np.where(raw, own, np.bincount(low[has & (own > 0)], minlength=n))

    def sums(chosen: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each context the sum of the values, and how many there are."""
        some = chosen & (values > 0)
        return np.bincount(context[some], values[some], len(at)), np.bincount(context[some], minlength=len(at))

    short = size <= SHARED
    both = counted(seen[0] + seen[1])
    pool_total, pool_kinds = sums(short, both)
    pool = {gs[i]: int(both[i]) for i in np.flatnonzero(short)}
    made: dict[str, float] = {}

    def shared(h: str, x: str) -> float:
        h = h[max(0, len(h) - SHARED + 1) :]
        if h + x not in made:
            p = 1 / 300
            for k in range(len(h) + 1):
                c = at.get(h[len(h) - k :], -1)
                if c >= 0 and pool_total[c]:
                    p = (max(pool.get(h[len(h) - k :] + x, 0) - 0.75, 0) + 0.75 * pool_kinds[c] * p) / pool_total[c]
            made[h + x] = p
        return made[h + x]

    own = [counted(seen[y]) for y in (0, 1)]
    total, kinds = zip(*(sums(~short, own[y]) for y in (0, 1)), strict=True)
    likely = np.zeros((2, n))
    for length in range(SHARED + 1, LONG + 2):
        now = np.flatnonzero(size == length)
        if length == SHARED + 1:
            below = np.tile(np.array([shared(gs[i][:-1], gs[i][-1]) for i in now]), (2, 1))
        else:
            below = likely[:, low[now]]
        for y in (0, 1):
            t = total[y][context[now]]
            p = (np.maximum(own[y][now] - DISCOUNT, 0) + DISCOUNT * kinds[y][context[now]] * below[y]) / np.maximum(t, 1)
            likely[y, now] = np.where(t > 0, p, below[y])
    long = np.flatnonzero(~short)
    ratio = dict(zip((gs[i] for i in long), np.log(likely[1, long] / likely[0, long]).tolist(), strict=True))
    weight = [np.where(t > 0, DISCOUNT * k / np.maximum(t, 1), 1.0) for t, k in zip(total, kinds, strict=True)]
    known, back = (total[0] > 0) | (total[1] > 0), np.log(weight[1] / weight[0])
    return Model(ratio, {h: float(back[j]) for h, j in at.items() if known[j]})


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | x), by damped Newton steps with a weak prior on the slope. Rows weigh alike, so 0.5 is where both
    labels are as frequent, and rare toxic rows don't cost ordinary ones."""
    scale = x.std() or 1.0
    z = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    b, prior = np.zeros(2), np.diag([0.5, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + prior, z.T @ (y - p) - prior @ b)
        b = b + np.clip(step, -2, 2)
    return b[0] / scale, b[1] - b[0] * x.mean() / scale


def count_grams(docs: DataFrame) -> DataFrame:
    """docs: (text, toxic). (g, a, b): in how many words of ordinary and of toxic documents each n-gram stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[Counter] = [Counter(), Counter()]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[y].update(set(expressions(text)))
            sums: list[Counter] = [Counter(), Counter()]
            for y in (0, 1):
                for w, c in words[y].items():
                    for g in grams(w):
                        sums[y][g] += c
            every = sorted(sums[0].keys() | sums[1].keys())
            for lo in range(0, len(every), 50_000):
                some = every[lo : lo + 50_000]
                yield pa.RecordBatch.from_pydict({"g": pa.array(some), "a": pa.array([sums[0][g] for g in some], pa.int64()), "b": pa.array([sums[1][g] for g in some], pa.int64())})

    found = docs.select("text", F.col("toxic").cast("int")).mapInArrow(lambda batches: tidy(run(batches)), "g string, a long, b long")
    return found.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def bounded_counts(rows: DataFrame, fit_rows: int, max_grams: int) -> Counts:
    """rows: (place, text, toxic). The n-grams of the rows placed first, of as many halvings of them as the bound asks for."""
    while True:
        found = cut(count_grams(rows.where(F.col("place") < fit_rows)))
        if found.count() <= max_grams:
            got = found.toArrow()
            return Counts(got["g"].to_pylist(), got["a"].to_numpy(), got["b"].to_numpy())
        fit_rows //= 2


def learn(labelled: DataFrame, fit_rows: int = 4000, tune_rows: int = 2000, max_grams: int = MAX_GRAMS) -> tuple[Model, float, float] | None:
    """labelled: (doc_id, text, toxic), training rows only. None without rows of both classes."""
    return learn_from(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"), fit_rows, tune_rows, max_grams)


def learn_from(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, tune_rows: int = 2000, max_grams: int = MAX_GRAMS) -> tuple[Model, float, float] | None:
    """docs: (doc_id, text), labels: (doc_id, toxic). Of the labels in the order of their hash, a seeded share tunes the curve."""
    every = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("fit"), "doc_id")
    first = every.select("doc_id", "toxic", order.alias("o")).orderBy("o", "doc_id").limit(fit_rows + tune_rows)
    tune = F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(fit_rows + tune_rows)) < tune_rows
    place = F.row_number().over(Window.orderBy("tune", "o", "doc_id")) - 1  # over the sample alone
    chosen = first.withColumn("tune", tune).withColumn("place", place).drop("o")
    # fit_rows + tune_rows rows at most: broadcast, so the texts of other documents stay where they are
    rows = cut(docs.join(F.broadcast(chosen), "doc_id"))
    counts = bounded_counts(rows.where("not tune"), fit_rows + tune_rows, max_grams)
    if not counts.a.any() or not counts.b.any():
        return None
    model = fit_model(counts)
    del counts
    give_back()
    sent = docs.sparkSession.sparkContext.broadcast((model.ratio, model.backoff))
    tuned = rows.where("tune").select("text", "toxic").mapInArrow(_evidence(sent), "x double, y int").toArrow()
    x, y = tuned["x"].to_numpy(), tuned["y"].to_numpy()
    slope, offset = fit_curve(x, y) if 0 < y.sum() < len(y) else (4.0, -4.0)
    return model, float(slope), float(offset)


def _evidence(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([model.evidence(t) for t in batch.column(0).to_pylist()], pa.float64()), "y": batch.column(1).cast(pa.int32())})

    return run


def score_documents(docs: DataFrame, learned: tuple[Model, float, float] | None, text_col: str = "text") -> DataFrame:
    """docs with all its columns and, as last, score (if it has one already, it is named score_ and so on)."""
    name = "score"
    while name in docs.columns:
        name += "_"
    if learned is None:
        return docs.withColumn(name, F.lit(0.0))
    model, slope, offset = learned
    sent = docs.sparkSession.sparkContext.broadcast((model.ratio, model.backoff))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array([model.evidence(t) for t in part.column(at).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(slope * x + offset, -700, 700)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(lambda batches: tidy(run(batches)), StructType([*docs.schema.fields]).add(name, DoubleType()))


def held_out(fold: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def learned_on(spark, docs: DataFrame, sf_dir: str) -> tuple[Model, float, float] | None:
    return learn_from(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, learned_on(spark, docs, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(spark, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    scored = score_documents(docs, learned_on(spark, docs, sf_dir))
    return scored.where(F.col(scored.columns[-1]) < threshold).select(docs.columns)
