"""Language identification by naive Bayes over character trigrams, trained and applied as relational plans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

CHARS, LEAST = 2000, 20


def sample(text: Column) -> Column:
    """What is classified: the first 2000 characters on one line."""
    return F.trim(F.replace(F.substring(text, 1, CHARS), F.lit("\n"), F.lit(" ")))


def trigrams(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, gram, c): counts within each document's sample."""
    s = docs.select(*keys, F.lower(sample(F.col(text))).alias("s")).where(F.length("s") >= LEAST)
    g = s.select(*keys, F.explode(F.regexp_extract_all("s", F.lit("(?s)(?=(...))"), F.lit(1))).alias("gram"))
    return g.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("c"))


def codes(s: str) -> np.ndarray:
    """Each trigram of s as a number, 21 bits a character."""
    c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def grams(of: np.ndarray) -> list[str]:
    """codes() back as text."""
    s = np.stack([of >> 42, of >> 21 & 0x1FFFFF, of & 0x1FFFFF], 1).astype(np.uint32).tobytes().decode("utf-32-le")
    return [s[i : i + 3] for i in range(0, len(s), 3)]


#: Samples whose trigrams are counted at a time: some MB of numbers.
AT_ONCE = 500


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c) of some samples (lang, s) at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            by: dict[str | None, list[np.ndarray]] = {}
            for lang, s in zip(*(c.to_pylist() for c in batch.slice(start, AT_ONCE).columns), strict=True):
                by.setdefault(lang, []).append(codes(s))
            for lang, found in by.items():
                of, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), pa.array(grams(of), pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "c"])


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(gram, lang, logp), add-one over the grams seen at all. A model row for every gram and language: languages are few.
    Counts are made where the texts are read; only they are shuffled, and they are written once, as they are read three times."""
    s = labelled.select(F.col(lang).alias("lang"), F.lower(sample(F.col(text))).alias("s")).where(F.length("s") >= LEAST)
    c = cut(s.mapInArrow(count_grams, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    by_gram = c.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("m"))  # one entry a language
    totals = c.groupBy("lang").agg(F.sum("c").alias("total"))
    n = by_gram.agg(F.count(F.lit(1)).alias("v"))
    langs = totals.join(n, F.lit(True)).agg(F.collect_list(F.struct("lang", "total", "v")).alias("ls"))  # one row
    rows = by_gram.join(F.broadcast(langs), F.lit(True)).select("gram", "m", F.inline("ls"))
    return rows.select("gram", "lang", F.ln((F.coalesce(F.get(F.array(F.try_element_at("m", F.col("lang"))), 0), F.lit(0)) + 1) / (F.col("total") + F.col("v"))).alias("logp"))


#: Rows of a model (grams times languages) up to which it is broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def predict(docs: DataFrame, model: DataFrame, ident: str = "doc_id", text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """(id, predicted, confidence): softmax of the mean log likelihoods times 20; short samples are unknown with 0.

    A model of at most ``most`` rows is broadcast as one table of weights, and texts are scored where they are read, without a
    shuffle; a larger one is joined to the texts' grams, with the same results. Ties go to the language that sorts last.
    """
    rows = model.select("gram", "lang", "logp").limit(most + 1).toArrow()
    if rows.num_rows > most:
        return predict_by_join(docs, model, ident, text)
    langs = sorted(set(rows["lang"].to_pylist()))
    if not langs:
        return docs.select(ident, F.lit("unknown").alias("predicted"), F.lit(0.0).alias("confidence"))
    known, of = np.unique(codes("".join(rows["gram"].to_pylist()))[::3], return_inverse=True)
    weights = np.zeros((len(known), len(langs)))
    weights[of, np.searchsorted(langs, rows["lang"].to_pylist())] = rows["logp"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((known, weights))

    @F.pandas_udf("predicted string, confidence double")
    def classify(samples: pd.Series) -> pd.DataFrame:
        known, weights = sent.value
        out = []
        for s in samples:
            if s is None or len(s) < LEAST:
                out.append(("unknown", 0.0))
                continue
            of, n = np.unique(codes(s), return_counts=True)
            at = np.minimum(np.searchsorted(known, of), len(known) - 1)
            met = known[at] == of
            if not met.any():
                out.append(("unknown", 0.0))
                continue
            mean = (weights[at[met]] * n[met, None]).sum(axis=0) / n[met].sum()
            best = len(mean) - 1 - int(mean[::-1].argmax())
            out.append((langs[best], 1 / float(np.exp(20 * (mean - mean[best])).sum())))
        return pd.DataFrame(out, columns=["predicted", "confidence"])

    got = docs.select(ident, classify(F.lower(sample(F.col(text)))).alias("c"))
    return got.select(ident, "c.predicted", "c.confidence")


def predict_by_join(docs: DataFrame, model: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """predict() for models of any size, as a relational plan; one row an id."""
    g = trigrams(docs, [ident], text).join(model, "gram")
    s = g.groupBy(ident, "lang").agg((F.sum(F.col("c") * F.col("logp")) / F.sum("c")).alias("mean"))
    best = s.groupBy(ident).agg(F.max(F.struct("mean", "lang")).alias("best"), F.collect_list("mean").alias("means"))
    total = F.aggregate("means", F.lit(0.0), lambda a, x: a + F.exp(20 * (x - F.col("best.mean"))))
    out = best.select(ident, F.col("best.lang").alias("predicted"), (1 / total).alias("confidence"))
    return docs.select(ident).join(out, ident, "left").select(ident, F.coalesce("predicted", F.lit("unknown")).alias("predicted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
