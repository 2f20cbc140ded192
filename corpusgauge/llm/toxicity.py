"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its letters in lower case. Each is scaled by the log ratio of the
shares of toxic and clean labelled texts that hold it, and a logistic regression is fitted on the scaled features. Ratios are
pulled towards zero by PRIOR texts, so n-grams of few texts say little; those that say nearly nothing are left out.

The classifier is fitted on at most `most` labelled texts of each class, those with the smallest hashes of their ids. Spark
counts the n-grams and extracts the features; the driver gets one count per hashed n-gram and the sample's selected
features, never texts. Scoring reads every text once, without a shuffle.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

LENGTHS = (3, 4, 5)
#: Bits of a hashed n-gram: the model is a table of so many floats.
BITS = 20
PRIOR = 20.0
#: Characters hashed at once.
BLOCK = 1 << 20


class Grams:
    """Distinct hashed n-grams of texts."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def hashed(self, text: str) -> np.ndarray:
        """The n-grams of a text of up to BLOCK characters, with repeats."""
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
        out, h = [], code
        for n in range(2, LENGTHS[-1] + 1):
            h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :] if len(h) > 1 else h[:0]
            if n in LENGTHS:
                x = h ^ h >> np.uint32(15)
                out.append((x * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS))
        return np.concatenate(out)

    def distinct(self, text: str) -> np.ndarray:
        if len(text) <= BLOCK:
            grams = self.hashed(text)
            places = np.arange(len(grams), dtype=np.int32)
            self.last[grams] = places
            return grams[self.last[grams] == places]
        seen = np.zeros(1 << BITS, bool)
        for start in range(0, len(text), BLOCK):
            seen[self.hashed(text[max(0, start - LENGTHS[-1]) : start + BLOCK])] = True
        return np.flatnonzero(seen)


@dataclass
class Model:
    """weights: of each hashed n-gram, its ratio included. Without labels of both classes: no weights, bias of their share."""

    weights: np.ndarray
    bias: float

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[grams].sum(dtype=np.float64), -40, 40))))


def counts(sample: DataFrame) -> np.ndarray:
    """Texts of each class that hold each n-gram; sample has text and toxic."""
    def run(batches):
        grams, held = Grams(), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                held[toxic.as_py(), grams.distinct(text.as_py())] += 1
        some = np.flatnonzero(held.any(axis=0))
        for start in range(0, len(some), 1 << 16):
            at = some[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[0, at]), pa.array(held[1, at])], ["gram", "clean", "toxic"])

    rows = sample.mapInArrow(run, "gram long, clean long, toxic long").groupBy("gram").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    out, got = np.zeros((2, 1 << BITS), np.int64), rows.toArrow()
    at = got.column("gram").to_numpy()
    out[0, at], out[1, at] = got.column("clean").to_numpy(), got.column("toxic").to_numpy()
    return out


def extract(sample: DataFrame, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, features, number of features) of the sample; places: each n-gram's feature or -1."""
    def run(batches):
        grams = Grams()
        for batch in batches:
            found = [np.sort(f[f >= 0]) for f in (places[grams.distinct(t.as_py())] for t in batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "features"])

    got = sample.mapInArrow(run, "toxic int, features array<int>").toArrow().combine_chunks()
    features = got.column("features").combine_chunks()
    return got.column("toxic").to_numpy(), features.flatten().to_numpy(), features.value_lengths().to_numpy()


def logistic(label, features, sizes, ratio, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum on mean log loss; both classes weigh the same."""
    row = np.repeat(np.arange(len(label)), sizes)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    w, bias = np.ones(len(ratio)) * 0.1, 0.0
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, weights=(w * ratio)[features], minlength=len(label))
        off = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        g = np.bincount(features, weights=off[row], minlength=len(w)) * ratio + ridge * w
        gb = off.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, bias


def fit(sample: DataFrame, least_ratio: float = 0.7) -> Model:
    """A model from (text, toxic) rows; texts aren't null, toxic is 0 or 1."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS, np.float32), 40.0 if n1 else -40.0)
    held = counts(sample)
    rate = lambda c, n: (held[c] + PRIOR * n / (n0 + n1)) / n
    ratio = np.log(rate(1, n1) / rate(0, n0))
    chosen = np.flatnonzero(np.abs(ratio) >= least_ratio)
    places = np.full(1 << BITS, -1, np.int32)
    places[chosen] = np.arange(len(chosen))
    w, bias = logistic(*extract(sample, places), ratio[chosen])
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w * ratio[chosen]
    return Model(weights, bias)


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, toxic) of at most `most` usable labelled documents of each class; usable is a condition on doc_id."""
    ids = labels.select("doc_id", "toxic").dropna().filter(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda c: ids.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = first(0).union(first(1)).withColumnRenamed("doc_id", "_of")  # 2 * most rows of two numbers at most
    rows = docs.join(F.broadcast(chosen), docs[key] == chosen["_of"])
    return rows.select(F.coalesce(docs[text], F.lit("")).alias("text"), chosen["toxic"].alias("toxic"))


def scores(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column with the score of the text; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        grams, model = Grams(), shared.value
        return texts.fillna("").map(lambda t: model.score(grams.distinct(t)))

    return score(docs[text])


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, most: int = 6_000, text: str = "text", key: str = "doc_id") -> Model:
    """A model from the labels of documents that aren't held out."""
    return fit(written(labelled(docs, labels, ~held_out(F.col("doc_id")), most, text, key), "labelled"))


def score(docs: DataFrame, labels: DataFrame, most: int = 6_000, reject: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from `reject` on); columns of these names are replaced.

    Null texts are empty; empty texts get the score of a text without n-grams known to the model. Labels with a null id or
    mark are left out; of several for one id toxic wins. Without labels of both classes every score is that of the one
    class, and clean if there are none. A null id isn't held out.
    """
    model = train(docs, labels, most, text, key)
    return docs.withColumn("score", scores(docs, model, text)).withColumns({
        "held_out": F.coalesce(held_out(F.col(key)), F.lit(False)), "predicted": (F.col("score") >= reject).cast("int")})
