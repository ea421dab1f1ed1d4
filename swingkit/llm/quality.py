"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: its words, and the unigrams, bigrams and trigrams of its word
shapes (letters, capitals and digits collapsed to one sign each), with marks for words that follow themselves. Each
indicator is scaled by its log-count ratio between the classes, and a linear model with squared hinge loss is fitted
to the scaled indicators by dual coordinate descent. A logistic curve, fitted to the margins of held-out folds, turns
a margin into a score.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, drawn by a hash of their id, and is one array of ``CELLS``
doubles; every text is scored whole, in tasks of its own partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swingkit.llm.common import id_remainder, small_batches, table

CELLS = 1 << 18
#: Labelled rows to fit on at most.
MAX_TRAIN = 8000
#: Features of all rows to fit on at most; rows beyond that, in the order of their hash, are left out of the sample.
MAX_FEATURES = 1 << 24
EPOCHS, COST, FOLDS = 10, 1.0, 4
CUT = 0.7

_KINDS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = np.isin(np.arange(256), [48, 65, 97])


def features(text: str | None, cells: int = CELLS) -> np.ndarray:
    """Sorted cells of the text's n-gram indicators; none for a null or blank text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.empty(0, np.int32)
    kinds = np.frombuffer(raw.translate(_KINDS), np.uint8)
    new = np.ones(len(kinds), bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | ~_RUNS[kinds[1:]]
    shapes = kinds[new].tobytes().split()
    found = {b"w" + w for w in set(words)}
    found.update(set(shapes))
    found.update(b" ".join(x) for x in set(zip(shapes, shapes[1:], strict=False)))
    found.update(b" ".join(x) for x in set(zip(shapes, shapes[1:], shapes[2:], strict=False)))
    again = [a == b for a, b in zip(words, words[1:], strict=False)]
    if True in again:
        found.add(b"=1")
        if any(a and b for a, b in zip(again, again[1:], strict=False)):
            found.add(b"=2")
    return np.unique(np.fromiter((zlib.crc32(x) % cells for x in found), np.int32, len(found)))


@dataclass
class Model:
    """Weights of the raw indicators, the bias, and the logistic curve's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, cells: np.ndarray) -> float:
        return float(self.weights[cells].sum() + self.bias)

    def score(self, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(cells) + self.shift, -500, 500))))


def descend(rows: list[np.ndarray], good: np.ndarray, cells: int = CELLS, epochs: int = EPOCHS, cost: float = COST) -> Model:
    """Log-count ratios, then dual coordinate descent over the rows in seeded orders."""
    counts = np.ones((2, cells))
    for x, y in zip(rows, good, strict=True):
        counts[int(y), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    weights, bias, dual = np.zeros(cells), 0.0, np.zeros(len(rows))
    sign = np.where(good, 1.0, -1.0)
    scaled = [ratio[x] for x in rows]
    norms = np.array([float((v * v).sum()) for v in scaled]) + 1 + 1 / (2 * cost)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, v = rows[k], scaled[k]
            slope = sign[k] * (weights[x] @ v + bias) - 1 + dual[k] / (2 * cost)
            value = max(dual[k] - slope / norms[k], 0.0)
            if step := (value - dual[k]) * sign[k]:
                weights[x] += step * v
                bias += step
                dual[k] = value
    return Model(weights * ratio, bias)


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that fits the margins best, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        theta = theta - np.clip(step, -2, 2)
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit_rows(rows: list[np.ndarray], good: np.ndarray, cells: int = CELLS) -> Model:
    """The model of all rows, its curve from folds that it wasn't fitted on; a constant where a class is missing."""
    good = good.astype(bool)
    if good.all() or not good.any():
        return Model(np.zeros(cells), 0.0, 1.0, 0.0 if not len(good) else 4.0 if good.all() else -4.0)
    fold, margins = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for k in range(FOLDS):
        inside = fold != k
        part = descend([x for x, i in zip(rows, inside, strict=True) if i], good[inside], cells)
        for i in np.flatnonzero(~inside):
            margins[i] = part.margin(rows[i])
    model = descend(rows, good, cells)
    model.slope, model.shift = logistic(margins, good)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_TRAIN, cells: int = CELLS) -> Model:
    """Fit on at most ``most`` documents with a label; ``labels`` has the key and ``quality`` (0 or 1).

    A key with several labels counts once, by the least; null keys and labels are left out. Of documents with one key
    the smallest text counts.
    """
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(most)
    )

    def cells_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(x, cells) for x in batch])

    small_batches(docs.sparkSession)
    found = (
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .join(F.broadcast(chosen), "_key")  # at most `most` rows
        .withColumn("cells", F.pandas_udf(cells_of, "array<int>")("_text"))
        .groupBy("_key")
        .agg(F.min(F.struct(F.col("cells").alias("cells"), "quality")).alias("x"))
        .withColumn("total", F.sum(F.size("x.cells")).over(Window.orderBy(F.xxhash64("_key"), "_key")))
        .filter(F.col("total") <= MAX_FEATURES)
        .orderBy(F.xxhash64("_key"), "_key")
        .select("x.*")
        .toArrow()  # at most `most` rows and MAX_FEATURES cells
    )
    rows = [part.values.to_numpy(zero_copy_only=False) for part in found["cells"].combine_chunks()]
    return fit_rows(rows, found["quality"].to_numpy().astype(bool), cells)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the score (0 to 1) of every whole text; blank and null texts get that of no features."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = held.value
        for batch in texts:
            yield pd.Series([known.score(features(x, len(known.weights))) for x in batch], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(scores, "double")(F.col(text)))


def op4_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from labelled rows that aren't held out."""
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
