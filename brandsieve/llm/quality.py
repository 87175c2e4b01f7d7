"""Quality of documents by a support vector machine on naive-Bayes features.

Features are indicators of byte n-grams, hashed into a fixed number of places, and of word
n-grams that repeat one word, whatever the word. Each is scaled
by the log-count ratio of the two classes; a linear model is fitted to the scaled indicators
with hinge loss by dual coordinate descent; a sigmoid fitted to margins of held-back rows turns
margins into scores. The fit takes a bounded sample of labelled rows (``max_fit_rows``); every document is
scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from brandsieve.llm.tables import free_name, in_fold

PLACES = 1 << 18
ORDERS = (1, 2, 3)
#: Word n-grams of one word over and over, of 2 to so many words, are indicators as well.
MOST_EQUAL = 5
#: Documents that the fit reads at most, chosen by the MD5 of their id.
MAX_FIT_ROWS = 16_000
#: Parts of the sample that give the margins for the sigmoid.
PARTS = 4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
_BLOCK = 1 << 20


class Model(NamedTuple):
    """score = 1 / (1 + exp(-(slope * (weights . features + bias) + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def features(text: str | None) -> np.ndarray:
    """The places of the n-grams of a whole text, ascending; none for null and empty texts."""
    there = np.zeros(PLACES, bool)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data), _BLOCK):
        block = data[at : at + _BLOCK + max(ORDERS) - 1].astype(np.uint32)
        code = np.zeros(len(block), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(block) < n:
                break
            code = (code[: len(block) - n + 1] << 8 | block[n - 1 :]) if n > 1 else block
            if n in ORDERS:
                there[(code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(14)] = True
    words = data.tobytes().split()
    run = longest = 1
    for one, two in zip(words, words[1:]):
        run = run + 1 if one == two else 1
        longest = max(longest, run)
    there[[n * 7919 for n in range(2, min(longest, MOST_EQUAL) + 1)]] = True
    return np.flatnonzero(there)


def log_count_ratio(rows: list[np.ndarray], positive: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, PLACES), smoothing)
    for row, label in zip(rows, positive):
        counts[int(label), row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], ratio: np.ndarray, positive: np.ndarray, cost: float = 1.0, epochs: int = 15
) -> tuple[np.ndarray, float]:
    """Weights on the scaled indicators and the bias, for hinge loss; both classes weigh alike."""
    share = positive.mean()
    limits = np.where(positive, 0.5 / share, 0.5 / (1 - share)) * cost
    signs = np.where(positive, 1.0, -1.0)
    values = [ratio[row] for row in rows]
    scale = np.sqrt(np.mean([v @ v for v in values]) or 1.0)
    values = [v / scale for v in values]
    norms = np.array([v @ v + 1.0 for v in values])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(PLACES), 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limits[i])
            if change := new - alpha[i]:
                weights[rows[i]] += change * signs[i] * values[i]
                bias += change * signs[i]
                alpha[i] = new
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return weights / scale, bias


def _sigmoid_fit(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest sigmoid, by Newton steps with softened targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margins, np.ones(len(margins))]
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit_model(rows: list[np.ndarray], positive: np.ndarray) -> Model:
    """All rows fit the weights; the sigmoid is fitted to margins of each quarter by a model of
    the other three. With one class only, or none, in some part, every score is the (smoothed)
    share of the positive rows."""
    part = np.arange(len(rows)) % PARTS

    def weights_of(used: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in np.flatnonzero(used)]
        ratio = log_count_ratio(own, positive[used])
        inner, bias = dual_coordinate_descent(own, ratio, positive[used])
        return (inner * ratio).astype(np.float32), bias

    if any(len(set(positive[part != k].tolist())) < 2 for k in range(PARTS)):
        share = (positive.sum() + 1) / (len(rows) + 2)
        return Model(np.zeros(PLACES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    for k in range(PARTS):
        weights, bias = weights_of(part != k)
        for i in np.flatnonzero(part == k):
            margins[i] = weights[rows[i]].sum(dtype=float) + bias
    return Model(*weights_of(np.ones(len(rows), bool)), *_sigmoid_fit(margins, positive))


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["row"] = [features(t).astype("<u4").tobytes() for t in batch["text"]]
        yield batch[["place", "label", "row"]]


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["place", "label"], ignore_index=True)
    model = fit_model([np.frombuffer(r, "<u4") for r in rows["row"]], rows["label"].to_numpy(bool))
    return pd.DataFrame([{**model._asdict(), "weights": model.weights.tobytes()}])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """A model from the labelled documents outside the held-out fold.

    A document with several labels counts as positive if half of them or more are; null labels
    and ids are left out. The sample is bounded, so one task fits it.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).alias("label"))
        .withColumn("place", F.md5(F.col("doc_id").cast("string").cast("binary")))
        .orderBy("place")
        .limit(max_fit_rows)
    )
    found = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known), "doc_id")  # max_fit_rows small rows at most
        .select("place", "label", "text")
        .mapInPandas(_encoded, "place string, label boolean, row binary")
        .orderBy("place", "label")
        .limit(max_fit_rows)
        .withColumn("sample", F.lit(1))
        .groupBy("sample")
        .applyInPandas(_fitted, "weights binary, bias double, slope double, offset double")
        .first()
    )
    if found is None:
        return fit_model([], np.array([], bool))
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"], found["slope"], found["offset"])


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "quality_score") -> DataFrame:
    """The documents with a column ``score``, 0 to 1; null texts score like empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def scores(texts: pd.Series) -> pd.Series:
        weights, bias, slope, offset = shared.value
        margins = np.array([weights[features(t)].sum(dtype=float) + bias for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * margins + offset, -700, 700))), dtype="float64")

    return docs.withColumn(score, F.pandas_udf(scores, DoubleType())(F.col(text).cast("string")))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts get the score of the
    bias alone; repeated rows and null ids (never held out) come back as they are; other
    columns are ignored. Without usable labels every score is one half."""
    held_out = in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out")
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select(
        "doc_id",
        held_out,
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns. If every document
    has one score, as without labels of both classes, nothing speaks against any: all stay."""
    model = fit(docs, labels)
    if model.slope == 0:
        return docs
    score = free_name(docs, "score")
    return scored(docs, model, score=score).where(F.col(score) >= threshold).select(docs.columns)
