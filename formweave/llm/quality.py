"""Operator 4: document quality by ordinal cumulative-link regression.

With ordered grades g0 < g1 < ... the model is P(grade <= gk) = logistic(threshold_k - w.x): one
weight vector over hashed text for all grades, thresholds in order by construction. It gives the
expected grade and the tail probabilities P(grade > gk) that documents are selected by.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, adam, bound_batches, gram_profile, labelled_sample, lean, sigmoid

GRAM, BITS = 3, 12
#: Bounds of the training sample: documents and characters of their texts together.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000_000


def features(text: str) -> np.ndarray:
    """Hashed byte trigrams of the text as it stands and hashed tokens of its shape, at length one each."""
    x = np.sqrt(gram_profile(text.encode(), GRAM, BITS).astype(np.float32))
    x /= max(float(np.sqrt((x * x).sum())), 1e-9)
    words = text.split()
    n = max(len(words), 1)
    upper = sum(map(str.isupper, words))
    again = sum(map(operator.eq, words, words[1:]))
    plain = sum(map(str.isalpha, words))
    shape = [f"{k}:{min(10, int(10 * v / n))}" for k, v in (("upper", upper), ("again", again), ("plain", plain))] + [f"words:{min(n, 64).bit_length()}"]
    for s in shape:
        x[xxhash.xxh32_intdigest(s, 1) >> (32 - BITS)] += 0.5
    return x


@dataclass
class QualityModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade > gk) for each threshold, falling with k."""
        return sigmoid(float(features(text) @ self.weights) - self.thresholds)

    def expected(self, tails: np.ndarray) -> float:
        return float(self.grades[0] + np.dot(np.diff(self.grades), tails)) if self.grades else 0.0


def train(sample: list[tuple[int, str, int]], steps: int = 200) -> QualityModel:
    """Fit on ``[(id, text, grade)]``; a single grade gives a model that always predicts it."""
    grades = sorted({int(g) for _, _, g in sample})
    k = len(grades) - 1
    if k < 1:
        return QualityModel(grades or [0], np.zeros(1 << BITS, np.float32), np.zeros(0))
    x = np.stack([features(t) for _, t, _ in sample])
    y = np.array([grades.index(int(g)) for _, _, g in sample])
    above = (y[:, None] > np.arange(k)).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.expm1(np.maximum(np.diff(first), 0.05)))
    d = x.shape[1]

    def thresholds(p):
        return np.cumsum(np.concatenate([p[d : d + 1], np.logaddexp(0, p[d + 1 :])]))

    def grad(p):
        # P(y = j) is the difference of two neighbouring tails; its logarithm is differentiated.
        s = x @ p[:d].astype(np.float32)
        tail = sigmoid(s[:, None] - thresholds(p))
        full = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], axis=1)
        at = np.arange(len(y))
        prob = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        slope = full * (1 - full)
        up, down = slope[at, y] / prob, slope[at, y + 1] / prob
        gs = -(up - down) / len(y)
        gt = np.zeros(k + 2)
        np.add.at(gt, y, up / len(y))
        np.add.at(gt, y + 1, -down / len(y))
        gt = np.cumsum(gt[1 : k + 1][::-1])[::-1]
        gt[1:] *= sigmoid(p[d + 1 :])
        return np.concatenate([x.T @ gs.astype(np.float32) + 1e-5 * p[:d], gt])

    p = adam(grad, np.concatenate([np.zeros(d), first[:1], gaps]), steps, 0.3)
    return QualityModel(grades, p[:d].astype(np.float32), thresholds(p))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> QualityModel:
    """Train on a bounded sample of ``labels(doc_id, quality)``, quality being an integer grade."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    return train(labelled_sample(docs, labels, rows, chars, scratch or Scratch(docs.sparkSession, "quality")))


def rate(docs: DataFrame, model: QualityModel, tail: int = 0, keep: float = 0.5, columns: bool = False) -> DataFrame:
    """``(doc_id, expected_grade, tail_prob, selected)``, a row for each row.

    ``tail_prob`` is P(grade > the ``tail``-th grade); a document is selected if that is at least
    ``keep``. Null texts count as empty. Without two grades nothing can be told apart: every row is
    selected with tail probability 1. With ``columns`` the rows of ``docs`` come out as they are,
    the selected ones only.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            tails = [m.tails(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            prob = np.array([float(t[min(tail, len(t) - 1)]) if len(t) else 1.0 for t in tails])
            if columns:
                yield b.filter(pa.array(prob >= keep))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.expected(t) for t in tails], pa.float64()), pa.array(prob), pa.array(prob >= keep)], ["doc_id", "expected_grade", "tail_prob", "selected"])

    if columns:
        return docs.mapInArrow(lean(run), docs.schema)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(lean(run), "doc_id long, expected_grade double, tail_prob double, selected boolean")
