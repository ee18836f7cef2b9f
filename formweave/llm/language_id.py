"""Operator 9: language identification by error-correcting output codes.

Every language gets a codeword; a binary n-gram classifier per bit (logistic regression on hashed
byte trigrams of the lower-cased text) predicts its sign. Decoding adds each bit's logistic loss
against a codeword, weighted by the bit's training accuracy, and takes the language with the least
loss; a small lead over the second is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, adam, bound_batches, labelled_sample, sigmoid, unit_profile

GRAM, BITS = 3, 12
#: Bounds of the training sample: documents and characters of their texts together.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 16_000_000


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of signs for each of ``n`` languages: all distinct splits up to 7, else 10 log2(n) random ones."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        return np.array([[1.0 if k == 0 or (c >> (k - 1)) & 1 == 0 else -1.0 for c in range(1, 2 ** (n - 1))] for k in range(n)])
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], size=(n, width))
        apart = ((width - m @ m.T) / 2 + np.eye(n) * width).min()
        if (best is None or apart > best[0]) and (abs(m.sum(axis=0)) < n).all():
            best = (apart, m)
    return best[1]


def features(text: str) -> np.ndarray:
    return unit_profile(f" {text.lower()} ".encode(), GRAM, BITS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous); ``und`` where the text has no letter."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, False
        margin = features(text) @ self.weights + self.bias
        loss = (np.logaddexp(0, -margin[None, :] * self.codes) * self.trust).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(loss, kind="stable")
        return self.langs[order[0]], float(p[order[0]]), bool(len(order) > 1 and p[order[0]] - p[order[1]] < 0.5)


def train(sample: list[tuple[int, str, str]], steps: int = 150) -> LanguageModel:
    """Fit on ``[(id, text, lang)]``; texts without a letter are skipped; no rows give a model that says ``und``."""
    sample = [(t, l) for _, t, l in sample if has_letter(t)]
    langs = sorted({l for _, l in sample})
    if not langs:
        return LanguageModel([], *[np.zeros((0, 0))] * 4)
    codes = codewords(len(langs))
    x = np.stack([features(t) for t, _ in sample])
    y = codes[[langs.index(l) for _, l in sample]]
    count = np.bincount([langs.index(l) for _, l in sample], minlength=len(langs))
    each = (1.0 / count)[[langs.index(l) for _, l in sample]] / len(langs)
    d, k = x.shape[1], codes.shape[1]

    def grad(p):
        w, b = p[:-1], p[-1]
        g = -y * sigmoid(-y * (x @ w.astype(np.float32) + b)) * each[:, None]
        return np.vstack([x.T @ g.astype(np.float32) + 1e-5 * w, g.sum(axis=0)])

    p = adam(grad, np.zeros((d + 1, k)), steps, 0.3)
    right = ((np.sign(x @ p[:-1].astype(np.float32) + p[-1]) == y) * each[:, None]).sum(axis=0)
    return LanguageModel(langs, codes, p[:-1].astype(np.float32), p[-1], np.clip(right, 0.5, 1.0))


def fit(docs: DataFrame, learn: Column, scratch: Scratch | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Train on a bounded sample of the documents that ``learn`` holds for and whose ``lang`` isn't null."""
    labels = docs.where(learn).select("doc_id", F.col("lang").cast("string").alias("label"))
    return train(labelled_sample(docs, labels, rows, chars, scratch or Scratch(docs.sparkSession, "lang")))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)``, a row for each row, of whole texts and nothing else.

    Null texts, empty ones and those without a letter are ``und`` with score 0. The model's size is
    that of its languages' codewords times 2**12 bins, whatever the corpus.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
