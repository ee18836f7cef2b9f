"""Operator 7: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the words it has; a
document's is the noisy-or of its sentences, one minus the product of their complements. Weights
are trained from document labels alone, over words and the beginnings of words, with a soft threshold that keeps them sparse.
The sentences that carry a document's score are then located by their own probabilities.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, labelled_sample, sigmoid

#: Bounds of the training sample: documents and characters of their texts together.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 24_000_000
#: Features that a model may know, and documents that one must be in.
VOCABULARY, LEAST_DOCS = 1500, 4

_sentences = re.compile(r"[^.!?\n]+[.!?]*").finditer
_words = re.compile(r"\w+").findall
_ends = re.compile(r"[.!?\n]+").split


#: Lengths of the word beginnings that count as features beside the word itself.
HEADS = (4, 5, 6, 7)


def _features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}*" for k in HEADS if len(word) > k]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        # The first letters of every feature: one look-up rules out nearly all words.
        self.begins = {f.rstrip("*")[:4] for f in self.weights}

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in _features(w))

    def _known(self, text: str) -> dict[str, float]:
        begins = self.begins
        return {w: z for w in set(_words(text)) if w[:4] in begins and (z := self.word(w))}

    def score(self, text: str) -> float:
        """Noisy-or over the sentences; a text without words has one empty sentence."""
        text = text.lower()
        known, sentences = self._known(text), [s for s in _ends(text) if s]
        sums = []
        if known:
            for s in sentences:
                if hit := known.keys() & _words(s):
                    sums.append(sum(sorted(known[w] for w in hit)))
        z = np.array(sums) + self.bias
        rest = max(len(sentences), 1) - len(sums)
        return float(1.0 - np.exp(-np.logaddexp(0, z).sum() - rest * np.logaddexp(0, self.bias)))

    def locate(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences at ``least`` or more, in the text's own characters."""
        out = []
        for m in _sentences(text):
            z = self.bias + sum(sorted(self._known(m.group().lower()).values()))
            if (p := float(sigmoid(np.array(z)))) >= least:
                out.append((m.start(), m.end(), p))
        return out


def train(sample: list[tuple[int, str, int]], steps: int = 200, sparse: float = 0.001) -> ToxicityModel:
    """Fit on ``[(id, text, 0 or 1)]``. Without both labels every document scores the label's share.

    Of the words and word beginnings in ``LEAST_DOCS`` documents or more, the ``VOCABULARY`` whose
    shares of the two labels differ most (by a likelihood ratio) take part.
    """
    y = np.array([float(l) for _, _, l in sample])
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    seen = (Counter(), Counter())
    for (_, text, _), label in zip(sample, y):
        seen[int(label)].update({f for w in set(_words(text.lower())) for f in _features(w)})
    n1, n0 = float(y.sum()), float(len(y) - y.sum())

    def lift(f):
        a, b = seen[1][f], seen[0][f]
        e = (a + b) / (n1 + n0)
        return sum(k * np.log(k / m) for k, m in ((a, n1 * e), (n1 - a, n1 * (1 - e)), (b, n0 * e), (n0 - b, n0 * (1 - e))) if k > 0 and m > 0) * (1 if a * n0 > b * n1 else 0.5)

    lifts = {f: lift(f) for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= LEAST_DOCS}
    words = sorted(lifts, key=lambda f: (-lifts[f], f))[:VOCABULARY]
    index = {w: k for k, w in enumerate(words)}
    del seen, lifts
    begins = {w.rstrip("*")[:4] for w in words}
    # Sentences one after another, as numbers of features: nothing else of the texts is held.
    col, size, doc = array("i"), array("i"), array("i")
    for d, (_, text, _) in enumerate(sample):
        for s in [s for s in _ends(text.lower()) if s] or [""]:
            hit = sorted({index[f] for w in set(_words(s)) if w[:4] in begins for f in _features(w) if f in index})
            col.extend(hit)
            size.append(len(hit))
            doc.append(d)
    col, doc = np.array(col, np.int32), np.array(doc, np.int32)
    row = np.repeat(np.arange(len(doc), dtype=np.int32), np.array(size))
    w, b = np.zeros(len(words)), -5.0
    half = np.where(y > 0, 0.3 / n1, 0.7 / n0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], minlength=len(doc))
        log_none = -np.bincount(doc, np.logaddexp(0, z), minlength=len(y))
        none = np.exp(np.minimum(log_none, -1e-9))
        gz = (np.where(y > 0, -none / (1 - none), 1.0) * half)[doc] * sigmoid(z)
        g, gb = np.bincount(col, gz[row], minlength=len(w)), gz.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        scale = 0.1 / (np.sqrt(v / fix2) + 1e-6)
        w = w - scale * m / fix
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale * sparse / 10, 0.05), 0)
        b -= 0.1 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    return ToxicityModel({x: float(round(k, 6)) for x, k in zip(words, w) if abs(k) > 0.1}, float(round(b, 6)))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Train on a bounded sample of ``labels(doc_id, toxic)``."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    return train(labelled_sample(docs, labels, rows, chars, scratch or Scratch(docs.sparkSession, "toxic")))


def detect(docs: DataFrame, model: ToxicityModel, spans: bool = True) -> DataFrame:
    """``(doc_id, score, predicted, spans)``, a row for each row, of whole texts and nothing else.

    ``spans`` are the offending sentences (start, end, probability) by character. Null texts count
    as empty: one sentence without words. A model knows ``VOCABULARY`` features at most.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [m.score(t) for t in texts]
            where = [m.locate(t) if p >= 0.5 else [] for t, p in zip(texts, got)] if spans else [[] for _ in got]
            where = [[{"start": x, "end": y, "p": p} for x, y, p in s] for s in where]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array([int(p >= 0.5) for p in got], pa.int32()), pa.array(where, kind)], ["doc_id", "score", "predicted", "spans"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start int, end int, p double>>")
