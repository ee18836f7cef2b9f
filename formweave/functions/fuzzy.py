"""Normalised Indel similarity: 100 * 2 * LCS / (len a + len b), in Arrow batches.

The longest common subsequence is counted with bit vectors (Hyyrö 2004) in whole numbers of any
length, so a comparison takes as many steps as the shorter text has characters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf


def lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def ratio_of(a: str | None, b: str | None) -> float:
    """0 where either is null; 100 for two empty texts."""
    if a is None or b is None:
        return 0.0
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_of(a: str | None, b: str | None) -> float:
    """The best ``ratio_of`` the shorter text has with a window of the longer one, shorter windows at the ends included."""
    if a is None or b is None:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n = len(a)
    # How many characters of the shorter text each window holds bounds its ratio: windows are tried from the best bound on.
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    most = np.zeros(len(b) + n - 1, np.int64)
    for c, held in zip(*np.unique(x, return_counts=True)):
        total = np.concatenate([np.zeros(n, np.int64), np.cumsum(y == c), np.full(n, int((y == c).sum()))])
        most += np.minimum(held, (total[n:] - total[:-n])[: len(b) + n - 1])
    size = np.minimum(np.arange(1, len(b) + n), n)
    size = np.minimum(size, size[::-1])
    bound, best = 200.0 * most / (n + size), 0.0
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] <= best:
            break
        best = max(best, ratio_of(a, b[max(0, k + 1 - n) : k + 1]))
    return best


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)], dtype=float)

    return pandas_udf(run, "double")


def ratio(a, b):
    """``ratio_of`` two columns; made on call, since workers import this module too."""
    return _pairwise(ratio_of)(a, b)


def partial_ratio(a, b):
    return _pairwise(partial_of)(a, b)


def best_choice(choices: list[str], least: float = 80.0):
    """A UDF from folded text to the choice with the best ratio, null below ``least``."""
    from .text import _folds

    table = str.maketrans(*_folds())
    folded = [c.translate(table).lower().strip() for c in choices]

    @pandas_udf("string")
    def pick(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            if k is None:
                out.append(None)
                continue
            best = max(((ratio_of(k, f), -i) for i, f in enumerate(folded)), default=(0.0, 0))
            out.append(choices[-best[1]] if best[0] >= least else None)
        return pd.Series(out, dtype=object)

    return pick
