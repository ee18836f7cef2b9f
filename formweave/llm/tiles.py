"""Tiles: bounded arrays of fingerprints per key, and the pairs of tiles to compare."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(rows: DataFrame, key: str, spread: str, value, size: int) -> DataFrame:
    """``(key, sub, n_sub, items)``: the rows of each key in tiles of about ``size`` rows.

    ``spread`` is a hashed column that deals a key's rows into its tiles; the number of tiles
    comes from the key's count, so a key of any size is split.
    """
    counts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("n_sub"))
    return (
        rows.join(counts, key)
        .withColumn("sub", F.pmod(F.xxhash64(spread), F.col("n_sub")).cast("int"))
        .groupBy(key, "sub")
        .agg(F.first("n_sub").alias("n_sub"), F.collect_list(value).alias("items"))
    )


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect the same nodes: each node and the least node it reaches."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    node = np.nonzero(label != np.arange(n))[0]
    return node, label[node]


def near_in_pieces(a: np.ndarray, b: np.ndarray, radius: int, same: bool, cells: int = 1 << 18):
    """Index pairs whose fingerprints differ in at most ``radius`` bits, by exclusive-or and bit count, from ``cells`` comparisons at a time."""
    step = max(1, cells // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``near_in_pieces``."""
    pieces = [*near_in_pieces(a, b, radius, same)]
    return (np.concatenate([i for i, _ in pieces]), np.concatenate([j for _, j in pieces])) if pieces else (np.zeros(0, int), np.zeros(0, int))
