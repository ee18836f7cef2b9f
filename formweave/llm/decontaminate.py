"""Operator 5: benchmark decontamination by SimHash windows of the items' sizes.

Texts and items are words in lower case. A window is as many words as an item has; windows that
share no 5-word shingle with any item have similarity zero and are passed over by a rolling hash.
The others get a SimHash of their words, and a multi-index over the items' fingerprints finds all
within the radius: with m blocks and radius r, two fingerprints within r bits differ in at most r/m
bits in some block, and every block's table lists the items for each value so near. Those candidates
are verified by the exact weighted share of the item's shingles that the window holds.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, lean

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 16, 8
#: Characters of the items that one index holds; a larger benchmark is searched index by index.
INDEX_CHARS = 16_000_000

_words = re.compile(r"\w+").findall
#: Odd multipliers of the rolling hash, one for each place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(SHINGLE)], np.uint64)
_NEAR = [np.array([v for v in range(256) if (v ^ u).bit_count() <= RADIUS // BLOCKS], np.uint8) for u in range(256)]


def words(text: str) -> list[str]:
    return _words(text.lower())


def grams(tokens: list[str] | tuple[str, ...]) -> list[tuple[str, ...]]:
    return list(zip(*(tokens[j:] for j in range(min(SHINGLE, len(tokens))))))


def hashes(tokens: list[str]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in tokens], np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * _PLACES[j]
    return out


def window_fingerprints(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at ``starts``: a bit is set if over half the words have it."""
    out = []
    for part in np.split(starts, np.nonzero(np.diff(starts) > size)[0] + 1):
        for at in range(0, len(part), 2048):
            s = part[at : at + 2048]
            bits = np.unpackbits(h[s[0] : s[-1] + size].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
            ones = total[s - s[0] + size] - total[s - s[0]]
            out.append(np.packbits(ones * 2 > size, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out)


@dataclass
class _Item:
    item_id: int
    ids: list[int]
    size: int
    grams: Counter
    total: float


class BenchmarkIndex:
    """Items of one bounded part of the benchmark, equal ones (after normalising) once.

    ``spread`` has the number of items in the whole benchmark for shingles that several hold; without it,
    the rows are the whole.
    """

    def __init__(self, rows: list[tuple[int, str]], spread: dict[tuple[str, ...], int] | None = None):
        same: dict[tuple[str, ...], list[int]] = {}
        for i, text in rows:
            if w := words(text or ""):
                same.setdefault(tuple(w), []).append(i)
        self.items, fps, shingles = [], [], {}
        counts = [Counter(grams(w)) for w in same]
        if spread is None:
            spread = Counter(g for c in counts for g in c)
        self.weight = {g: 1.0 / spread.get(g, 1) for c in counts for g in c}
        for k, ((w, ids), held) in enumerate(zip(same.items(), counts)):
            self.items.append(_Item(min(ids), sorted(set(ids)), len(w), held, sum(self.weight[g] * n for g, n in held.items())))
            h, n = hashes(list(w)), min(SHINGLE, len(w))
            fps.append(window_fingerprints(h, np.array([0]), len(w))[0])
            for g in np.unique(rolling(h, n)).tolist():
                shingles.setdefault(n, {}).setdefault(g, set()).add(len(w))
        self.fps = np.array(fps, np.uint64)
        # For each shingle length: sorted hashes, the item sizes behind each, and a bit table that rules most out.
        self.shingles = {}
        for n, by in shingles.items():
            keys = np.array(sorted(by), np.uint64)
            table = np.zeros(1 << 16, bool)
            table[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.shingles[n] = keys, [sorted(by[int(x)]) for x in keys], table
        # For each item size and block: the items whose block is within radius / blocks bits of a value.
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for k, item in enumerate(self.items):
            t = self.tables.setdefault(item.size, [{} for _ in range(BLOCKS)])
            for j, u in enumerate(self.fps[k : k + 1].view(np.uint8).tolist()):
                for v in _NEAR[u].tolist():
                    t[j].setdefault(v, []).append(k)

    def _windows(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """For each item size: starts of the windows that share a shingle with an item of that size."""
        marks: dict[int, list[tuple[int, int]]] = {}
        for n, (keys, sizes, table) in self.shingles.items():
            r = rolling(h, n)
            at = np.nonzero(table[(r >> np.uint64(48)).astype(np.int64)])[0]
            where = np.minimum(np.searchsorted(keys, r[at]), len(keys) - 1)
            hit = keys[where] == r[at]
            for p, k in zip(at[hit].tolist(), where[hit].tolist()):
                for size in sizes[k]:
                    w = min(size, len(h))
                    marks.setdefault(size, []).append((max(0, p + n - w), min(p, len(h) - w)))
        out = {}
        for size, spans in marks.items():
            edge = np.zeros(len(h) + 2, np.int64)
            lo, hi = np.array(spans).T
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi + 1, -1)
            out[size] = np.nonzero(np.cumsum(edge) > 0)[0]
        return out

    def matches(self, text: str) -> list[tuple[int, list[int], float, int, int]]:
        """(item id, ids of equal items, similarity, distance, first word) of the items that the text holds, best window each."""
        tokens = words(text)
        if not tokens or not self.items:
            return []
        h, found = hashes(tokens), {}
        for size, starts in self._windows(h).items():
            w = min(size, len(h))
            fps, tables = window_fingerprints(h, starts, w), self.tables[size]
            near: list[tuple[int, int, int]] = []
            blocks = fps.view(np.uint8).reshape(-1, BLOCKS)
            for q, row in enumerate(blocks.tolist()):
                cand = set().union(*(t.get(v, ()) for t, v in zip(tables, row)))
                if cand:
                    k = np.fromiter(cand, np.int64)
                    d = np.bitwise_count(self.fps[k] ^ fps[q])
                    near += [(int(x), int(y), int(starts[q])) for x, y in zip(d, k) if x <= RADIUS]
            for d, k, s in sorted(near):
                if k in found and found[k][0] >= 1.0 - 1e-9:
                    continue
                item, n = self.items[k], min(SHINGLE, size)
                held = Counter(g for g in zip(*(tokens[s + j : s + w - n + 1 + j] for j in range(n))) if g in item.grams)
                sim = sum(self.weight[g] * min(c, item.grams[g]) for g, c in held.items()) / item.total
                if sim >= SIMILARITY - 1e-12 and (k not in found or sim > found[k][0]):
                    found[k] = (sim, d, s)
        return sorted((self.items[k].item_id, self.items[k].ids, sim, d, s) for k, (sim, d, s) in found.items())


def indexes(benchmark: DataFrame, most: int = INDEX_CHARS) -> list[BenchmarkIndex]:
    """The benchmark in indexes of about ``most`` characters, by a hash of the words; shingles weigh as in the whole benchmark."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    if n == 1:
        return [BenchmarkIndex(sorted((r.item_id, r.text) for r in rows.toLocalIterator()))]

    def run(batches):
        for b in batches:
            held = [words(t) for t in b.column(1).to_pylist()]
            norms = [" ".join(w) for w in held]
            parts = [xxhash.xxh64_intdigest(x) % n for x in norms]
            shingles = [sorted({" ".join(g) for g in grams(w)}) for w in held]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(norms, pa.string()), pa.array(parts, pa.int32()), pa.array(shingles, pa.list_(pa.string()))], ["item_id", "text", "norm", "part", "grams"]
            )

    scratch = Scratch(benchmark.sparkSession, "benchmark")
    items = scratch.cut(rows.mapInArrow(lean(run), "item_id long, text string, norm string, part int, grams array<string>"), "items")
    once = items.groupBy("norm").agg(F.first("part").alias("part"), F.first("grams").alias("grams")).select("part", F.explode("grams").alias("gram"))
    # Counts of each part first, then of all: a shingle that every item holds makes one row for each part.
    each = scratch.cut(once.groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n")), "each")
    several = each.groupBy("gram").agg(F.sum("n").alias("items")).where("items > 1")
    several = scratch.cut(each.select("part", "gram").join(several, "gram"), "several")
    out = []
    for k in range(n):
        spread = {tuple(r.gram.split(" ")): r["items"] for r in several.where(F.col("part") == k).toLocalIterator()}
        mine = items.where(F.col("part") == k).select("item_id", "text").toLocalIterator()
        out.append(BenchmarkIndex(sorted((r.item_id, r.text) for r in mine), spread))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, item_ids, similarity, distance, start_word)``: items that whole texts hold.

    One row per document and distinct item (equal items share a row; ``item_id`` is the smallest of
    ``item_ids``). Null and wordless texts and items match nothing; items of fewer than five words
    count as one shingle; a text shorter than an item is one window. Repeated rows give repeated
    results. An empty benchmark gives no rows. No shuffle.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    names = ["doc_id", "item_id", "item_ids", "similarity", "distance", "start_word"]
    schema = "doc_id long, item_id long, item_ids array<long>, similarity double, distance int, start_word int"
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for m in shared.value.matches(t)]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)
        out = got if out is None else out.unionByName(got)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; other columns are carried through as they are."""
    spark = docs.sparkSession
    bound_batches(spark)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([not (t and shared.value.matches(t)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
