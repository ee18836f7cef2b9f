"""Operator 1: exact top-k search by inner product with a pivot-distance index.

Vectors are whole numbers. Each is keyed by its nearest pivot and its distance to it; sorted by
(length, pivot, distance) they are cut into blocks, each a thin annulus about a pivot. With
|q - x| >= ||q - p| - |x - p|| the inner product obeys

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + max|x|^2 - gap^2) / 2

where gap is how far the query's distance to the pivot lies outside the annulus. A query first
searches the annuli with its best bounds; with the k-th best score found there it goes on, and stops
at every annulus whose bound is lower. Nothing is dropped on the way: the bounds are proven, scores
are exact integers, and equal scores go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

#: Rows that pivots are fitted on; pivots of a vector length are half the square root of all rows, within these bounds.
SAMPLE_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 4096, 16, 256
#: Blocks in all, but for one more a pivot and partition: what the driver holds of the index is bounded.
MOST_BLOCKS = 100_000
BLOCK_ROWS, QUERY_ROWS = 2048, 256
#: Blocks whose bounds are reckoned at once.
PAGE = 4096
#: Products of lengths below which inner products fit in a double, and in 64 bits, and the size that a component takes no part above.
EXACT, WHOLE, LARGEST = 2.0**52, 2.0**62, 2.0**62


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``(vec_id, v)``: floor(scale * component) as whole numbers.

    Vectors that are null, empty, hold a null or non-finite component, or one that doesn't fit in
    63 bits after scaling take no part, nor do null ids.
    """
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_v"), x.alias("x"))
    good = F.size("_v") > 0
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    short = F.forall("x", lambda c: F.abs(c) < F.lit(LARGEST))
    return rows.where(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & good & finite & short).select("vec_id", F.transform("x", lambda c: c.cast("long")).alias("v"))


def fit_pivots(vectors: DataFrame, n: int, rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Pivots for each vector length, by a few rounds of k-means on a bounded sample in hash order."""
    out, got = {}, vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("v").collect()
    by: dict[int, list] = {}
    for (v,) in got:
        by.setdefault(len(v), []).append(v)
    for dim, group in by.items():
        x = np.unique(np.array(group, float), axis=0)
        c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
        for _ in range(8):
            near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
            c = np.stack([np.rint(x[near == k].mean(0)) if (near == k).any() else c[k] for k in range(len(c))])
        out[dim] = c
    return out


def _matrix(column, rows) -> np.ndarray:
    """The vectors at ``rows`` (all of one length) as a matrix of whole numbers."""
    return np.stack([column[int(k)].values.to_numpy() for k in rows])


def assign(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(vec_id, dim, pivot, dist, norm2, v)``: nearest pivot and distance to it; lengths no pivot is of get the origin."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    names = ["vec_id", "dim", "pivot", "dist", "norm2", "v"]

    def run(batches):
        for b in batches:
            dims = np.array([len(x) for x in b.column(1)])
            pivot, dist, norm = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                x, p = _matrix(b.column(1), at).astype(float), shared.value.get(int(dim), np.zeros((1, dim)))
                d2 = np.stack([((x - q) ** 2).sum(1) for q in p], axis=1)
                pivot[at], dist[at], norm[at] = d2.argmin(1), np.sqrt(d2.min(1)), (x * x).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims.astype(np.int32)), pa.array(pivot), pa.array(dist), pa.array(norm), b.column(1)], names)

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, dim int, pivot int, dist double, norm2 double, v array<long>")


def _shrink(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them; readers get the width back from the length."""
    low, high = x.min(), x.max()
    return x.astype(next((t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max), np.int64))


def _widen(data: bytes, n: int, dim: int) -> np.ndarray:
    """``n`` packed vectors as they went into ``_shrink``."""
    return np.frombuffer(data, f"i{len(data) // (n * dim)}").reshape(n, dim).astype(np.int64)


def pack(rows: DataFrame, size: int, base: str) -> DataFrame:
    """Rows sorted by (dim, pivot, dist) to blocks of ``size`` at most: bounds, ids and the matrix, row by row.

    Ranges end at any (dim, pivot, dist, vec_id), so a pivot that holds a third of all rows spreads
    over many partitions. Rows that repeat id and vector are neighbours and count once.
    """
    order = ["dim", "pivot", "dist", "vec_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["block", "dim", "pivot", "lo", "hi", "norm2", "n", "ids", "data"]

    def run(batches):
        from pyspark import TaskContext

        number, held, key, last = TaskContext.get().partitionId() << 32, [], None, None

        def block():
            nonlocal number, held
            ids, dist, norm, data = zip(*held)
            out = [number, *key, min(dist), max(dist), max(norm), len(held), np.array(ids).tobytes(), _shrink(np.concatenate(data)).tobytes()]
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names).cast(_BLOCK)

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(5)]
            for k, (i, dim, pivot, dist, norm) in enumerate(zip(*cols)):
                v = b.column(5)[k].values.to_numpy()
                if last is not None and last[0] == i and np.array_equal(last[1], v):
                    continue
                last = (i, v)
                if held and (key != (dim, pivot) or len(held) >= size):
                    yield block()
                key = (dim, pivot)
                held.append((i, dist, norm, v))
        if held:
            yield block()

    return rows.select("vec_id", "dim", "pivot", "dist", "norm2", "v").mapInArrow(run, base)


_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("norm2", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
_SCHEMA = "block long, dim int, pivot int, lo double, hi double, norm2 double, n int, ids binary, data binary"


def _bounds(q: np.ndarray, meta: dict[str, np.ndarray], pivots: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products: queries by blocks."""
    d = np.sqrt(((q[:, None, :] - pivots[None, :, :]) ** 2).sum(2))[:, meta["pivot"]]
    gap = np.maximum(0, np.maximum(d - meta["hi"], meta["lo"] - d))
    gap = np.maximum(0, gap * (1 - 1e-9) - 1e-6)
    bound = ((q * q).sum(1)[:, None] + meta["norm2"][None, :] - gap * gap) / 2
    return np.minimum(bound, np.sqrt((q * q).sum(1)[:, None] * meta["norm2"][None, :])) * (1 + 1e-9 * np.sign(bound)) + 1


def _pairs(queries: DataFrame, meta: dict, pivots: dict, floors: DataFrame | None, first: int) -> DataFrame:
    """``(block, qblock)`` to compare: the best annuli of each query, or all whose bound reaches its floor."""
    shared, seeded = queries.sparkSession.sparkContext.broadcast((meta, pivots)), floors is not None

    def run(batches):
        metas, pivs = shared.value
        for b in batches:
            for k in range(b.num_rows):
                dim, n = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                if dim not in metas:
                    continue
                m = metas[dim]
                q = _widen(b.column(3)[k].as_py(), n, dim).astype(float)
                if seeded:
                    low = dict(zip(b.column(4)[k].as_py() or [], b.column(5)[k].as_py() or []))
                    ids = np.frombuffer(b.column(6)[k].as_py(), np.int64)
                    low = np.array([low.get(int(i), -np.inf) for i in ids], float)
                    low = (low - 1 - 1e-9 * np.abs(low))[:, None]
                used, best = [], (np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64))
                for at in range(0, len(m["block"]), PAGE):
                    bound = _bounds(q, {name: v[at : at + PAGE] for name, v in m.items()}, pivs.get(dim, np.zeros((1, dim))))
                    if seeded:
                        used.append(at + np.nonzero((bound >= low).any(axis=0))[0])
                        continue
                    bound = np.concatenate([best[0], bound], 1)
                    number = np.concatenate([best[1], np.broadcast_to(np.arange(at, at + bound.shape[1] - best[1].shape[1]), (len(q), bound.shape[1] - best[1].shape[1]))], 1)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, :first]
                    best = np.take_along_axis(bound, order, 1), np.take_along_axis(number, order, 1)
                use = np.concatenate(used) if seeded else np.unique(best[1])
                yield pa.RecordBatch.from_arrays([pa.array(m["block"][use]), pa.array(np.full(len(use), b.column(0)[k].as_py()))], ["block", "qblock"])

    cols = ["block", "dim", "n", "data"]
    if seeded:
        queries = queries.join(floors, "block", "left")
        cols += ["low_id", "low", "ids"]
    return queries.select(*cols).mapInArrow(run, "block long, qblock long")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles or 64-bit integers where they fit, else in integers of any size, held to 64 bits in the end."""
    most = np.sqrt(float((q.astype(float) ** 2).sum(1).max()) * float((x.astype(float) ** 2).sum(1).max()))
    if most < EXACT:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < WHOLE:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def _search(pairs: DataFrame, blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the k best of each query in each block it is paired with."""
    side = queries.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    work = pairs.join(blocks.select("block", "dim", "ids", "data"), "block").join(side, "qblock")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                ids, qids = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in (1, 3))
                x, q = _widen(b.column(2)[r].as_py(), len(ids), dim), _widen(b.column(4)[r].as_py(), len(qids), dim)
                s = _products(q, x)
                out = []
                for i in range(len(qids)):
                    use = np.nonzero(ids != qids[i])[0]
                    if not len(use):
                        continue
                    own = s[i, use]
                    if len(use) > k:
                        least = np.partition(own, len(own) - k)[len(own) - k]
                        use, own = use[own >= least], own[own >= least]
                    best = np.lexsort((ids[use], -own))[:k]
                    out.append((np.full(len(best), qids[i]), ids[use][best], own[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return work.select("dim", "ids", "data", "qids", "qdata").mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query. Blocks give k rows each, and Spark limits each task's before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows that ``is_query`` (over ``vec_id``) holds for, against all other rows.

    Fewer candidates than ``k`` give them all. Vectors are compared with vectors of their length
    only. Rows that repeat id and vector count once; rows with a query's own id are no candidates
    of it. An id with several vectors is a candidate with each, and as a query it has the k best
    over all of them. A score beyond 64 bits stands as the nearest number that fits. No rows give no
    rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    bound_batches(spark)
    whole = scratch.cut(quantise(vectors, id_col, vector_col), "vectors")
    rows = whole.count()
    pivots = fit_pivots(whole, int(min(MOST_PIVOTS, max(LEAST_PIVOTS, rows**0.5 / 2))))
    keyed = assign(whole, pivots)
    size = max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))
    blocks = scratch.cut(pack(keyed, size, _SCHEMA), "blocks")
    queries = scratch.cut(pack(keyed.where(is_query), QUERY_ROWS, _SCHEMA), "queries")
    meta: dict[int, dict] = {}
    for r in blocks.select("block", "dim", "pivot", "lo", "hi", "norm2").orderBy("block").collect():
        for name in ("block", "pivot", "lo", "hi", "norm2"):
            meta.setdefault(r.dim, {}).setdefault(name, []).append(r[name])
    meta = {d: {n: np.array(v) for n, v in m.items()} for d, m in meta.items()}
    first = _best(_search(_pairs(queries, meta, pivots, None, 2), blocks, queries, k), k)
    low = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    low = scratch.cut(low.select("query_id", "low"), "floors")

    def members(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids = np.unique(np.frombuffer(b.column(1)[r].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b.column(0)[r].as_py())), pa.array(ids)], ["block", "query_id"])

    of = queries.select("block", "ids").mapInArrow(members, "block long, query_id long")
    floors = of.join(low, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "low")).alias("f")).select("block", F.col("f.query_id").alias("low_id"), F.col("f.low").alias("low"))
    return _best(_search(_pairs(queries, meta, pivots, floors, 0), blocks, queries, k), k)
