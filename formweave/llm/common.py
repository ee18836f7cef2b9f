"""Helpers that the operators of this subpackage share.

``Scratch`` cuts lineage with tables written to the folder the cluster names in
``spark.checkpoint.dir``; every executor can read them back, so losing one costs a
recomputation at most.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches

_OWN: dict[str, str] = {}

#: With this setting the shuffle files of a query go when it ends. Without, they stay until the driver
#: happens to collect its garbage, and several jobs' files lie on the disks at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder of this machine only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="formweave-"))
    return base.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run under the shared folder."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self._n = 0
        bound_batches(spark)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and give it back as read from the written table; the write's shuffle files are gone then."""
        path, conf = self.path(name), self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._fw_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing to come reads."""
        for df in tables:
            remove(self.spark, df._fw_path)


def lean(run):
    """``run`` over batches, giving memory it is done with back to the machine: workers live on and do other stages."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # Another C library, which has no such call.

    return outer


def crc_fold(col: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``n`` (null for a null id)."""
    return F.crc32(col.cast("string")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int, scratch: Scratch) -> list[tuple[int, str, object]]:
    """A bounded training sample: [(doc_id, whole text, label)] on the driver.

    ``labels`` has ``doc_id, label``; null ids and labels are dropped and an id counts once
    (its smallest label and its smallest text, whatever number of rows it has). Ids are taken
    in the order of a hash, at most ``max_rows``, and documents are kept in that order while
    their texts add up to ``max_chars`` at most; a text is whole or absent.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col("label").alias("_label"))
        .where("_id is not null and _label is not null")
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(max_rows)
    )
    least: dict = {}
    for i, label in ids.collect():
        least[i] = min(label, least.get(i, label))
    ids = docs.sparkSession.createDataFrame([*least.items()], ids.schema)
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(ids), "_id")
    rows = scratch.cut(rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")), "sample")
    sizes = rows.select("_id", F.length("_text").alias("n"), F.xxhash64("_id").alias("h")).collect()
    take, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r._id)):
        if total + r.n <= max_chars:
            total += r.n
            take.append((r._id,))
    if not take:
        return []
    chosen = docs.sparkSession.createDataFrame(take, "_id long")
    got = rows.join(F.broadcast(chosen), "_id").collect()
    scratch.drop(rows)
    return sorted((r._id, r._text, r._label) for r in got)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def gram_profile(data: bytes, n: int, bits: int, chunk: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed byte n-grams of ``data`` in ``2**bits`` bins; memory is bounded by ``chunk``."""
    out = np.zeros(1 << bits, dtype=np.int64)
    if len(data) < n:
        data = data + b" " * (n - len(data)) if data else data
    for at in range(0, max(len(data) - n + 1, 0), chunk):
        b = np.frombuffer(data[at : at + chunk + n - 1], dtype=np.uint8).astype(np.uint32)
        h = b[: len(b) - n + 1].copy()
        for k in range(1, n):
            h *= np.uint32(0x01000193)
            h ^= b[k : len(b) - n + 1 + k]
        h *= np.uint32(0x9E3779B1)
        out += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def unit_profile(data: bytes, n: int, bits: int) -> np.ndarray:
    """Square roots of ``gram_profile``, at length one (all zero for no bytes)."""
    x = np.sqrt(gram_profile(data, n, bits).astype(np.float32))
    norm = float(np.sqrt((x * x).sum()))
    return x / norm if norm else x


def adam(grad, params: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise with Adam; ``grad(params)`` gives the gradient."""
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        g = grad(params)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params
