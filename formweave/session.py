"""Sessions for this package: builder defaults, and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="formweave-code-"), "formweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, base))
    spark.sparkContext.addPyFile(path)


#: Bytes of an Arrow batch sent to a Python worker, so that long texts and images stay in memory.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Make ready for Python workers: the package is shipped, and Arrow batches are bounded by bytes
    besides rows, since a batch of long texts or images must not be large."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or int(now.rstrip("bB")) > BATCH_BYTES or int(now.rstrip("bB")) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "formweave") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
