"""The batch flow as a stream: new JSON documents are checked as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import Catalogue, check, rollup
from ..sources.files import facts


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """``(doc_id, body)`` of JSON files in a folder, one document a file."""
    df = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return df.select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("doc_id"), F.col("value").alias("body"))


def check_stream(spark: SparkSession, source: str, target: str, checkpoint: str, catalogue: Catalogue) -> StreamingQuery:
    """Write a report row per document under ``target``; a batch that runs again overwrites its own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        f = facts(batch)
        docs = batch.select("doc_id", F.coalesce(F.try_variant_get(F.try_parse_json("body"), "$.form_id", "string"), F.try_variant_get(F.try_parse_json("body"), "$.form_type", "string")).alias("form_id"))
        rollup(docs, check(docs, f, catalogue)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream_documents(spark, source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
