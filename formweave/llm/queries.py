"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, exact_topk, language_id, license_scan, line_dedup, quality, simhash_dedup, token_files, toxicity
from .common import Scratch, crc_fold, table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated, as its SQL is."""
    return license_scan.scan(table(spark, sf_dir, "documents"), gated=True)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode_too=True)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.dedup_lines(docs.select("doc_id", "text"), banded=True)
    lines = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select("doc_id", lines.alias("lines_left"), F.length("text").alias("chars_left"), F.md5("text").alias("text_md5"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no label and isn't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc_fold(F.col("doc_id"), 5) != 0))
    found = toxicity.detect(docs, model)
    return found.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), radius=3, words=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is neither learnt from nor held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, crc_fold(F.col("doc_id"), 3) != 1)
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokens").path("files")
    shards = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return token_files.read_token_files(spark, shards)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk, op2_license_scan, op3_byte_bpe, op4_quality, op5_decontaminate, op6_line_dedup, op7_toxicity, op8_simhash_dedup, op9_language_id, op10_token_files,
    )
}

#: Integer inner products of every query with every other vector; ranks by score, then id.
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def oracle() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op2_license_scan": license_scan.scan_sql()}
