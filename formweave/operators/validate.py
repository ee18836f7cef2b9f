"""Field status: required, format, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_fields(fields: DataFrame, specs: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """``fields(doc_id, name, value, confidence, status, warnings)`` with status and warnings settled.

    A required field without a value is missing, and nothing else is said of it. Warnings make an ok
    field invalid; a confidence above 0 but under the threshold (the spec's, 0 counting as unset)
    marks one that is still ok. Fields without a spec use the defaults.
    """
    s = specs.select(F.col("name"), F.col("required"), F.col("min_confidence").alias("_least"))
    j = fields.join(F.broadcast(s), "name", "left")
    empty = F.coalesce(F.trim(F.col("value").cast("string")), F.lit("")) == ""
    least = F.when(F.coalesce("_least", F.lit(0.0)) > 0, F.col("_least")).otherwise(F.lit(min_confidence))
    absent = F.coalesce("required", F.lit(False)) & empty
    invalid = F.size("warnings") > 0
    low = ~empty & (F.col("confidence") > 0) & (F.col("confidence") < least)
    ok = F.col("status") == "ok"
    status = F.when(absent, "missing").when(ok & invalid, "invalid_format").when(ok & low, "low_confidence").otherwise(F.col("status"))
    notes = F.when(absent, F.array_append("warnings", F.lit("required field is missing"))).when(low, F.array_append("warnings", F.lit("low confidence"))).otherwise(F.col("warnings"))
    return j.withColumns({"status": status, "warnings": notes}).select(*fields.columns)
