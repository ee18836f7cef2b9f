"""Readers: page images, JSON documents, rule catalogues, field specs, configuration."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import FieldSpec
from ..operators.rules import Catalogue, Rule

IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
BATCH = ("pdf", "png", "jpg", "jpeg")


def files(spark: SparkSession, path: str, recursive: bool = False, suffixes: tuple[str, ...] = BATCH) -> DataFrame:
    """``(path, suffix, length, content)`` of a directory's files; content is read only where it is used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df.select("path", F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1)).alias("suffix"), "length", "content")
    return df.where(F.col("suffix").isin(*suffixes))


def unsupported(spark: SparkSession, path: str) -> DataFrame:
    """``(path, error)`` of files that are neither PDF nor a known image."""
    df = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1)).alias("suffix"))
    return df.where(~F.col("suffix").isin("pdf", *IMAGES)).select("path", F.concat(F.lit("unsupported file type: "), "suffix").alias("error"))


def json_documents(spark: SparkSession, path: str, pattern: str = "expect_*.json") -> DataFrame:
    """``(path, number, body)``, one row a file, in no order."""
    df = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(path)
    p = F.input_file_name()
    return df.select(p.alias("path"), F.regexp_extract(p, "([0-9]+)[^/0-9]*[.]json$", 1).alias("number"), F.col("value").alias("body"))


def pair(gold: DataFrame, inputs: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """Gold documents that have an input of the same number; ``forms`` keeps some numbers only."""
    n = inputs.select(F.regexp_extract("path", "([0-9]+)[^/0-9]*[.][^./]+$", 1).alias("number"))
    g = gold.where(F.col("number").isin(*forms)) if forms else gold
    return g.join(n, "number", "left_semi")


def facts(documents: DataFrame) -> DataFrame:
    """``(doc_id, form_id, key, value, kind)`` from ``(doc_id, body)``: the entries of ``results`` with the kind JSON gave them."""
    d = documents.select("doc_id", F.try_parse_json("body").alias("v"))
    form = F.coalesce(F.try_variant_get("v", "$.form_id", "string"), F.try_variant_get("v", "$.form_type", "string"))
    entries = F.from_json(F.to_json(F.try_variant_get("v", "$.results", "variant")), "map<string,variant>")
    e = d.select("doc_id", form.alias("form_id"), F.explode(entries).alias("key", "value"))
    kind = F.schema_of_variant("value")
    named = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "number").otherwise("other")
    return e.select("doc_id", "form_id", "key", F.try_variant_get("value", "$", "string").alias("value"), named.alias("kind"))


def catalogue(folder: str) -> Catalogue:
    """Every ``<form>.yaml`` of a folder: ``fields`` (alias to key suffix) and ``rules``. No folder gives no rules."""
    import yaml

    selectors, rules = {}, []
    for path in sorted(Path(folder).glob("*.yaml")):
        raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        selectors[path.stem] = dict(raw.get("fields") or {})
        rules += [rule_of(path.stem, r) for r in raw.get("rules") or []]
    return Catalogue(selectors, tuple(rules))


def rule_of(form: str, raw: dict) -> Rule:
    """A rule from its mapping; KeyError where an operand is missing."""
    op = raw["operation"]
    operands = {
        "equals_product": lambda: (raw["actual"], *raw["factors"]),
        "sum_equals": lambda: (raw["total"], *raw["parts"]),
        "less_or_equal": lambda: (raw["left"], raw["right"]),
        "date_order": lambda: (raw["earlier"], raw["later"]),
        "years_between": lambda: (raw["start"], raw["end"], raw["years"]),
    }.get(op, tuple)()
    rest = {k: raw[k] for k in ("title", "severity", "message", "relative_tolerance", "absolute_tolerance", "tolerance_days", "null_as_zero", "mutation_alias", "mutation_side", "eval_mutation") if k in raw}
    return Rule(form_type=form, id=raw["id"], operation=op, operands=operands, **rest)


def field_specs(path: str) -> list[FieldSpec]:
    """Specs of a YAML file's ``fields`` list."""
    import yaml

    return [FieldSpec.of(f) for f in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("fields", [])]


def config(path: str | None = None, defaults: dict | None = None, overrides: dict | None = None, prefix: str = "FORMWEAVE_") -> dict:
    """Settings: dotted overrides, then environment (``FORMWEAVE_OCR__ENGINE``), then YAML, then defaults."""
    import yaml

    out = _merge({}, defaults or {})
    if path:
        out = _merge(out, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    given = {k[len(prefix) :].lower().replace("__", "."): v for k, v in os.environ.items() if k.startswith(prefix)}
    for key, value in [*given.items(), *(overrides or {}).items()]:
        nested = value
        for part in reversed(key.split(".")):
            nested = {part: nested}
        out = _merge(out, nested)
    return out


def _merge(a: dict, b: dict) -> dict:
    return a | {k: _merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}
