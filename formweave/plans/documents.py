"""Whole flows over lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, extract, forms, rules, shipped, validate


def process(lines: DataFrame, known: list[forms.Form], form: str | None = None) -> DataFrame:
    """Lines to ``(doc_id, body)``: form detection unless one is given, the form's rules, assembling.

    One branch a form, each over the documents of that form alone.
    """
    pages = forms.generic(lines)
    texts = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    named = texts.withColumn("form", F.lit(form)) if form else texts.join(forms.classify(texts, known).select("doc_id", "form"), "doc_id")
    out = None
    for f in [*known, forms.Form("generic")]:
        part = forms.apply_rules(named.where(F.col("form") == f.name), f)
        out = part if out is None else out.unionByName(part)
    return forms.assemble(out.withColumn("status", F.lit("ok")).withColumn("warnings", F.array().cast("array<string>")))


def process_specs(lines: DataFrame, specs: list[extract.FieldSpec], min_confidence: float = 0.6, pages: DataFrame | None = None) -> DataFrame:
    """Lines, and pages for what is read off images, to validated fields by declarative specs."""
    fields = extract.normalise(extract.extract(lines, specs, pages), specs)
    return validate.validate_fields(fields, extract.spec_table(lines.sparkSession, specs), min_confidence)


def comply(documents: DataFrame, facts: DataFrame, catalogue: rules.Catalogue | None = None) -> DataFrame:
    """A compliance report row per document, by the shipped rules unless others are given."""
    catalogue = catalogue or shipped.catalogue()
    return rules.rollup(documents, rules.check(documents, facts, catalogue))


def evaluate(gold: DataFrame, pred: DataFrame, form_of: DataFrame) -> DataFrame:
    """Metrics by field, form and overall; ``form_of(doc_id, form_type)``."""
    return evaluation.aggregate(evaluation.compare_documents(gold, pred).join(form_of, "doc_id"))
