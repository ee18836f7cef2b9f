"""Writers: JSON documents, evaluation tables, compliance reports.

Documents and outcomes are written by the executors. Reports are rendered on the driver from
aggregates, whose size is that of the catalogue of forms and fields.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(documents: DataFrame, path: str, partition_by: str | None = None) -> None:
    """``body`` as a line of JSON for each document."""
    w = documents.select("body", *([partition_by] if partition_by else [])).write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).text(path)


def eval_csv(aggregate: DataFrame, path: str) -> None:
    """The per-field table as one file."""
    eval_table(aggregate).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def eval_table(aggregate: DataFrame) -> DataFrame:
    """Per-field rows in the twelve columns of the evaluation file, sorted by field, ratios at four digits."""
    four = lambda c, name: F.round(c, 4).alias(name)
    columns = [
        F.col("path").alias("field"), "n", F.col("n_exact").alias("exact"), four("accuracy", "accuracy"), four("mean_similarity", "mean_similarity"),
        four("precision", "precision"), four("recall", "recall"), four("f1", "f1"), "missing", "extra", "ocr_error", "format_error",
    ]
    return aggregate.where("path is not null").select(*columns).orderBy("field")


def write_evaluation(aggregate: DataFrame, folder: str, kind: str) -> list[str]:
    """Both files of an evaluation, ``eval_<kind>.md`` and ``eval_<kind>.csv``, in a folder of the driver; their paths."""
    import csv
    from pathlib import Path

    table = eval_table(aggregate)
    out = [Path(folder) / f"eval_{kind}.{suffix}" for suffix in ("md", "csv")]
    out[0].parent.mkdir(parents=True, exist_ok=True)
    out[0].write_text(eval_markdown(aggregate), encoding="utf-8")
    with out[1].open("w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([table.columns, *table.collect()])
    return [str(p) for p in out]


def eval_markdown(aggregate: DataFrame) -> str:
    rows = aggregate.collect()
    head = "| {} | n | accuracy | precision | recall | F1 |\n|---|--:|--:|--:|--:|--:|"
    line = lambda name, r: f"| {name} | {r.n} | {r.accuracy:.1%} | {r.precision:.1%} | {r.recall:.1%} | {r.f1:.1%} |"
    out = ["# Evaluation", "", head.format("overall"), *[line("all", r) for r in rows if r.path is None and r.form_type is None]]
    out += ["", head.format("form"), *[line(r.form_type, r) for r in sorted((r for r in rows if r.form_type is not None), key=lambda r: r.form_type)]]
    out += ["", head.format("field"), *[line(r.path, r) for r in sorted((r for r in rows if r.path is not None), key=lambda r: (r.accuracy, r.path))]]
    return "\n".join(out) + "\n"


def compliance_markdown(form_type: str, overall: str, summary: str, checks: list) -> str:
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    out = [f"# Compliance report: {form_type}", "", f"State: **{overall}**", "", summary, "", "| rule | severity | state | actual | expected | message |", "|---|---|---|---|---|---|"]
    out += ["| " + " | ".join(map(cell, (c.rule_id, c.severity, c.status, c.actual, c.expected, c.message))) + " |" for c in checks]
    return "\n".join(out) + "\n"


# The names of the package format.
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
_KINDS = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"}


def compliance_docx(form_type: str, overall: str, summary: str, checks: list) -> bytes:
    """The report as a word processor's document: headings, the summary, and a table with a row for each check."""
    w = lambda name: f"{{{_WORD}}}{name}"
    root = ET.Element(w("document"))
    body = ET.SubElement(root, w("body"))

    def paragraph(parent: ET.Element, text: str, bold: bool = False, size: int = 22) -> None:
        run = ET.SubElement(ET.SubElement(parent, w("p")), w("r"))
        look = ET.SubElement(run, w("rPr"))
        if bold:
            ET.SubElement(look, w("b"))
        ET.SubElement(look, w("sz"), {w("val"): str(size)})
        # Characters that XML has no place for are left out.
        ET.SubElement(run, w("t")).text = re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", text)

    paragraph(body, f"Compliance report: {form_type}", bold=True, size=32)
    paragraph(body, f"State: {overall}", bold=True)
    paragraph(body, summary)
    table = ET.SubElement(body, w("tbl"))
    edges = ET.SubElement(ET.SubElement(table, w("tblPr")), w("tblBorders"))
    for edge in ("top", "left", "bottom", "right", "insideH", "insideV"):
        ET.SubElement(edges, w(edge), {w("val"): "single", w("sz"): "4"})
    names = ("rule_id", "severity", "status", "actual", "expected", "message")
    for row in [dict.fromkeys(names), *(c.asDict() for c in checks)]:
        line, head = ET.SubElement(table, w("tr")), row["rule_id"] is None
        for name in names:
            paragraph(ET.SubElement(line, w("tc")), name.replace("_", " ") if head else str(row[name] if row[name] is not None else ""), bold=head, size=18)
    types = ET.Element(f"{{{_PACKAGE}/content-types}}Types")
    for suffix, kind in _KINDS.items():
        ET.SubElement(types, f"{{{_PACKAGE}/content-types}}Default", Extension=suffix, ContentType=kind)
    links = ET.Element(f"{{{_PACKAGE}/relationships}}Relationships")
    ET.SubElement(links, f"{{{_PACKAGE}/relationships}}Relationship", Id="main", Type=_OFFICE, Target="report.xml")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, tree in (("[Content_Types].xml", types), ("_rels/.rels", links), ("report.xml", root)):
            package.writestr(name, ET.tostring(tree, encoding="UTF-8", xml_declaration=True))
    return out.getvalue()


def mutation_markdown(score, cases: list) -> str:
    """The benchmark's report: its ratios, and the cases whose new violations aren't the target alone."""
    out = ["# Rule benchmark", "", "| cases | precision | recall | F1 |", "|--:|--:|--:|--:|", f"| {score.cases} | {score.precision:.1%} | {score.recall:.1%} | {score.f1:.1%} |", "", "## Cases that differ", ""]
    odd = [c for c in cases if list(c.predicted) != [c.target]]
    return "\n".join(out + [f"- {c.doc_id}: {c.target}, found {', '.join(c.predicted) or 'nothing'}" for c in odd] or out) + "\n"
