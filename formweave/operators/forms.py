"""Forms: classification by keywords, rule tables on flat text, assembling of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import choice
from ..functions.dates import iso_date
from ..functions.numbers import digits
from ..functions.text import clean_spaces, drop_zero_width, strip_accents

KEYWORD_RATIO, LEAST_SCORE = 85.0, 0.34


@dataclass(frozen=True)
class TextRule:
    """``pattern`` has its value in group 1; ``kind``: text, date, date_dmy (groups 1-3), digits, phone, dong, choice."""

    key: str
    kind: str
    pattern: str
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Form:
    name: str
    keywords: tuple[str, ...] = ()
    rules: tuple[TextRule, ...] = ()
    fold: bool = True
    confidence: float = 0.9
    status: str = "draft"


FORMS: dict[str, Form] = {}


def register_form(form: Form) -> Form:
    FORMS[form.name] = form
    return form


def get_form(name: str) -> Form:
    """KeyError for a form that nobody registered."""
    return FORMS[name]


def classify(docs: DataFrame, forms: list[Form], fuzzy: bool = True) -> DataFrame:
    """``(doc_id, form, score)``: the share of a form's keywords in a text, the best form by score then registration.

    Below 0.34 the form is ``generic``. ``fuzzy`` takes keywords by partial ratio, else by containment.
    """
    from ..functions.fuzzy import partial_ratio

    text = F.lower(strip_accents(F.col("text")))
    d = docs.select("doc_id", text.alias("_t"))
    scores = []
    for k, form in enumerate(forms):
        hits = []
        for w in map(_fold, form.keywords):
            held = d["_t"].contains(w)
            # A text that holds the keyword isn't sent to the workers: its ratio is 100.
            likeness = partial_ratio(F.when(~held, d["_t"]), F.lit(w)) >= KEYWORD_RATIO
            hits.append((held | likeness if fuzzy else held).cast("double"))
        score = sum(hits[1:], hits[0]) / len(hits) if hits else F.lit(0.0)
        scores.append(F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(-k).alias("ord"), F.lit(form.name).alias("form")))
    best = F.array_max(F.array(*scores))
    d = d.select("doc_id", F.explode(F.array(best)).alias("b"))
    return d.select("doc_id", F.when(F.col("b.score") >= LEAST_SCORE, F.col("b.form")).otherwise("generic").alias("form"), F.col("b.score").alias("score"))


def _fold(text: str) -> str:
    from ..functions.text import _folds

    return text.translate(str.maketrans(*_folds())).lower()


def flat_text(c: Column) -> Column:
    return clean_spaces(drop_zero_width(c))


def _value(rule: TextRule, flat: Column, text: Column) -> Column:
    """The rule's value: matched on the (folded) text, cut from the accented one at the same place."""
    g = lambda k: F.regexp_extract(text, rule.pattern, k)
    head = _before(rule.pattern)
    captured = g(1)
    if head is not None and rule.kind in ("text", "choice"):
        # All that stands before the group in the leftmost match gives the group's place.
        at = F.length(F.regexp_extract(text, f"^(.*?{head})(?={_group(rule.pattern)})", 1)) + 1
        captured = F.substring(flat, at, F.length(g(1)))
    out = {
        "date": lambda: iso_date(g(1), g(2), g(3)),
        "date_dmy": lambda: F.format_string("%02d/%02d/%04d", g(1).try_cast("int"), g(2).try_cast("int"), g(3).try_cast("int")),
        "digits": lambda: digits(g(1)),
        "phone": lambda: digits(g(1)),
        "dong": lambda: F.concat(digits(g(1)), F.lit(" đồng")),
        "choice": lambda: choice(captured, list(rule.choices))["value"],
    }.get(rule.kind, lambda: clean_spaces(captured))()
    return F.when(text.rlike(rule.pattern), out)


def _split(pattern: str) -> tuple[str, str] | None:
    at = next((i for i, c in enumerate(pattern) if c == "(" and pattern[i + 1 : i + 2] != "?" and (i == 0 or pattern[i - 1] != "\\")), None)
    return None if at is None else (pattern[:at], pattern[at:])


def _before(pattern: str) -> str | None:
    return s[0] if (s := _split(pattern)) else None


def _group(pattern: str) -> str:
    return s[1] if (s := _split(pattern)) else ""


def apply_rules(docs: DataFrame, form: Form) -> DataFrame:
    """``(doc_id, name, value, confidence, source)`` of the form's rules over ``docs(doc_id, text)``; rules that don't match give no row."""
    d = docs.select("doc_id", flat_text(F.col("text")).alias("flat"))
    d = d.withColumn("folded", strip_accents(F.col("flat")) if form.fold else F.col("flat"))
    rows = [F.struct(F.lit(f"results.{r.key}").alias("name"), _value(r, F.col("flat"), F.col("folded")).alias("value")) for r in form.rules]
    rows += [F.struct(F.lit("status").alias("name"), F.lit(form.status).alias("value")), F.struct(F.lit("form_id").alias("name"), F.lit(form.name).alias("value"))]
    out = d.select("doc_id", F.explode(F.array(*rows)).alias("r")).where("r.value is not null")
    return out.select("doc_id", "r.name", "r.value", F.lit(form.confidence).alias("confidence"), F.lit("rule").alias("source"))


def generic(lines: DataFrame) -> DataFrame:
    """``(doc_id, page_index, n_lines, lines, text)``: pages as they are read."""
    g = lines.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    texts = F.transform("ls", lambda x: x["text"])
    return g.select("doc_id", "page_index", F.size("ls").alias("n_lines"), texts.alias("lines"), F.array_join(texts, "\n").alias("text"))


def assemble(fields: DataFrame) -> DataFrame:
    """``(doc_id, body)``: dotted names nested as JSON objects, and ``_meta`` with confidence, status and warnings.

    A value where an object is needed gives way to the object. A document's fields are a form's, so
    each group is small.
    """
    import json

    import pandas as pd

    def body_of(rows) -> str:
        body, meta = {}, {}
        for r in sorted(rows, key=lambda r: r["name"]):
            at = body
            *path, last = r["name"].split(".")
            for p in path:
                if not isinstance(at.get(p), dict):
                    at[p] = {}
                at = at[p]
            if not isinstance(at.get(last), dict):
                at[last] = r["value"]
            meta[r["name"]] = {"confidence": round(float(r["confidence"] or 0.0), 3), "status": r["status"], "warnings": list(r["warnings"] if r["warnings"] is not None else [])}
        return json.dumps(body | {"_meta": meta}, ensure_ascii=False)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "body": [body_of(rows) for rows in f.rows]})

    kind = dict(fields.dtypes)["doc_id"]
    grouped = fields.groupBy("doc_id").agg(F.collect_list(F.struct("name", "value", "confidence", "status", "warnings")).alias("rows"))
    return grouped.mapInPandas(run, f"doc_id {kind}, body string")
