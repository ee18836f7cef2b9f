"""Cross-field business rules over entity-attribute-value facts.

``facts(doc_id, form_id, key, value, kind)`` with kind one of number, string, bool, null. Selectors
and rules are small tables of a fixed catalogue and are broadcast; facts are grouped once by
document, and every rule of a document's form is evaluated on that row. A rule whose operands don't
parse is skipped, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers

OPERATIONS = ("date_order", "years_between", "equals_product", "less_or_equal", "sum_equals")


@dataclass(frozen=True)
class Rule:
    """``operands``: actual and factors; total and parts; left and right; earlier and later; start, end and years."""

    form_type: str
    id: str
    operation: str
    operands: tuple[str, ...]
    title: str = ""
    severity: str = "error"
    message: str = ""
    relative_tolerance: float = 0.01
    absolute_tolerance: float = 0.0
    tolerance_days: int = 1
    null_as_zero: bool = False
    mutation_alias: str | None = None
    mutation_side: str = "right"
    eval_mutation: bool = True


@dataclass(frozen=True)
class Catalogue:
    #: form -> alias -> key or key suffix
    selectors: dict[str, dict[str, str]] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()


_RULE = (
    "form_type string, rule_id string, operation string, operands array<string>, title string, severity string, message string,"
    "relative_tolerance decimal(18,6), absolute_tolerance decimal(18,6), tolerance_days int, null_as_zero boolean,"
    "mutation_alias string, mutation_side string, eval_mutation boolean, ord int"
)


def rule_table(spark: SparkSession, c: Catalogue) -> DataFrame:
    from decimal import Decimal

    rows = [
        (r.form_type, r.id, r.operation, list(r.operands), r.title or r.id, r.severity, r.message or f"Violated: {r.title or r.id}.",
         Decimal(str(r.relative_tolerance)), Decimal(str(r.absolute_tolerance)), r.tolerance_days, r.null_as_zero, r.mutation_alias, r.mutation_side, r.eval_mutation, k)
        for k, r in enumerate(c.rules)
    ]
    return spark.createDataFrame(rows, _RULE)


def resolve(facts: DataFrame, c: Catalogue) -> DataFrame:
    """``(doc_id, form_id, alias, key, value, kind)``: the exact key, else the only key with the suffix, else no row.

    Suffixes are tested on the distinct keys of each form; facts then join by equality of their key.
    What comes out lies by document, so grouping by it again needs no shuffle.
    """
    rows = [(f, a, s) for f, by in c.selectors.items() for a, s in by.items()]
    selectors = facts.sparkSession.createDataFrame(rows, "form_id string, alias string, selector string")
    keys = facts.select("form_id", "key").distinct().join(F.broadcast(selectors), "form_id").where(F.col("key").endswith(F.col("selector")))
    keys = keys.select("form_id", "key", "alias", (F.col("key") == F.col("selector")).alias("exact"))
    hit = facts.join(keys, ["form_id", "key"]).repartition("doc_id")
    best = F.struct("exact", "key", "value", "kind")
    return (
        hit.groupBy("doc_id", "form_id", "alias")
        .agg(F.max(best).alias("b"), (F.min("key") == F.max("key")).alias("one"))
        .where("b.exact or one")
        .select("doc_id", "form_id", "alias", "b.key", "b.value", "b.kind")
    )


def values_of(facts: DataFrame, c: Catalogue) -> DataFrame:
    """``(doc_id, form_id, values MAP<alias, STRUCT<key, value, kind>>)`` of documents that resolve an alias."""
    entry = F.struct("alias", F.struct("key", "value", "kind"))
    return resolve(facts, c).groupBy("doc_id", "form_id").agg(F.map_from_entries(F.collect_list(entry)).alias("values"))


def _number(v: Column) -> Column:
    return F.when(v["kind"] == "number", v["value"].try_cast(numbers.OPERAND)).when(v["kind"] == "string", numbers.parse_number(v["value"]))


def _product(items: Column) -> Column:
    one = F.lit(1).cast("decimal(38,4)")
    return F.aggregate(items, one, lambda a, x: F.try_multiply(a, x).try_cast("decimal(38,4)"))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("decimal(38,4)"), lambda a, x: F.try_add(a, x).try_cast("decimal(38,4)"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are reckoned once: a generator of one row keeps the optimizer from copying them into their uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _parsed(values: DataFrame) -> DataFrame:
    """``values`` with ``parsed``: number, date and emptiness of each value, found once for its document, whatever number of rules reads it."""
    empty = lambda v: v.isNull() | (v["kind"] == "null") | ((v["kind"] == "string") & (v["value"] == ""))
    return _once(values, parsed=F.transform_values("values", lambda _, v: F.struct(_number(v).alias("number"), dates.parse_date(v["value"]).alias("day"), empty(v).alias("empty"))))


def evaluate(values: DataFrame, rules: DataFrame, only: Column | None = None) -> DataFrame:
    """``values(doc_id, form_id, values MAP<alias, STRUCT<key, value, kind>>)`` -> checks, one row per document and rule that ``only`` holds for."""
    j = _parsed(values).join(F.broadcast(rules), F.col("form_id") == F.col("form_type"))
    j = j if only is None else j.where(only)
    ops = F.transform("operands", lambda a: F.try_element_at(F.col("parsed"), a))
    zero = F.lit(0).cast(numbers.OPERAND)
    j = _once(j, ops=ops)
    nums = F.transform("ops", lambda v: F.when((v.isNull() | v["empty"]) & F.col("null_as_zero"), zero).otherwise(v["number"]))
    days = F.transform("ops", lambda v: v["day"])
    j = _once(j, nums=nums, days=days)
    n0, n1 = F.get("nums", F.lit(0)), F.get("nums", F.lit(1))
    d0, d1 = F.get("days", F.lit(0)), F.get("days", F.lit(1))
    rest = F.slice("nums", 2, F.size("nums"))
    op = F.col("operation")
    j = _once(
        j,
        expected_number=F.when(op == "equals_product", _product(rest)).when(op == "sum_equals", _total(rest)),
        anniversary=F.when(op == "years_between", dates.add_years(d0, F.get("nums", F.lit(2)).cast("int"))),
    )
    expected, anniversary = F.col("expected_number"), F.col("anniversary")
    near = numbers.close(n0, expected, F.col("relative_tolerance"), F.col("absolute_tolerance"))
    passed = (
        F.when(op.isin("equals_product", "sum_equals"), near)
        .when(op == "less_or_equal", n0 <= n1 + F.col("absolute_tolerance"))
        .when(op == "date_order", d0 <= d1)
        .when(op == "years_between", F.abs(F.datediff(d1, anniversary)) <= F.col("tolerance_days"))
    )
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    actual = F.when(op == "date_order", iso(d1)).when(op == "years_between", iso(d1)).otherwise(numbers.display_decimal(n0))
    shown = (
        F.when(op == "date_order", F.concat(F.lit(">= "), iso(d0))).when(op == "years_between", iso(anniversary))
        .when(op == "less_or_equal", F.concat(F.lit("<= "), numbers.display_decimal(n1))).otherwise(numbers.display_decimal(expected))
    )
    status = F.when(passed, F.lit("pass")).when(~passed, F.lit("violation")).otherwise(F.lit("skipped"))
    state, done = F.col("status"), F.col("status") != "skipped"
    message = F.when(state == "pass", F.concat(F.lit("Passed: "), "title", F.lit("."))).when(done, F.col("message")).otherwise(F.lit("Not enough valid data."))
    out = _once(j, status=status)
    return out.select(
        "doc_id", "form_type", "rule_id", "ord", "title", "severity", "operation", "status",
        F.when(done, actual).alias("actual"), F.when(done, shown).alias("expected"), message.alias("message"),
    )


def check(documents: DataFrame, facts: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Checks of ``documents(doc_id, form_id)``, by way of their facts; documents without facts skip their rules."""
    values = documents.select("doc_id", "form_id").join(values_of(facts, catalogue), ["doc_id", "form_id"], "left")
    values = values.withColumn("values", F.coalesce("values", F.create_map().cast("map<string,struct<key:string,value:string,kind:string>>")))
    return evaluate(values, rule_table(documents.sparkSession, catalogue))


def rejects(documents: DataFrame) -> DataFrame:
    """``(doc_id, error)`` of documents that can't be checked: no form, or no results."""
    return documents.select("doc_id", F.when(F.col("form_id").isNull(), F.lit("no form")).when(~F.col("has_results"), F.lit("no results")).alias("error")).where("error is not null")


def rollup(documents: DataFrame, checks: DataFrame) -> DataFrame:
    """A report row per document: counts of the three states, of violated severities, and the overall state."""
    bad = F.col("status") == "violation"
    n = checks.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(bad).alias("n_violation"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.count_if(bad & (F.col("severity") == "error")).alias("n_error"),
        F.count_if(bad & (F.col("severity") == "warning")).alias("n_warning"),
    )
    out = documents.select("doc_id", "form_id").join(n, "doc_id", "left").fillna(0, ["n_pass", "n_violation", "n_skipped", "n_error", "n_warning"])
    overall = (
        F.when(F.col("n_pass") + F.col("n_violation") == 0, "not_assessed")
        .when(F.col("n_error") > 0, "non_compliant")
        .when(F.col("n_warning") > 0, "compliant_with_warnings")
        .otherwise("compliant")
    )
    return out.withColumn("overall", overall)


def summary(checks: DataFrame, most: int = 6) -> DataFrame:
    """``(doc_id, summary)``: a headline, the first violations by rule order, and how many more there are."""
    bad = F.collect_list(F.when(F.col("status") == "violation", F.struct("ord", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "message").alias("m"))))
    g = checks.groupBy("doc_id", "form_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pass").alias("p"), F.count_if(F.col("status") == "violation").alias("v"), F.count_if(F.col("status") == "skipped").alias("s"), F.sort_array(bad).alias("bad")
    )
    head = F.format_string("%d rule checks for %s: %d passed, %d violated, %d not assessed.", "n", "form_type", "p", "v", "s")
    shown = F.array_join(F.slice(F.transform("bad", lambda b: b["m"]), 1, most), " ")
    more = F.when(F.col("v") > most, F.format_string(" %d more violations.", F.col("v") - most)).otherwise("")
    return g.select("doc_id", F.when(F.col("v") == 0, F.concat(head, F.lit(" No violations."))).otherwise(F.concat(head, F.lit(" "), shown, more)).alias("summary"))


def llm_payload(checks: DataFrame) -> DataFrame:
    """``(doc_id, payload)``: computed results alone, as JSON for an outside summariser."""
    item = F.struct("rule_id", "severity", "status", "actual", "expected", "message")
    g = checks.groupBy("doc_id", "form_type").agg(F.sort_array(F.collect_list(item)).alias("checks"))
    return g.select("doc_id", F.to_json(F.struct("form_type", "checks")).alias("payload"))


def mutate(values: DataFrame, rules: DataFrame) -> DataFrame:
    """A case per document and rule: ``(doc_id, target, form_id, changed, values)`` with one operand changed so that the rule breaks.

    The document's key ``changed`` is given the new value, so every alias that reads it changes.
    Rules that opt out, or whose operand has no key or can't be changed, give no case.
    """
    j = _parsed(values).join(F.broadcast(rules.where("eval_mutation")), F.col("form_id") == F.col("form_type"))
    v = lambda k: F.try_element_at(F.col("parsed"), F.get("operands", F.lit(k)))
    of = F.struct(*[v(k)["number"].alias(f"n{k}") for k in (0, 1)], *[v(k)["day"].alias(f"d{k}") for k in (0, 1)], F.coalesce(F.try_element_at(F.col("parsed"), F.col("mutation_alias")), v(0))["number"].alias("own"))
    j = _once(j, of=of)
    n = lambda k: F.col(f"of.n{k}")
    d = lambda k: F.col(f"of.d{k}")
    op, number = F.col("operation"), F.col("of.own")
    text = lambda c: c.cast("decimal(38,6)").cast("string")
    first = F.get("operands", F.lit(0))
    second = F.get("operands", F.lit(1))
    left, earlier = F.col("mutation_side") == "left", F.coalesce("mutation_alias", second) == first
    alias = (
        F.when(op == "equals_product", F.coalesce("mutation_alias", first)).when(op == "sum_equals", first)
        .when(op == "less_or_equal", F.when(left, first).otherwise(second))
        .when(op == "date_order", F.coalesce("mutation_alias", second)).when(op == "years_between", second)
    )
    new = (
        F.when(op == "equals_product", F.when(F.coalesce(number, F.lit(0)) == 0, F.lit("1")).otherwise(text(number * F.lit(1.25).cast("decimal(3,2)"))))
        .when(op == "sum_equals", text(F.coalesce(n(0), F.lit(0)) + F.greatest(F.abs(F.coalesce(n(0), F.lit(0))) * F.lit(0.25).cast("decimal(3,2)"), F.lit(1))))
        .when(op == "less_or_equal", F.when(left, text(n(1) * 2 + 1)).otherwise(text(n(0) / 2)))
        .when(op == "date_order", F.date_format(F.when(earlier, F.date_add(d(1), 1)).otherwise(F.date_sub(d(0), 1)), "yyyy-MM-dd"))
        .when(op == "years_between", F.date_format(F.date_add(d(1), 370), "yyyy-MM-dd"))
    )
    kind = F.when(op.isin("date_order", "years_between"), F.lit("string")).otherwise(F.lit("number"))
    changed = F.try_element_at(F.col("values"), alias)["key"]
    j = _once(j, changed=changed, new=new, new_kind=kind).where("new is not null and changed is not null")
    own = F.struct(F.col("changed").alias("key"), F.col("new").alias("value"), F.col("new_kind").alias("kind"))
    values = F.transform_values("values", lambda _, x: F.when(x["key"] == F.col("changed"), own).otherwise(x))
    return j.select("doc_id", F.col("rule_id").alias("target"), "form_id", "changed", values.alias("values"))


def mutation_benchmark(values: DataFrame, rules: DataFrame) -> DataFrame:
    """``(doc_id, target, predicted)``: new violations of each case against the document's own, baseline failures left out.

    Only rules that read the changed key can come out otherwise, so no others are evaluated again.
    """
    base = evaluate(values, rules).where("status = 'violation'").groupBy("doc_id").agg(F.collect_set("rule_id").alias("base"))
    cases = mutate(values, rules).withColumn("case", F.struct("doc_id", "target", "changed"))
    reads = F.exists("operands", lambda a: F.try_element_at(F.col("values"), a)["key"] == F.col("doc_id.changed"))
    after = evaluate(cases.select(F.col("case").alias("doc_id"), "form_id", "values"), rules, reads)
    after = after.groupBy("doc_id.doc_id", "doc_id.target").agg(F.collect_set(F.when(F.col("status") == "violation", F.col("rule_id"))).alias("after"))
    after = after.join(base, "doc_id", "left")
    before = F.coalesce("base", F.array().cast("array<string>"))
    return after.where(~F.array_contains(before, F.col("target"))).select("doc_id", "target", F.sort_array(F.array_except("after", before)).alias("predicted"))


def mutation_score(cases: DataFrame) -> DataFrame:
    """True and false positives and negatives by sets, and the zero-safe ratios of them."""
    hit = F.array_contains("predicted", F.col("target")).cast("bigint")
    n = cases.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum(hit), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size("predicted") - hit), F.lit(0)).alias("fp"), F.coalesce(F.sum(1 - hit), F.lit(0)).alias("fn"))
    return ratios(n)


def ratios(n: DataFrame) -> DataFrame:
    """``precision, recall, f1`` from ``tp, fp, fn``; 0 where a denominator is."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = n.withColumn("precision", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))))
    return n.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
