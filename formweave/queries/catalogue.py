"""Queries over the driver's tables, one for each operator family, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contact, dates, fuzzy, geometry, numbers, text
from ..operators import evaluation, extract, forms, layout, recognise, rules, shipped, validate
from ..operators.forms import Form, TextRule
from ..operators.rules import Catalogue, Rule
from ..schema import PAGES
from ..session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scalar functions -------------------------------------------------------------------------


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def text_strip_accents(t):
    return t("documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("folded"))


@query(r"SELECT page_id, md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS cleaned FROM pages")
def text_clean_spaces(t):
    return t("pages").select("page_id", F.md5(text.clean_spaces(F.col("html"))).alias("cleaned"))


@query(r"SELECT item_id, trim(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), ' :.…-') AS label FROM benchmark")
def text_norm_key(t):
    return t("benchmark").select("item_id", text.norm_key(F.col("text")).alias("label"))


@query("SELECT doc_id, TRY_CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT)::VARCHAR AS n FROM documents")
def num_parse_int(t):
    return t("documents").select("doc_id", numbers.parse_int(F.col("text")).cast("string").alias("n"))


@query()
def num_parse_float(t):
    """Rendered as '4,00 %' and '1.234,5' and read back."""
    li = t("lineitem")
    pct = F.concat(F.replace(F.format_number(F.col("l_discount") * 100, 2), F.lit("."), F.lit(",")), F.lit(" %"))
    price = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return li.select(*keys, F.round(numbers.parse_float(pct), 2).alias("percent"), F.round(numbers.parse_float(price), 2).alias("price"))


ORACLES["num_parse_float"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * 100, 2) AS percent, round(l_extendedprice, 2) AS price FROM lineitem
"""


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS price, (floor(o_totalprice)::BIGINT % 1000 * 1000000)::DOUBLE AS scaled,
  replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') AS shown FROM orders
""")
def num_parse_vn(t):
    """Rendered as '1.234.567,89', '12 triệu đồng' and a whole number with points, and read back."""
    o = t("orders")
    shown = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    whole = F.floor("o_totalprice")
    million = F.concat((whole % 1000).cast("string"), F.lit(" triệu đồng"))
    return o.select("o_orderkey", numbers.parse_number(shown).cast("double").alias("price"), numbers.parse_number(million).cast("double").alias("scaled"), numbers.display_decimal(whole.cast("decimal(24,4)")).alias("shown"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS numeric_date, strftime(o_orderdate, '%Y-%m-%d') AS worded_date,
  strftime(o_orderdate, '%Y-%m-%dT09:') || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS moment FROM orders
""")
def date_parse_search(t):
    o = t("orders")
    d = F.col("o_orderdate")
    numeric = F.concat(F.lit("Signed on "), F.date_format(d, "dd.MM.yyyy"), F.lit(" in town"))
    worded = F.concat(F.lit("Ngày "), F.dayofmonth(d), F.lit(" tháng "), F.month(d), F.lit(" năm "), F.year(d))
    moment = F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 9h"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    return o.select("o_orderkey", dates.search_date(numeric).cast("string").alias("numeric_date"), dates.search_date(worded).cast("string").alias("worded_date"), dates.search_datetime(moment).alias("moment"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders
""")
def date_parse_strict(t):
    o, d = t("orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd-MM-yyyy")).when(k == 3, F.date_format(d, "yyyy/MM/dd")).otherwise(F.concat(F.lit("on "), F.date_format(d, "dd/MM/yyyy")))
    return o.select("o_orderkey", dates.parse_date(shown).cast("string").alias("d"))


@query("""
WITH c AS (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, lower(replace(c_name, '#', '@')) || '.com' AS mail, upper(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) AS symbol FROM customer)
SELECT c_custkey, digits AS phone, (length(digits) NOT BETWEEN 9 AND 11)::INTEGER AS phone_warnings, (length(digits) NOT IN (9, 12))::INTEGER AS id_warnings,
  mail AS email, (NOT regexp_full_match(mail, '[^@\\s]+@[^@\\s]+[.][^@\\s]+'))::INTEGER AS email_warnings, symbol, (length(symbol) NOT BETWEEN 2 AND 10)::INTEGER AS symbol_warnings FROM c
""".replace("\\\\", "\\"))
def contact_validators(t):
    c = t("customer")
    name, mail = F.col("c_name"), F.concat(F.replace("c_name", F.lit("#"), F.lit("@")), F.lit(".com"))
    p, i, e, s = contact.phone(name), contact.id_number(name), contact.email(mail), contact.symbol(F.col("c_mktsegment"))
    return c.select("c_custkey", p["value"].alias("phone"), F.size(p["warnings"]).alias("phone_warnings"), F.size(i["warnings"]).alias("id_warnings"), e["value"].alias("email"), F.size(e["warnings"]).alias("email_warnings"), s["value"].alias("symbol"), F.size(s["warnings"]).alias("symbol_warnings"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'Urgent' WHEN o_orderpriority LIKE '%HIGH%' THEN 'High' WHEN o_orderpriority LIKE '%LOW%' THEN 'Low' ELSE o_orderpriority END AS choice,
  (o_orderpriority NOT LIKE '%URGENT%' AND o_orderpriority NOT LIKE '%HIGH%' AND o_orderpriority NOT LIKE '%LOW%')::INTEGER AS warnings FROM orders
""")
def choice_normalize(t):
    c = contact.choice(F.col("o_orderpriority"), ["Urgent", "High", "Low"])
    return t("orders").select("o_orderkey", c["value"].alias("choice"), F.size(c["warnings"]).alias("warnings"))


@query()
def fuzzy_ratio(t):
    """Parts against their type: Indel similarity has no SQL."""
    p = t("part")
    return p.select("p_partkey", fuzzy.ratio("p_name", "p_type").alias("ratio"), fuzzy.partial_ratio("p_brand", "p_name").alias("partial"))


# --- forms ------------------------------------------------------------------------------------

_FORMS = [
    Form("licence", ("licensed under", "released under", "license")),
    Form("mail", ("@", "contact", "example.com")),
    Form("table", (" | ", "||")),
]


@query("""
WITH s AS (SELECT doc_id, lower(strip_accents(text)) AS x FROM documents),
h AS (SELECT doc_id,
  (contains(x, 'licensed under')::INT + contains(x, 'released under')::INT + contains(x, 'license')::INT) / 3.0::DOUBLE AS a,
  (contains(x, '@')::INT + contains(x, 'contact')::INT + contains(x, 'example.com')::INT) / 3.0::DOUBLE AS b,
  (contains(x, ' | ')::INT + contains(x, '||')::INT) / 2.0::DOUBLE AS c FROM s)
SELECT doc_id, CASE WHEN greatest(a, b, c) < 0.34 THEN 'generic' WHEN a >= b AND a >= c THEN 'licence' WHEN b >= c THEN 'mail' ELSE 'table' END AS form,
  round(greatest(a, b, c), 6) AS score FROM h
""")
def doc_classify_exact(t):
    """Keywords by containment."""
    return forms.classify(t("documents"), _FORMS, fuzzy=False).withColumn("score", F.round("score", 6))


@query()
def doc_classify(t):
    """Keywords by partial ratio, which has no SQL; a unit test has it by brute force."""
    return forms.classify(t("documents"), _FORMS).withColumn("score", F.round("score", 6))


_PAGE = Form("page", rules=(TextRule("lang", "text", 'lang="([a-z]+)"'), TextRule("title", "text", "<title>([^<]*)</title>"), TextRule("ad", "digits", "<!-- ad ([0-9]+) -->")))


@query("""
WITH p AS (SELECT page_id AS doc_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS x FROM pages),
r AS (SELECT doc_id, 'results.lang' AS name, regexp_extract(x, 'lang="([a-z]+)"', 1) AS value, regexp_matches(x, 'lang="([a-z]+)"') AS hit FROM p
UNION ALL SELECT doc_id, 'results.title', trim(regexp_extract(x, '<title>([^<]*)</title>', 1)), regexp_matches(x, '<title>([^<]*)</title>') FROM p
UNION ALL SELECT doc_id, 'results.ad', regexp_extract(x, '<!-- ad ([0-9]+) -->', 1), regexp_matches(x, '<!-- ad ([0-9]+) -->') FROM p)
SELECT doc_id, name, value FROM r WHERE hit
""")
def regex_rules(t):
    d = t("pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return forms.apply_rules(d, _PAGE).where("name like 'results.%'").select("doc_id", "name", "value")


def _turns(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("turn").alias("line_no"), "text")


@query("SELECT conv_id AS doc_id, count(*)::INTEGER AS n_lines, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text FROM conversations GROUP BY conv_id")
def pages_generic(t):
    return forms.generic(_turns(t)).select("doc_id", "n_lines", F.md5("text").alias("text"))


# --- geometry ---------------------------------------------------------------------------------


def _boxes(t) -> DataFrame:
    """Line items as boxes: an order is a document, attributes give places; ids make them unique."""
    li = t("lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("int")
    b = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), n.alias("line_no"), F.col("l_returnflag").alias("text"), (F.col("l_partkey") % 500).cast("double").alias("x1"), (F.col("l_suppkey") % 40 * 5).cast("double").alias("y1"), (F.col("l_quantity") / 50).alias("confidence"))
    return b.withColumns({"x2": F.col("x1") + 60, "y2": F.col("y1") + 12})


_BOXES = """
WITH b AS (SELECT *, x1 + 60 AS x2, y1 + 12 AS y2 FROM (SELECT l_orderkey AS doc_id, 0 AS page_index,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS line_no, l_returnflag AS text,
  (l_partkey % 500)::DOUBLE AS x1, (l_suppkey % 40 * 5)::DOUBLE AS y1, l_quantity / 50 AS confidence FROM lineitem))
"""


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, l_suppkey FROM lineitem WHERE l_quantity >= 0)
SELECT l_orderkey::VARCHAR AS doc_id, count(*) AS n_words, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text, round(avg(l_quantity) / 100, 6) AS confidence,
  min(l_partkey % 500)::DOUBLE AS x1, max(l_partkey % 500 + 10)::DOUBLE AS x2 FROM w GROUP BY l_orderkey
""")
def tokens_to_lines(t):
    li = t("lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    w = li.select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("block_num"), F.lit(0).alias("par_num"), F.lit(0).alias("line_num"), n.alias("word_no"),
        F.col("l_returnflag").alias("text"), F.col("l_quantity").cast("string").alias("conf"), (F.col("l_partkey") % 500).cast("int").alias("left"), F.lit(0).alias("top"), F.lit(10).alias("width"), F.lit(12).alias("height"),
    )
    return recognise.words_to_lines(w).select("doc_id", F.size(F.split("text", " ")).cast("bigint").alias("n_words"), "text", F.round("confidence", 6).alias("confidence"), "x1", "x2")


@query(_BOXES + "SELECT doc_id, line_no AS was, (row_number() OVER (PARTITION BY doc_id ORDER BY round_even(y1 / 10, 0)::BIGINT, x1, line_no) - 1)::INTEGER AS line_no FROM b")
def reading_order(t):
    return layout.in_order(_boxes(t).withColumn("was", F.col("line_no"))).select("doc_id", "was", "line_no")


_OVERLAP = "greatest(least(a.y2, v.y2) - greatest(a.y1, v.y1), 0) / 12.0 >= 0.4"


@query()
def value_right(t):
    b = _boxes(t)
    return layout.value_right(b, b).select("doc_id", "line_no", "value_line", "value")


ORACLES["value_right"] = _BOXES + f"""
SELECT doc_id, line_no, value_line, value FROM (
SELECT a.doc_id, a.line_no, v.line_no AS value_line, v.text AS value, row_number() OVER (PARTITION BY a.doc_id, a.line_no ORDER BY v.x1, v.line_no) AS k
FROM b a JOIN b v ON a.doc_id = v.doc_id AND a.line_no <> v.line_no WHERE {_OVERLAP} AND v.x1 >= a.x2 - 6) WHERE k = 1
"""


@query(_BOXES + """
SELECT doc_id, line_no, value_line, value FROM (
SELECT a.doc_id, a.line_no, v.line_no AS value_line, v.text AS value, row_number() OVER (PARTITION BY a.doc_id, a.line_no ORDER BY v.y1, v.line_no) AS k
FROM b a JOIN b v ON a.doc_id = v.doc_id AND a.line_no <> v.line_no
WHERE v.y1 - a.y2 BETWEEN -0.2 * 12 AND 2.5 * 12 AND abs(v.x1 - a.x1) <= 2.5 * 12) WHERE k = 1
""")
def value_below(t):
    b = _boxes(t)
    return layout.value_below(b, b).select("doc_id", "line_no", "value_line", "value")


@query(_BOXES + """
SELECT doc_id, string_agg(text, ' ' ORDER BY round_even(y1 / 10, 0), x1, line_no) AS text, min(confidence) AS confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2
FROM b WHERE (x1 + x2) / 2 BETWEEN 280 AND 560 AND (y1 + y2) / 2 BETWEEN 0 AND 120 GROUP BY doc_id
""")
def region_filter(t):
    b = _boxes(t)
    pages = b.select("doc_id", "page_index").distinct().withColumns({"width": F.lit(560), "height": F.lit(240)})
    return layout.merge(layout.in_region(b, pages, (0.5, 0.0, 1.0, 0.5)), layout.PAGE).drop("page_index")


@query(_BOXES + """
, p AS (SELECT a.doc_id, a.line_no AS anchor, v.*, a.x2 AS ax2, a.y1 AS ay1, a.y2 AS ay2, a.x1 AS ax1 FROM b a JOIN (SELECT doc_id AS d, line_no, text, x1, y1, x2, y2, confidence FROM b) v ON a.doc_id = v.d AND a.line_no <> v.line_no WHERE a.line_no = 1),
r AS (SELECT * FROM p WHERE greatest(least(ay2, y2) - greatest(ay1, y1), 0) / 12.0 >= 0.4 AND x1 >= ax2 - 6),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, line_no) AS k FROM p WHERE y1 - ay2 BETWEEN -0.2 * 12 AND 2.5 * 12 AND abs(x1 - ax1) <= 2.5 * 12) WHERE k <= 2),
u AS (SELECT doc_id, anchor, line_no, text, confidence, x1, y1, x2, y2 FROM r UNION ALL SELECT doc_id, anchor, line_no, text, confidence, x1, y1, x2, y2 FROM w)
SELECT doc_id, 0 AS page_index, anchor, string_agg(text, ' ' ORDER BY round_even(y1 / 10, 0), x1, line_no) AS text, min(confidence) AS confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM u GROUP BY doc_id, anchor
""")
def relative_gather(t):
    b = _boxes(t)
    return layout.gather(b.where("line_no = 1"), b, max_below=2)


@query("WITH RECURSIVE " + _BOXES.strip().removeprefix("WITH") + """
, o AS (SELECT doc_id, line_no, y1, y2, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, line_no) AS k FROM b),
f AS (SELECT doc_id, k, line_no, 0 AS row_no, y1 AS lo, y2 AS hi FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, o.line_no, f.row_no + (NOT j)::INTEGER, CASE WHEN j THEN least(lo, y1) ELSE y1 END, CASE WHEN j THEN greatest(hi, y2) ELSE y2 END
  FROM f JOIN (SELECT * FROM o) o ON o.doc_id = f.doc_id AND o.k = f.k + 1, LATERAL (SELECT greatest(least(hi, y2) - greatest(lo, y1), 0) / least(hi - lo, y2 - y1) >= 0.3 AS j))
SELECT doc_id, line_no, row_no FROM f
""")
def row_cluster(t):
    """Rows of boxes by a growing hull: an order-dependent fold."""
    return layout.cluster_rows(_boxes(t), ["doc_id"])


@query(_BOXES + """
, h(col_no, col_name, cx) AS (VALUES (0, 'left', 100.0), (1, 'middle', 280.0), (2, 'right', 460.0))
SELECT doc_id, line_no, col_no, col_name FROM (SELECT b.doc_id, b.line_no, h.col_no, h.col_name, row_number() OVER (PARTITION BY b.doc_id, b.line_no ORDER BY abs((b.x1 + b.x2) / 2 - h.cx), h.col_no) AS k FROM b, h) WHERE k = 1
""")
def cell_assign(t):
    b = _boxes(t)
    heads = F.array(*[F.struct(F.lit(k).alias("col_no"), F.lit(n).alias("col_name"), F.lit(x).alias("cx")) for k, n, x in ((0, "left", 100.0), (1, "middle", 280.0), (2, "right", 460.0))])
    h = b.select("doc_id").distinct().select("doc_id", F.inline(heads))
    return layout.assign_columns(b, h, ["doc_id"]).select("doc_id", "line_no", "col_no", "col_name")


@query(_BOXES + "SELECT doc_id, count(*) AS n, round(sum((x2 - x1) * (y2 - y1)), 4) AS area, round(max(greatest(least(x2, 300) - greatest(x1, 200), 0) * greatest(least(y2, 100) - greatest(y1, 50), 0) / ((x2 - x1) * (y2 - y1) + 5000 - greatest(least(x2, 300) - greatest(x1, 200), 0) * greatest(least(y2, 100) - greatest(y1, 50), 0))), 9) AS best_iou FROM b GROUP BY doc_id")
def box_measures(t):
    b = _boxes(t)
    own, other = geometry.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), geometry.box(*map(F.lit, (200, 50, 300, 100)))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(geometry.area(own)), 4).alias("area"), F.round(F.max(geometry.iou(own, other)), 9).alias("best_iou"))


# --- extraction -------------------------------------------------------------------------------


def _page_lines(t) -> DataFrame:
    """The visible lines of a page's paragraphs, one under another."""
    p = t("pages").select(F.col("page_id").cast("string").alias("doc_id"), F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n+").alias("ls"))
    p = p.select("doc_id", F.posexplode("ls").alias("line_no", "text")).where("trim(text) <> ''")
    y = (F.col("line_no") * 20).cast("double")
    return p.select("doc_id", F.lit(0).alias("page_index"), "line_no", "text", F.lit(0.0).alias("x1"), y.alias("y1"), F.lit(200.0).alias("x2"), (y + 12).alias("y2"), F.lit(0.9).alias("confidence"))


@query()
def anchor_extract(t):
    specs = [extract.FieldSpec("first", anchor=("The",), value_direction="below"), extract.FieldSpec("next", anchor=("and",))]
    return extract.extract(_page_lines(t), specs).select("doc_id", "name", "value", "status")


@query("""
WITH d AS (SELECT doc_id::VARCHAR AS doc_id, strip_accents(text) AS x FROM documents),
r AS (SELECT doc_id, 'ip' AS name, regexp_extract(x, '([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)', 1) AS v FROM d
UNION ALL SELECT doc_id, 'licence', regexp_extract(x, '(?i)(?:licensed|released) under ([a-z ]+)', 1) FROM d)
SELECT doc_id, name, nullif(v, '') AS value, CASE WHEN v = '' THEN 'missing' ELSE 'ok' END AS status FROM r
""")
def rule_extract(t):
    lines = t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("line_no"), "text", F.lit(0.9).alias("confidence"))
    specs = [extract.FieldSpec("ip", "rule", regex="([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)"), extract.FieldSpec("licence", "rule", regex="(?:licensed|released) under ([a-z ]+)")]
    return extract.extract(lines, specs).select("doc_id", "name", "value", "status")


#: Text, left and top of the lines of a drawn form: three boxes to tick, two to choose from, a place to sign.
_FORM = [("north", 36, 10), ("south", 36, 40), ("east", 36, 70), ("alpha", 126, 10), ("gamma", 126, 40), ("sign here", 20, 100)]


def _drawn(t) -> tuple[DataFrame, DataFrame]:
    """A form for each customer: its lines, and its page unless the key ends in 0.

    Bit k of the key ticks box k, the nation chooses, keys that end in 1 have no boxes to choose from,
    and a balance over 0 signs.
    """
    import numpy as np
    import pandas as pd

    c = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"))

    names = ["source", "page_index", "dpi", "width", "height", "channels", "image"]

    def draw(frames):
        for f in frames:
            rows = []
            for key, nation, balance in f.itertuples(index=False):
                page = np.full((150, 180), 255, np.uint8)
                ticks = [key & 1, key & 2, key & 4, nation % 3 == 0, nation % 3 == 1]
                for (_, x, y), ticked in list(zip(_FORM, ticks))[: 3 if key % 10 == 1 else 5]:
                    page[y : y + 12, x - 16 : x - 4] = 0
                    page[y + 2 : y + 10, x - 14 : x - 6] = 255
                    if ticked:
                        page[y + 4 : y + 8, x - 12 : x - 8] = 0
                if balance > 0:
                    page[125:128, 30:60] = 0
                rows.append((str(key), 0, 72, 180, 150, 1, page.tobytes()))
                # Few pages at once, whatever number of customers a batch has.
                if len(rows) == 128:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    line = F.explode(F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(x).alias("text"), F.lit(float(a)).alias("x1"), F.lit(float(b)).alias("y1")) for k, (x, a, b) in enumerate(_FORM)]))
    lines = c.select(F.col("key").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), line.alias("l")).select("doc_id", "page_index", "l.*")
    lines = lines.select("*", (F.col("x1") + 40).alias("x2"), (F.col("y1") + 12).alias("y2"), F.lit(0.9).alias("confidence"))
    return lines, c.where("key % 10 <> 0").mapInPandas(draw, PAGES)


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey % 3 AS n, c_acctbal AS b, c_custkey % 10 <> 0 AS page, c_custkey % 10 <> 1 AS boxes FROM customer),
t AS (SELECT *, list_filter([CASE WHEN k & 1 > 0 THEN 'n' END, CASE WHEN k & 2 > 0 THEN 's' END, CASE WHEN k & 4 > 0 THEN 'e' END], lambda x: x IS NOT NULL) AS ticks FROM c)
SELECT k::VARCHAR AS doc_id, 'regions' AS name, CASE WHEN NOT page OR len(ticks) = 0 THEN '[]' ELSE '["' || array_to_string(ticks, '","') || '"]' END AS value,
  CASE WHEN page THEN array_to_string(ticks, ', ') END AS raw_value, CASE WHEN page THEN 'ok' ELSE 'missing' END AS status, CASE WHEN page THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence, (NOT page)::INT AS n_warnings FROM t
UNION ALL SELECT k::VARCHAR, 'way', CASE WHEN page AND boxes AND n < 2 THEN ['a', 'g'][n::INT + 1] END, CASE WHEN page AND boxes AND n < 2 THEN ['a', 'g'][n::INT + 1] END,
  CASE WHEN page AND boxes THEN 'ok' ELSE 'missing' END, CASE WHEN page AND boxes THEN CASE WHEN n < 2 THEN 0.75 ELSE 0.5 END ELSE 0.0 END, CASE WHEN page AND boxes AND n < 2 THEN 0 ELSE 1 END FROM c
UNION ALL SELECT k::VARCHAR, 'signed', CASE WHEN page THEN (b > 0)::VARCHAR END, CASE WHEN page THEN (b > 0)::VARCHAR END, CASE WHEN page THEN 'ok' ELSE 'missing' END, CASE WHEN page THEN 0.7 ELSE 0.0 END, (NOT page)::INT FROM c
""")
def image_fields(t):
    lines, pages = _drawn(t)
    specs = [
        extract.FieldSpec("regions", "checkbox", options={"n": "north", "s": "south", "e": "east"}),
        extract.FieldSpec("way", "radio", options={"a": "alpha", "g": "gamma"}),
        extract.FieldSpec("signed", "signature", anchor=("Sign here",)),
    ]
    return extract.extract(lines, specs, pages).select("doc_id", "name", "value", "raw_value", "status", "confidence", F.size("warnings").alias("n_warnings"))


@query("""
SELECT c_custkey::VARCHAR AS doc_id, 'balance' AS name, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_acctbal < 100 THEN 'invalid_format' WHEN c_acctbal < 1000 THEN 'low_confidence' ELSE 'ok' END AS status,
  CASE WHEN c_acctbal < 0 THEN 1 WHEN c_acctbal < 100 THEN 2 WHEN c_acctbal < 1000 THEN 1 ELSE 0 END AS n_warnings FROM customer
""")
def validate_fields(t):
    b = F.col("c_acctbal")
    f = t("customer").select(
        F.col("c_custkey").cast("string").alias("doc_id"), F.lit("balance").alias("name"), F.when(b >= 0, b.cast("string")).alias("value"),
        F.when(b < 1000, 0.3).otherwise(0.9).alias("confidence"), F.lit("ok").alias("status"),
        F.when((b >= 0) & (b < 100), F.array(F.lit("small"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    specs = f.sparkSession.createDataFrame([("balance", True, 0.6)], "name string, required boolean, min_confidence double")
    return validate.validate_fields(f, specs).select("doc_id", "name", "status", F.size("warnings").alias("n_warnings"))


# --- business rules ---------------------------------------------------------------------------

ORDER_RULES = Catalogue(
    {"order": {"total": "TotalzzValue", "lines": "LineszzValue", "quantity": "QuantityzzValue", "unit": "UnitzzValue", "ordered": "OrderedzzValue", "first": "FirstShipzzValue", "last": "LastShipzzValue", "years": "YearszzValue"}},
    (
        Rule("order", "order.sum", "sum_equals", ("total", "lines")),
        Rule("order", "order.product", "equals_product", ("lines", "quantity", "unit"), relative_tolerance=0.2, severity="warning"),
        Rule("order", "order.within", "less_or_equal", ("lines", "total"), severity="warning"),
        Rule("order", "order.ship", "date_order", ("ordered", "first")),
        Rule("order", "order.span", "date_order", ("first", "last")),
        Rule("order", "order.years", "years_between", ("ordered", "last", "years"), tolerance_days=1500, severity="warning"),
        Rule("order", "order.zero", "sum_equals", ("absent", "absent"), null_as_zero=True),
    ),
)


def _order_facts(t) -> DataFrame:
    """Orders with the sums of their line items as facts; key suffixes as in long form keys."""
    li = t("lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,4)")).alias("quantity"),
        F.min(F.col("l_shipdate").cast("date")).alias("first"), F.max(F.col("l_shipdate").cast("date")).alias("last"),
    )
    o = t("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    long = lambda name: F.lit(f"FormContentzzForm1zz{name}zzValue")
    number = lambda c: F.struct(c.cast("decimal(24,4)").cast("string").alias("value"), F.lit("number").alias("kind"))
    date = lambda c: F.struct(F.date_format(c, "dd/MM/yyyy").alias("value"), F.lit("string").alias("kind"))
    cells = [("Total", number(F.col("o_totalprice"))), ("Lines", number(F.col("lines"))), ("Quantity", number(F.col("quantity"))), ("Unit", number(F.lit(1500))), ("Ordered", date(F.col("o_orderdate"))), ("FirstShip", date(F.col("first"))), ("LastShip", date(F.col("last"))), ("Years", number(F.lit(1)))]
    items = F.array(*[F.struct(long(n).alias("key"), c["value"].alias("value"), c["kind"].alias("kind")) for n, c in cells])
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("order").alias("form_id"), F.inline(items)).where("value is not null")


def _order_documents(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("order").alias("form_id"))


def _checks(t) -> DataFrame:
    return rules.check(_order_documents(t), _order_facts(t), ORDER_RULES)


_VALUES = """
WITH li AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,4)) AS lines, sum(l_quantity::DECIMAL(18,4)) AS quantity, min(l_shipdate::DATE) AS first, max(l_shipdate::DATE) AS last FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS doc_id, o_totalprice::DECIMAL(24,4) AS total, o_orderdate::DATE AS ordered, lines, quantity, first, last FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
c AS (SELECT doc_id, unnest([
  {'rule_id': 'order.sum', 'severity': 'error', 'ok': abs(total - lines) <= abs(lines) * 0.01},
  {'rule_id': 'order.product', 'severity': 'warning', 'ok': abs(lines - quantity * 1500) <= abs(quantity * 1500) * 0.2},
  {'rule_id': 'order.within', 'severity': 'warning', 'ok': lines <= total},
  {'rule_id': 'order.ship', 'severity': 'error', 'ok': ordered <= first},
  {'rule_id': 'order.span', 'severity': 'error', 'ok': first <= last},
  {'rule_id': 'order.years', 'severity': 'warning', 'ok': abs(date_diff('day', (ordered + INTERVAL 1 YEAR)::DATE, last)) <= 1500},
  {'rule_id': 'order.zero', 'severity': 'error', 'ok': true}], recursive := true) FROM o),
checks AS (SELECT doc_id, rule_id, severity, CASE WHEN ok THEN 'pass' WHEN NOT ok THEN 'violation' ELSE 'skipped' END AS status FROM c)
"""


def _one(rule_id: str):
    def run(t):
        return _checks(t).where(F.col("rule_id") == rule_id).select("doc_id", "status")

    run.__name__ = "rule_" + {"order.sum": "sum_equals", "order.product": "equals_product", "order.within": "less_or_equal", "order.ship": "date_order", "order.years": "years_between", "order.zero": "null_as_zero"}[rule_id]
    return query(_VALUES + f"SELECT doc_id, status FROM checks WHERE rule_id = '{rule_id}'")(run)


for _id in ("order.sum", "order.product", "order.within", "order.ship", "order.years", "order.zero"):
    _one(_id)


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS fund FROM orders),
r AS (SELECT k AS doc_id, 'eform92.charter_capital' AS rule_id, CASE k % 8 WHEN 0 THEN 'violation' WHEN 2 THEN 'skipped' ELSE 'pass' END AS status FROM o WHERE fund
UNION ALL SELECT k, 'eform92.lot_reconciliation', CASE WHEN k % 3 = 0 THEN 'violation' ELSE 'pass' END FROM o WHERE fund
UNION ALL SELECT k, 'eform92.offering_after_license', CASE WHEN k % 5 = 0 THEN 'violation' ELSE 'pass' END FROM o WHERE fund
UNION ALL SELECT k, 'eform7.' || x, CASE WHEN x IN ('outstanding_reconciliation', 'raised_reconciliation') THEN CASE WHEN (k % 3 = 0) = (x = 'raised_reconciliation') THEN 'violation' ELSE 'pass' END
  WHEN x = 'guarantee_covers_offer' THEN CASE WHEN k % 5 = 0 THEN 'violation' ELSE 'pass' END ELSE 'skipped' END
  FROM o, unnest(['offer_face_value', 'secured_covers_offer', 'guarantee_covers_offer', 'collateral_covers_secured', 'outstanding_reconciliation', 'raised_reconciliation', 'report_after_certificate_change']) AS t(x) WHERE NOT fund)
SELECT * FROM r
""")
def shipped_rules(t):
    """Checks of the shipped catalogue: even orders stand as documents of one form, odd ones of another."""
    k, u, fund, cents = F.col("k"), F.col("u"), F.col("k") % 2 == 0, lambda c: c.cast("string")
    o = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + 1).alias("u"), F.col("o_orderdate").cast("date").alias("day"))
    form, day = F.when(fund, "eform92").otherwise("eform7"), lambda c: F.date_format(c, "dd/MM/yyyy")
    even = {
        "charter_capital": cents(F.when(k % 8 == 2, F.lit(None)).when(k % 8 == 0, u * 2000).otherwise(u * 1000)), "fund_units": cents(u), "unit_par_value": F.lit("1.000"),
        "lots": cents(u), "units_per_lot": F.when(k % 3 == 0, "2").otherwise("1"),
        "license_date": day(F.col("day")), "offering_certificate_date": day(F.when(k % 5 == 0, F.date_sub("day", 1)).otherwise(F.date_add("day", 1))),
    }
    odd = {
        "outstanding_total": cents(F.when(k % 3 == 0, u * 3).otherwise(u * 4)), "outstanding_public": cents(u), "outstanding_private": cents(u * 2),
        "raised_total": cents(F.when(k % 3 == 0, u * 4).otherwise(u * 3)), "raised_public": cents(u), "raised_private": cents(u * 2),
        "offer_total": cents(u * 10), "guarantee_value": cents(F.when(k % 5 == 0, u * 9).otherwise(u * 10)),
    }
    entry = lambda name, f: [F.struct(F.lit(f"AzzBzz{shipped.KEYS[name][a]}").alias("key"), v.alias("value")) for a, v in f.items()]
    pairs = F.when(fund, F.array(*entry("eform92", even))).otherwise(F.array(*entry("eform7", odd)))
    docs = o.select("k", "u", "day", k.alias("doc_id"), form.alias("form_id"))
    facts = docs.select("doc_id", "form_id", F.explode(pairs).alias("p")).select("doc_id", "form_id", "p.*", F.when(F.col("p.value").isNull(), "null").otherwise("string").alias("kind"))
    return rules.check(docs.select("doc_id", "form_id"), facts, shipped.catalogue()).select("doc_id", "rule_id", "status")


@query("""
WITH k AS (SELECT n_nationkey AS doc_id, unnest(['AzzNamezzValue', 'BzzNamezzValue', 'CodezzValue', 'Exact']) AS key, n_name AS value FROM nation)
SELECT doc_id, 'code' AS alias, key, value FROM k WHERE key = 'CodezzValue' UNION ALL SELECT doc_id, 'exact', key, value FROM k WHERE key = 'Exact'
""")
def key_resolve(t):
    """A suffix that two keys have names neither; an exact key always wins."""
    keys = F.explode(F.array(*map(F.lit, ("AzzNamezzValue", "BzzNamezzValue", "CodezzValue", "Exact"))))
    f = t("nation").select(F.col("n_nationkey").alias("doc_id"), F.lit("n").alias("form_id"), keys.alias("key"), F.col("n_name").alias("value"), F.lit("string").alias("kind"))
    return rules.resolve(f, Catalogue({"n": {"name": "NamezzValue", "code": "CodezzValue", "exact": "Exact"}})).select("doc_id", "alias", "key", "value")


@query(_VALUES + """
, n AS (SELECT doc_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'violation') AS n_violation, count(*) FILTER (status = 'skipped') AS n_skipped,
  count(*) FILTER (status = 'violation' AND severity = 'error') AS n_error, count(*) FILTER (status = 'violation' AND severity = 'warning') AS n_warning FROM checks GROUP BY doc_id)
SELECT *, CASE WHEN n_pass + n_violation = 0 THEN 'not_assessed' WHEN n_error > 0 THEN 'non_compliant' WHEN n_warning > 0 THEN 'compliant_with_warnings' ELSE 'compliant' END AS overall FROM n
""")
def compliance_report(t):
    return rules.rollup(_order_documents(t), _checks(t)).drop("form_id")


@query(_VALUES + """
, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'violation') AS v, count(*) FILTER (status = 'skipped') AS s,
  list('[' || upper(severity) || '] Violated: ' || rule_id || '.' ORDER BY list_position(['order.sum', 'order.product', 'order.within', 'order.ship', 'order.span', 'order.years', 'order.zero'], rule_id)) FILTER (status = 'violation') AS bad FROM checks GROUP BY doc_id)
SELECT doc_id, n || ' rule checks for order: ' || p || ' passed, ' || v || ' violated, ' || s || ' not assessed.' || CASE WHEN v = 0 THEN ' No violations.' ELSE ' ' || array_to_string(bad[1:6], ' ') || CASE WHEN v > 6 THEN ' ' || (v - 6) || ' more violations.' ELSE '' END END AS summary FROM n
""")
def compliance_summary(t):
    return rules.summary(_checks(t))


#: Each case has the order's numbers with one of them changed; all rules are reckoned on all cases and on the orders themselves.
_CASES = _VALUES.split("c AS (SELECT doc_id, unnest")[0] + """
m AS (SELECT doc_id, NULL AS target, total, lines, quantity, ordered, first, last FROM o
  UNION ALL SELECT doc_id, 'order.sum', (total + greatest(abs(total) * 0.25, 1))::DECIMAL(24,4), lines, quantity, ordered, first, last FROM o WHERE total IS NOT NULL
  UNION ALL SELECT doc_id, 'order.product', total, CASE WHEN lines = 0 THEN 1 ELSE lines * 1.25 END, quantity, ordered, first, last FROM o WHERE lines IS NOT NULL
  UNION ALL SELECT doc_id, 'order.within', (lines / 2)::DECIMAL(24,4), lines, quantity, ordered, first, last FROM o WHERE lines IS NOT NULL AND total IS NOT NULL
  UNION ALL SELECT doc_id, 'order.ship', total, lines, quantity, ordered, ordered - 1, last FROM o WHERE ordered IS NOT NULL AND first IS NOT NULL
  UNION ALL SELECT doc_id, 'order.span', total, lines, quantity, ordered, first, first - 1 FROM o WHERE first IS NOT NULL AND last IS NOT NULL
  UNION ALL SELECT doc_id, 'order.years', total, lines, quantity, ordered, first, last + 370 FROM o WHERE last IS NOT NULL),
c AS (SELECT doc_id, target, unnest([
  {'rule_id': 'order.sum', 'ok': abs(total - lines) <= abs(lines) * 0.01},
  {'rule_id': 'order.product', 'ok': abs(lines - quantity * 1500) <= abs(quantity * 1500) * 0.2},
  {'rule_id': 'order.within', 'ok': lines <= total},
  {'rule_id': 'order.ship', 'ok': ordered <= first},
  {'rule_id': 'order.span', 'ok': first <= last},
  {'rule_id': 'order.years', 'ok': abs(date_diff('day', (ordered + INTERVAL 1 YEAR)::DATE, last)) <= 1500}], recursive := true) FROM m),
bad AS (SELECT doc_id, list(rule_id) FILTER (NOT ok) AS base FROM c WHERE target IS NULL GROUP BY doc_id),
cases AS (SELECT c.doc_id, target, list_sort(coalesce(list(rule_id) FILTER (NOT ok AND NOT list_contains(coalesce(base, []), rule_id)), [])) AS predicted, any_value(base) AS base
  FROM c JOIN bad USING (doc_id) WHERE target IS NOT NULL GROUP BY c.doc_id, target),
kept AS (SELECT doc_id, target, predicted FROM cases WHERE NOT list_contains(coalesce(base, []), target))
"""


@query(_CASES + "SELECT doc_id, target, array_to_string(predicted, ',') AS predicted FROM kept")
def mutation_benchmark(t):
    return _cases(t).withColumn("predicted", F.array_join("predicted", ","))


def _cases(t) -> DataFrame:
    return rules.mutation_benchmark(rules.values_of(_order_facts(t), ORDER_RULES), rules.rule_table(t("orders").sparkSession, ORDER_RULES))


@query(_CASES + """
, s AS (SELECT count(*) AS cases, sum(list_contains(predicted, target)::BIGINT)::BIGINT AS tp, sum(len(predicted) - list_contains(predicted, target)::BIGINT)::BIGINT AS fp, sum(1 - list_contains(predicted, target)::BIGINT)::BIGINT AS fn FROM kept)
SELECT cases, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM s
""")
def mutation_score(t):
    return rules.mutation_score(_cases(t)).select("cases", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# --- evaluation -------------------------------------------------------------------------------


def _gold(t) -> DataFrame:
    o = t("orders")
    body = F.to_json(F.struct(F.lit("order").alias("form_type"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")).alias("head"), F.array("o_orderpriority", "o_orderstatus").alias("tags")))
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"), body.alias("body"))


@query("""
SELECT o_orderkey::VARCHAR AS doc_id, unnest(['head.id', 'head.state', 'tags']) AS path, unnest(['scalar', 'scalar', 'set']) AS kind,
  unnest([o_orderkey::VARCHAR, '"' || o_orderstatus || '"', '["' || o_orderpriority || '", "' || o_orderstatus || '"]']) AS value FROM orders
""")
def json_flatten(t):
    return evaluation.flatten(_gold(t))


@query("""
SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
""")
def variant_fields(t):
    e = t("events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("path", "value")).where("path = 'k'")


@query("""
SELECT doc_id, quality = 1 AS gt_truth, (quality = toxic) AS exact, CASE WHEN quality = toxic THEN NULL ELSE 'format_error' END AS error_type FROM labels
""")
def compare_scalar(t):
    lab = t("labels").select("doc_id", (F.col("quality") == 1).alias("gt_truth"), F.col("toxic").cast("string").alias("pred"), F.col("quality").cast("string").alias("gold"))
    return evaluation.compare_scalars(lab).select("doc_id", "gt_truth", "exact", "error_type")


@query("""
WITH s AS (SELECT l_suppkey, list(DISTINCT lower(p_brand)) AS b, list(DISTINCT lower(p_brand)) FILTER (p_size <= 25) AS g FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)
SELECT l_suppkey, len(b) = len(coalesce(g, [])) AS exact, round(len(coalesce(g, []))::DOUBLE / len(b), 9) AS similarity FROM s
""")
def compare_set(t):
    s = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("b"), F.collect_set(F.when(F.col("p_size") <= 25, F.col("p_brand"))).alias("g"))
    exact, sim = evaluation.compare_arrays(F.col("b"), F.col("g"))
    return s.select("l_suppkey", exact.alias("exact"), F.round(sim, 9).alias("similarity"))


@query()
def compare_table(t):
    """Line items of an order against a copy with some quantities changed and rows reversed: greedy matching."""
    row = lambda q: F.struct(F.col("l_partkey").alias("part"), q.alias("quantity"), F.col("l_returnflag").alias("flag"))
    changed = F.when(F.col("l_linenumber") == 2, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    g = t("lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.sort_array(F.collect_list(row(F.col("l_quantity"))))).alias("gold"), F.to_json(F.sort_array(F.collect_list(row(changed)), asc=False)).alias("pred")
    )
    return evaluation.compare_tables(g).select("l_orderkey", "exact", F.round("similarity", 9).alias("similarity"), "error_type")


@query("""
WITH o AS (SELECT lang AS path, source AS form_type, quality = (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS exact FROM labels JOIN documents USING (doc_id)),
g AS (SELECT path, form_type, count(*) AS n, count(*) FILTER (exact) AS n_exact FROM o GROUP BY GROUPING SETS ((path), (form_type), ()))
SELECT path, form_type, n, n_exact, n_exact AS tp, n - n_exact AS fp, n - n_exact AS fn, round(n_exact / n::DOUBLE, 9) AS precision, round(n_exact / n::DOUBLE, 9) AS accuracy FROM g
""")
def eval_report(t):
    """A length heuristic against the quality labels by language, source and overall."""
    guess = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    o = t("labels").join(t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    exact = F.col("quality") == guess
    o = o.select(F.col("lang").alias("path"), F.col("source").alias("form_type"), F.lit(True).alias("gt_present"), F.lit(True).alias("pred_present"), exact.alias("exact"), exact.cast("double").alias("similarity"), F.when(~exact, "format_error").alias("error_type"))
    return evaluation.aggregate(o).select("path", "form_type", "n", "n_exact", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("accuracy", 9).alias("accuracy"))


@query("""
SELECT o_orderkey AS doc_id, '{"head": {"priority": "' || o_orderpriority || '", "state": "' || o_orderstatus || '"}, "_meta": {"head.priority": {"confidence": 0.9, "status": "ok", "warnings": []}, "head.state": {"confidence": 0.9, "status": "ok", "warnings": []}}}' AS body FROM orders
""")
def assemble_json(t):
    o = t("orders")
    rows = F.array(F.struct(F.lit("head.state").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("head.priority").alias("name"), F.col("o_orderpriority").alias("value")))
    f = o.select(F.col("o_orderkey").alias("doc_id"), F.inline(rows)).withColumns({"confidence": F.lit(0.9), "status": F.lit("ok"), "warnings": F.array().cast("array<string>")})
    return forms.assemble(f)
