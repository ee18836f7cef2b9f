import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from formweave.functions import png
from formweave.operators import evaluation, extract, forms, images, layout, recognise, rules, shipped
from formweave.plans import documents
from formweave.queries import ORACLES, QUERIES
from formweave.schema import LINES, PAGES, WORDS


def lines(spark, *rows):
    return spark.createDataFrame([("d", 0, k, t, *map(float, box), 0.9) for k, (t, box) in enumerate(rows)], LINES)


def value(spark, ls, **spec):
    return extract.extract(ls, [extract.FieldSpec.of({"name": "f", **spec})]).first()


def test_anchor(spark):
    ls = lines(spark, ("Địa chỉ kho:", (40, 30, 120, 44)), ("12 Phố Lụa", (130, 31, 260, 44)), ("Mã kho", (40, 60, 90, 74)), ("K-77", (42, 78, 90, 92)))
    assert value(spark, ls, anchor="Dia chi kho").value == "12 Phố Lụa"
    assert value(spark, ls, anchor="Mã kho", value_direction="below").value == "K-77"
    tail = lines(spark, ("Tổng: 40 thùng", (0, 0, 90, 12)), ("xa", (0, 300, 9, 309)))
    # The whole line is compared with the label, not what stands before its colon.
    assert value(spark, tail, anchor="Tổng").status == "missing" and value(spark, tail, anchor="Tổng: 40 thung").value == "40 thùng"
    assert value(spark, lines(spark, ("qrs", (0, 0, 9, 9))), anchor=["Kho"]).status == "missing"
    assert value(spark, ls, strategy="nobody").warnings == ["unknown strategy: nobody"]


def test_region_and_rule(spark):
    ls = lines(spark, ("TRONG VUNG", (60, 5, 90, 15)), ("out", (5, 80, 40, 92)))
    assert value(spark, ls, strategy="layout", options={"region": [0.5, 0, 1, 0.3], "page_size": [100, 100]}).value == "TRONG VUNG"
    assert value(spark, ls, strategy="layout", options={"region": [0.5, 0, 1, 0.3]}).value == "TRONG VUNG"
    ls = lines(spark, ("Kho Bắc nhận 31 kiện (gấp)", (0, 0, 9, 9)))
    rule = lambda regex: value(spark, ls, strategy="rule", regex=regex)
    assert rule(r"nhan (\d+ kien)").value == "31 kien" and rule(r"nhan (\d+ kien)").confidence == 0.9
    assert rule(r"(?=nhan)nhan").value == "nhan" and rule(r"\(\w+\)").value == "(gap)" and rule("(?:kho) BẮC").value == "Kho Bắc"


def test_table_strategy(spark):
    ls = lines(spark, ("Item", (0, 0, 40, 10)), ("Count", (100, 0, 140, 10)), ("nut", (0, 20, 10, 30)), ("9", (100, 20, 110, 30)), ("Total", (0, 40, 30, 50)), ("9", (100, 40, 110, 50)))
    got = value(spark, ls, strategy="table", options={"columns": [{"name": "item", "header": ["Item"]}, {"name": "count", "header": ["Count"]}], "stop_keywords": ["total"]})
    assert (got.value, got.source, got.status) == ('[{"item": "nut", "count": "9"}]', "table", "ok")


def test_classification_by_partial_ratio(spark):
    known = [forms.Form("receipt", ("goods received", "warehouse")), forms.Form("letter", ("dear sir", "yours truly"))]
    rows = [(1, "Gods received at the warehouse"), (2, "Dear sr, we are yours truely"), (3, "nothing of it"), (4, None), (5, "")]
    got = {r.doc_id: (r.form, r.score) for r in forms.classify(spark.createDataFrame(rows, "doc_id int, text string"), known).collect()}
    assert got == {1: ("receipt", 1.0), 2: ("letter", 1.0), 3: ("generic", 0.0), 4: ("generic", 0.0), 5: ("generic", 0.0)}


def test_reports(spark, tmp_path):
    import csv
    import zipfile
    from io import BytesIO
    from xml.etree import ElementTree

    from formweave.sources import sinks

    out = [("a.b", "f", True, True, True, 1.0, None), ("a.b", "f", True, False, False, 0.0, "missing"), ("c", "g", True, True, False, 0.5, "format_error")]
    table = evaluation.aggregate(spark.createDataFrame(out, "path string, form_type string, gt_present boolean, pred_present boolean, exact boolean, similarity double, error_type string"))
    paths = sinks.write_evaluation(table, str(tmp_path), "own")
    rows = list(csv.reader(open(paths[1], encoding="utf-8")))
    assert rows[0] == ["field", "n", "exact", "accuracy", "mean_similarity", "precision", "recall", "f1", "missing", "extra", "ocr_error", "format_error"]
    assert rows[1] == ["a.b", "2", "1", "0.5", "0.5", "1.0", "0.5", "0.6667", "1", "0", "0", "0"] and rows[2][0] == "c"
    assert "| a.b | 2 | 50.0% |" in open(paths[0], encoding="utf-8").read()
    docs = spark.createDataFrame([("d", "f")], "doc_id string, form_id string")
    checks = rules.check(docs, _values(spark, [("total", "1 & <2>")]), CATALOGUE).orderBy("ord").collect()
    package = zipfile.ZipFile(BytesIO(sinks.compliance_docx("f", "non_compliant", "one < two", checks)))
    main = ElementTree.fromstring(package.read("report.xml"))
    texts = [x.text for x in main.iter() if x.tag.endswith("}t")]
    assert "one < two" in texts and "product" in texts and len([x for x in main.iter() if x.tag.endswith("}tr")]) == 5
    payload = rules.llm_payload(rules.check(docs, _values(spark), CATALOGUE).withColumn("form_type", F.lit('a"b'))).first().payload
    assert json.loads(payload)["form_type"] == 'a"b' and len(json.loads(payload)["checks"]) == 4


def test_form_rules_keep_accents(spark):
    form = forms.Form("f", rules=(forms.TextRule("name", "text", r"Ho va ten: (.*?) So tai khoan"), forms.TextRule("n", "digits", r"So tai khoan: (\d+)")))
    docs = spark.createDataFrame([("d", "Họ và tên: Nguyễn Văn Ánh  Số tài khoản: 0123")], "doc_id string, text string")
    got = {r.name: r.value for r in forms.apply_rules(docs, form).collect()}
    assert got["results.name"] == "Nguyễn Văn Ánh" and got["results.n"] == "0123"


def test_words_to_lines(spark):
    rows = [("d", 0, 1, 1, n, k, t, c, 20 * k, 0, 20, 10) for k, (n, t, c) in enumerate([(1, "Họ", "95"), (1, "và", "90"), (1, "tên", "-1"), (1, "", "0"), (2, "Nguyễn", "80")])]
    got = recognise.words_to_lines(spark.createDataFrame(rows, WORDS)).orderBy("text").collect()
    assert [(r.text, round(r.confidence, 3)) for r in got] == [("Họ và", 0.925), ("Nguyễn", 0.8)]


def test_table(spark):
    ls = lines(spark, ("Name", (0, 0, 40, 10)), ("Units", (100, 0, 140, 10)), ("A", (0, 20, 10, 30)), ("5", (100, 20, 110, 30)), ("B", (0, 40, 10, 50)), ("7", (100, 41, 110, 51)))
    got = layout.extract_table(ls, [{"name": "name", "header": ["Name"]}, {"name": "units", "header": ["Units"]}]).first()
    assert got.records == '[{"name": "A", "units": "5"}, {"name": "B", "units": "7"}]'


def _values(spark, changes=()):
    v = {"par": "4.000", "shares": "30.000", "total": "120.000.000", "raised": "90.000.000", "cert": "03/02/2021", "end": "19/05/2021", "report": "2021-08-07T00:00:00+00:00"} | dict(changes)
    rows = [("d", "f", f"Xzz{k}zzValue", x, "string") for k, x in v.items() if x is not None]
    return spark.createDataFrame(rows, "doc_id string, form_id string, key string, value string, kind string")


CATALOGUE = rules.Catalogue(
    {"f": {k: f"{k}zzValue" for k in ("par", "shares", "total", "raised", "cert", "end", "report")}},
    (
        rules.Rule("f", "product", "equals_product", ("total", "shares", "par")),
        rules.Rule("f", "within", "less_or_equal", ("raised", "total"), mutation_side="left"),
        rules.Rule("f", "cert", "date_order", ("cert", "end")),
        rules.Rule("f", "report", "date_order", ("end", "report")),
    ),
)


def test_rules(spark):
    docs = spark.createDataFrame([("d", "f")], "doc_id string, form_id string")
    report = lambda facts: rules.rollup(docs, rules.check(docs, facts, CATALOGUE)).first()
    clean = report(_values(spark))
    assert (clean.n_pass, clean.n_violation, clean.overall) == (4, 0, "compliant")
    bad = report(_values(spark, [("total", "150.000.000"), ("report", "2020-01-01")]))
    assert (bad.n_violation, bad.overall) == (2, "non_compliant")
    assert report(_values(spark, [("par", None)])).n_skipped == 1


def test_shipped_catalogue(spark):
    c = shipped.catalogue()
    assert len(c.rules) == 41 and len({r.id for r in c.rules}) == 41 and {r.operation for r in c.rules} == set(rules.OPERATIONS)
    assert all(a in c.selectors[r.form_type] for r in c.rules for a in (*r.operands, *filter(None, [r.mutation_alias])))
    span = next(r for r in c.rules if r.id == "eform94.old_duration")
    assert (span.operands, span.title, span.tolerance_days) == (("old_start", "old_end", "duration_before"), "old start .. old end = duration before", 1)
    assert [r.id for r in c.rules if not r.eval_mutation] == ["eform100.document_after_bank_license", "eform100.document_after_custody_certificate"]
    with pytest.raises(ValueError):
        shipped.parse_rule("f", "x: a >> b")
    facts = spark.createDataFrame([("d", "eform85", f"Form zz{shipped.KEYS['eform85'][a]}", v, "string") for a, v in {"birth_date": "1980-02-03", "id_date": "03/02/1980", "certificate_date": "1979-12-31"}.items()], "doc_id string, form_id string, key string, value string, kind string")
    docs = spark.createDataFrame([("d", "eform85"), ("e", "unheard of")], "doc_id string, form_id string")
    got = {r.doc_id: r for r in documents.comply(docs, facts).collect()}
    assert (got["d"].n_pass, got["d"].n_violation, got["d"].overall, got["e"].overall) == (1, 1, "non_compliant", "not_assessed")


def test_mutations(spark):
    v = rules.values_of(_values(spark), CATALOGUE)
    s = rules.mutation_score(rules.mutation_benchmark(v, rules.rule_table(spark, CATALOGUE))).first()
    assert (s.cases, s.tp, s.fp, s.fn, s.f1) == (4, 4, 0, 0, 1.0)
    # Two aliases that read one key change together.
    both = rules.Catalogue({"f": {"a": "totalzzValue", "b": "Xzztotalzz" + "Value", "c": "raisedzzValue"}}, (rules.Rule("f", "r", "sum_equals", ("a", "c")), rules.Rule("f", "s", "less_or_equal", ("b", "c"))))
    facts = _values(spark, [("total", "90.000.000")])
    cases = {c.target: c.predicted for c in rules.mutation_benchmark(rules.values_of(facts, both), rules.rule_table(spark, both)).collect()}
    assert cases == {"r": ["r", "s"], "s": ["r", "s"]}


def test_compare_documents(spark):
    body = '{"form_type": "x", "a": {"b": "Phố Lụa", "n": 1}, "tags": ["p", "q"], "rows": [{"k": 1, "v": "x"}], "_meta": {}}'
    pred = '{"a": {"b": "Pho Lua", "n": 1.0}, "tags": ["q", "p"], "rows": [{"k": 1, "v": "y"}]}'
    df = lambda b: spark.createDataFrame([("d", b)], "doc_id string, body string")
    got = {r.path: r for r in evaluation.compare_documents(df(body), df(pred)).collect()}
    assert set(got) == {"a.b", "a.n", "tags", "rows"}
    assert got["a.b"].error_type == "ocr_error" and got["a.n"].exact and got["tags"].exact
    assert got["rows"].similarity == 0.5 and got["rows"].error_type == "format_error"


def test_images():
    page = np.full((120, 160), 255, np.uint8)
    page[40:80, 50:110] = 0
    assert images.auto_crop(page).shape == (64, 84)
    assert images.auto_crop(np.full((50, 50), 255, np.uint8)).shape == (50, 50)
    box = np.full((60, 60), 255, np.uint8)
    box[10:30, 10:12] = box[10:30, 28:30] = box[10:12, 10:30] = box[28:30, 10:30] = 0
    (found,) = images.find_boxes(box, 20)
    assert not images.ticked(box, found)
    box[15:25, 15:25] = 0
    assert images.ticked(box, found)


def test_png(spark):
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (17, 23), (9, 14, 3)):
        img = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(png.decode_png(png.encode_png(img)), img)
    # Filters against a plain loop over the bytes.
    x, kinds, n = rng.integers(0, 256, (10, 7, 3), dtype=np.uint8), np.arange(10) % 5, 3
    done = [[0] * 21]
    for kind, row in zip(kinds, x.reshape(10, 21).tolist()):
        out = []
        for i, v in enumerate(row):
            a, b, c = (out[i - n] if i >= n else 0), done[-1][i], (done[-1][i - n] if i >= n else 0)
            paeth = min((a, b, c), key=lambda q: abs(a + b - c - q))
            out.append((v + (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        done.append(out)
    assert png._unfilter(kinds.astype(np.uint8), x).reshape(10, 21).tolist() == done[1:]
    for bad in (b"", b"no image", png.encode_png(img)[:40]):
        with pytest.raises(ValueError):
            png.decode_png(bad)
    page = np.full((30, 40), 255, np.uint8)
    pages = spark.createDataFrame([("d", 0, 72, 40, 30, 1, page.tobytes()), ("e", 0, 72, 0, 0, 0, None)], PAGES)
    got = {r.source: r for r in images.overlay(pages, lines(spark, ("x", (5, 5, 20, 15)))).collect()}
    drawn = images.decode(got["d"].image, 30, 40, 3)
    assert (drawn != 255).any(2).sum() == 15 * 10 - 11 * 6 and got["e"].image is None
    assert {r.source: r.content is None for r in images.to_files(pages).collect()} == {"d": False, "e": True}


def test_marks(spark):
    page = np.full((120, 200), 255, np.uint8)
    page[20:32, 30:42] = 0
    page[22:30, 32:40] = 255
    yy, xx = np.mgrid[:120, :200]
    page[np.abs((yy - 66) ** 2 + (xx - 36) ** 2 - 30) < 9] = 0
    page[64:69, 34:39] = 0
    assert images.outlines(images.dark(page)) == [(30, 20, 42, 32), (30, 60, 43, 73)]
    assert images.box_ink(page, (46, 20, 90, 32)) == 0 and images.box_ink(page, (46, 60, 90, 72)) > 0.3 and images.box_ink(page, (150, 20, 190, 32)) is None
    ls = lines(spark, ("Mail", (46, 20, 90, 32)), ("Post", (46, 60, 90, 72)), ("Nobody", (150, 20, 190, 32)), ("Ký tên", (120, 80, 160, 90)))
    pages = spark.createDataFrame([("d", 0, 72, 200, 120, 1, page.tobytes())], PAGES)
    of = lambda p, **spec: extract.extract(ls, [extract.FieldSpec.of({"name": "f", **spec})], p).first()
    assert (of(pages, strategy="checkbox", options={"m": "Mail", "p": "Post", "n": "Nobody"}).value, of(pages, strategy="checkbox", options={}).status) == ('["p"]', "missing")
    assert of(pages, strategy="radio", options={"m": "Mail", "p": "Post"}).value == "p"
    none = of(pages, strategy="radio", options={"m": "Mail"})
    assert (none.value, none.status, none.confidence, len(none.warnings)) == (None, "ok", 0.5, 1)
    assert of(pages, strategy="radio", options={"n": "Nobody"}).status == "missing"
    assert (of(pages, strategy="signature").value, of(pages, strategy="signature", anchor="Sworn").confidence) == ("false", 0.5)
    assert {of(p, strategy=s, options={"m": "Mail"}).status for p in (None, pages.limit(0)) for s in ("checkbox", "radio", "signature")} == {"missing"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_images_are_not_broadcast(spark):
    """The planner takes images for small; they must not be collected on the driver whatever it thinks."""
    lines = spark.createDataFrame([("1", 0, 0, "Sign here", 20.0, 10.0, 60.0, 22.0, 0.9)], "doc_id string, page_index int, line_no int, text string, x1 double, y1 double, x2 double, y2 double, confidence double")
    pages = spark.createDataFrame([("1", 0, 72, 80, 80, 1, bytearray(b"\xff" * 6400))], "source string, page_index int, dpi int, width int, height int, channels int, image binary")
    seen, _ = extract._on_first_page(lines, pages, [extract.FieldSpec("s", anchor=("Sign here",))], lambda gray, box: gray.shape[0])
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [doc_id" not in plan and "SortMergeJoin [doc_id" in plan
    assert [tuple(r) for r in seen.collect()] == [("1", "s", 1, 80.0)]
