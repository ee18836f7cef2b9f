import pytest
from pyspark.sql import functions as F

from formweave.functions import contact, dates, fuzzy, geometry, numbers, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.strip_accents, "Trần Lữ Đào", "Tran Lu Dao"),
        (text.strip_accents, "é", "e"),
        (text.norm_key, "  Mã Kho –:  ", "ma kho –"),
        (text.clean_spaces, "a   b\n c", "a b c"),
        (numbers.parse_int, "7.300", 7300),
        (numbers.parse_int, "1,234,567", 1234567),
        (numbers.parse_int, "61 400", 61400),
        (numbers.parse_int, "abc", None),
        (numbers.parse_float, "1.234,5", 1234.5),
        (numbers.parse_float, "12,34 %", 12.34),
        (numbers.parse_float, "1.234", 1.234),
    ],
)
def test_scalars(spark, f, given, expected):
    assert one(spark, f(F.col("v")), v=given) == expected


@pytest.mark.parametrize(("given", "expected"), [("500 tỷ đồng", 500000000000), ("1.234.567", 1234567), ("8,5%", 8.5), ("8.125", 8125), ("1,234.5", 1234.5), ("3 triệu", 3000000), ("-12", -12), ("x", None)])
def test_rule_numbers(spark, given, expected):
    got = one(spark, numbers.parse_number(F.col("v")), v=given)
    assert (None if got is None else float(got)) == expected


@pytest.mark.parametrize(("given", "expected"), [("17/06/1984", "1984-06-17"), ("02-12-2011", "2011-12-02"), ("1.1.2020", "2020-01-01"), ("ngày 8 tháng 11 năm 2019", "2019-11-08"), ("ngay 9 thang 3 nam 2018", "2018-03-09"), ("32/13/2020", None), ("none", None)])
def test_search_date(spark, given, expected):
    assert one(spark, dates.search_date(F.col("v")).cast("string"), v=given) == expected


def test_strict_dates(spark):
    assert one(spark, dates.parse_date(F.col("v")).cast("string"), v="26/05/2022") == "2022-05-26"
    assert one(spark, dates.parse_date(F.col("v")).cast("string"), v="2023-01-31T22:10:00-05:00") == "2023-01-31"
    assert one(spark, dates.parse_date(F.col("v")), v="on 26/05/2022") is None
    assert one(spark, dates.add_years(F.lit("2024-02-29").cast("date"), F.lit(1)).cast("string")) == "2025-02-28"


def test_contacts(spark):
    assert one(spark, contact.phone(F.col("v")), v="0912 000 765").warnings == []
    assert len(one(spark, contact.phone(F.col("v")), v="09 12").warnings) == 1
    assert one(spark, contact.email(F.col("v")), v=" Kho.Bac@Example.ORG ").value == "kho.bac@example.org"
    assert len(one(spark, contact.email(F.col("v")), v="kho bac").warnings) == 1
    assert one(spark, contact.account(F.col("v")), v=" k77 b3 ").value == "K77B3"
    assert one(spark, contact.choice(F.col("v"), ["Đường biển", "Đường sắt"]), v="duong SAT").value == "Đường sắt"
    assert one(spark, contact.choice(F.col("v"), ["Đường biển", "Đường sắt"]), v="duong bjen").value == "Đường biển"
    assert len(one(spark, contact.choice(F.col("v"), ["Kho"]), v="xyz").warnings) == 1


def test_fuzzy_against_dynamic_programming():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.lcs(a, b) == t[-1][-1]


def test_boxes(spark):
    a, b = geometry.box(*map(F.lit, (0, 0, 10, 10))), geometry.box(*map(F.lit, (5, 0, 15, 10)))
    assert abs(one(spark, geometry.iou(a, b)) - 50 / 150) < 1e-12
    assert one(spark, geometry.area(geometry.box(*map(F.lit, (0, 0, 10, 20))))) == 200


def test_partial_ratio_against_every_window():
    import random

    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 25))) for _ in range(2))
        x, y = sorted((a, b), key=len)
        n = len(x)
        want = max(fuzzy.ratio_of(x, y[max(0, k) : k + n]) for k in range(1 - n, len(y)))
        assert abs(fuzzy.partial_of(a, b) - want) < 1e-9
    assert fuzzy.partial_of("", "") == 100.0 and fuzzy.partial_of("", "x") == 0.0 and fuzzy.partial_of(None, "x") == 0.0
