"""Numbers in Vietnamese notation: separators are inferred, results are typed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operands of rules. Products of two stay within 38 digits.
OPERAND = "decimal(24,4)"


def _outcome(value: Column, *warnings: tuple[Column, str]) -> Column:
    """STRUCT<value, warnings>: the shape every field normaliser returns."""
    listed = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in warnings])) if warnings else F.array().cast("array<string>")
    return F.struct(value.alias("value"), listed.alias("warnings"))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def parse_int(c: Column) -> Column:
    """All digits as one whole number; sign and decimal mark are lost."""
    return digits(c).try_cast("bigint")


def parse_int_checked(c: Column) -> Column:
    return _outcome(parse_int(c), (digits(c) == "", "no digits"))


def parse_price(c: Column) -> Column:
    return _outcome(parse_int(c))


def parse_float(c: Column) -> Column:
    """The last of point and comma is the decimal mark; a lone point is one too."""
    s = F.regexp_replace(c, "[^0-9.,\\-]", "")
    dot, comma = F.length(s) - F.instr(F.reverse(s), "."), F.length(s) - F.instr(F.reverse(s), ",")
    both = s.contains(".") & s.contains(",")
    plain = (
        F.when(both & (comma > dot), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(s, F.lit(","), F.lit("")))
        .otherwise(F.replace(s, F.lit(","), F.lit(".")))
    )
    return F.when(s.rlike("[0-9]"), plain.try_cast("double"))


def parse_number(c: Column) -> Column:
    """Numbers of rule operands from text: groups of three are thousands; tỷ and triệu scale.

    Null where there is no number or it doesn't fit the operand type.
    """
    low = F.lower(F.trim(c))
    token = F.regexp_replace(F.regexp_extract(low, "[-+]?[0-9][0-9.,\\s]*", 0), "\\s+", "")
    bare = F.regexp_replace(token, "^[-+]+", "")
    last_comma = F.instr(F.reverse(token), ",") < F.instr(F.reverse(token), ".")
    no_dots, no_commas = F.replace(token, F.lit("."), F.lit("")), F.replace(token, F.lit(","), F.lit(""))
    point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    plain = (
        F.when(token.contains(".") & token.contains(","), F.when(last_comma, point(no_dots)).otherwise(no_commas))
        .when(token.contains("."), F.when(bare.rlike("^[0-9]*([.][0-9]{3})+$"), no_dots).otherwise(token))
        .when(token.contains(","), F.when(bare.rlike("^[^,]*,[^,]*,.*$") | bare.rlike("^[^,]*,[0-9]{3}$"), no_commas).otherwise(point(token)))
        .otherwise(token)
    )
    scale = F.when(low.contains("tỷ") | low.contains("ty"), F.lit(1_000_000_000)).when(low.contains("triệu") | low.contains("trieu"), F.lit(1_000_000)).otherwise(F.lit(1))
    value = F.try_multiply(F.when(plain.rlike("^[-+]?[0-9]+[.]?[0-9]*$"), plain).try_cast("decimal(20,4)"), scale.cast("decimal(10,0)"))
    return value.try_cast(OPERAND)


def display_decimal(c: Column) -> Column:
    """Whole numbers with points between thousands; others plain with a decimal comma."""
    whole = F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))
    rest = F.replace(F.regexp_replace(c.cast("string"), "0+$", ""), F.lit("."), F.lit(","))
    return F.when(c == F.floor(c), whole).otherwise(rest)


def close(actual: Column, expected: Column, relative: Column, absolute: Column) -> Column:
    """|actual - expected| within the larger of the absolute and the relative tolerance."""
    return F.abs(actual - expected) <= F.greatest(absolute, F.abs(expected) * relative)
