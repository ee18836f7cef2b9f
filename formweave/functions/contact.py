"""Field normalisers: text to STRUCT<value, warnings>, and their table by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, numbers
from .fuzzy import best_choice
from .numbers import _outcome, digits
from .text import clean_spaces, strip_accents


def phone(c: Column) -> Column:
    return _outcome(digits(c), (~F.length(digits(c)).between(9, 11), "unusual phone number"))


def id_number(c: Column) -> Column:
    return _outcome(digits(c), (~F.length(digits(c)).isin(9, 12), "unusual identity number"))


def email(c: Column) -> Column:
    v = F.replace(F.lower(clean_spaces(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))
    return _outcome(v, (~v.rlike("^[^@\\s]+@[^@\\s]+[.][^@\\s]+$"), "not an email address"))


def account(c: Column) -> Column:
    return _outcome(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s", "")))


def symbol(c: Column) -> Column:
    v = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))
    return _outcome(v, (~F.length(v).between(2, 10), "unusual symbol"))


def date(c: Column) -> Column:
    v = F.date_format(dates.search_date(c), "yyyy-MM-dd")
    return _outcome(v, (v.isNull(), "no valid date"))


def datetime(c: Column) -> Column:
    v = dates.search_datetime(c)
    return _outcome(v, (v.isNull(), "no valid date"))


def choice(c: Column, choices: list[str]) -> Column:
    """The first choice that equals, holds or is held by the text once folded, else the one most like it, else the text and a warning.

    Likeness is ``fuzzy.best_choice``, in Arrow batches; texts of another length than it allows aren't sent there.
    """
    key = F.trim(F.lower(strip_accents(c)))
    fold = lambda s: F.trim(F.lower(strip_accents(F.lit(s))))
    hit = F.coalesce(*[F.when((key == fold(s)) | key.contains(fold(s)) | fold(s).contains(key), F.lit(s)) for s in choices])
    blank = F.coalesce(F.trim(c), F.lit("")) == ""
    sizes = [len(s) for s in choices]
    unsure = hit.isNull() & ~blank & F.length(key).between(min(sizes) * 2 // 3, max(sizes) * 3 // 2 + 1)
    hit = F.coalesce(hit, best_choice(choices)(F.when(unsure, key)))
    return _outcome(F.when(~blank, F.coalesce(hit, c)), (blank, "no choice"), (~blank & hit.isNull(), "not one of the choices"))


NORMALIZERS = {
    "string": lambda c: _outcome(clean_spaces(c)),
    "date": date,
    "datetime": datetime,
    "int": numbers.parse_int_checked,
    "money": numbers.parse_int_checked,
    "price": numbers.parse_price,
    "percent": lambda c: _outcome(numbers.parse_float(c), (numbers.parse_float(c).isNull(), "no number")),
    "phone": phone,
    "email": email,
    "id_number": id_number,
    "account_number": account,
    "symbol": symbol,
}
