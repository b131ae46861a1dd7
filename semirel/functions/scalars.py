"""The scalar operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lt(a: Column, b: Column) -> Column:
    return a < b


def le(a: Column, b: Column) -> Column:
    return a <= b


def lt_real(a: Column, b: Column) -> Column:
    """A comparison as the number 0 or 1."""
    return (a < b).cast("double")


def eq(a: Column, b: Column) -> Column:
    return a == b


def ne(a: Column, b: Column) -> Column:
    return a != b


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def mid(a: Column, b: Column) -> Column:
    """The whole half of the sum."""
    return F.floor((a + b) / 2).cast("long")


def divide(a: Column, b: Column) -> Column:
    """Null where ``b`` is zero."""
    return F.try_divide(a, b)


def negate(a: Column) -> Column:
    return ~a


def succ(a: Column) -> Column:
    return a + 1


def atoi(text: Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def atof(text: Column) -> Column:
    """The real number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def of_bool(a: Column, kind: str = "long") -> Column:
    return a.cast(kind)


def to_num(a: Column) -> Column:
    return a.cast("double")


def ternary(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def access(array: Column, i: Column) -> Column:
    """Element at a zero-based place, null outside."""
    return F.get(array, i)


def find_str(part: Column, text: Column) -> Column:
    """Zero-based place of a substring in characters, -1 where there is none or the text is null."""
    return F.coalesce(F.locate(part, text) if isinstance(part, str) else F.position(part, text), F.lit(0)) - 1


def has_substr(text: Column, part: str) -> Column:
    return F.coalesce(F.contains(text, F.lit(part)), F.lit(False))


def date_to_year(date: Column) -> Column:
    """Calendar year of a date or timestamp."""
    return F.year(date)


def epoch_to_year(seconds: Column) -> Column:
    """Calendar year in UTC of seconds since 1970, whatever the session's time zone."""
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")))
