"""Indicator relations: comparisons of a key with constants, ranges and masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from semirel.relation import Pred


def where(f: Callable[..., Column], *keys: str) -> Pred:
    return Pred(keys, f)


def eq(key: str, x: object) -> Pred:
    return Pred((key,), lambda k: k == F.lit(x))


def ge(key: str, x: object) -> Pred:
    return Pred((key,), lambda k: k >= F.lit(x))


def gt(key: str, x: object) -> Pred:
    return Pred((key,), lambda k: k > F.lit(x))


def le(key: str, x: object) -> Pred:
    return Pred((key,), lambda k: k <= F.lit(x))


def lt(key: str, x: object) -> Pred:
    return Pred((key,), lambda k: k < F.lit(x))


def between(key: str, low: object, high: object) -> Pred:
    """``low <= key < high``."""
    return ge(key, low) & lt(key, high)


def between_incl(key: str, low: object, high: object) -> Pred:
    """``low <= key <= high``; equality where both are the same."""
    return eq(key, low) if low == high else ge(key, low) & le(key, high)


def contains(key: str, part: str) -> Pred:
    """Keys that hold a substring; an absent key holds none."""
    return Pred((key,), lambda k: F.coalesce(F.contains(k, F.lit(part)), F.lit(False)))


def lower_triangle(row: str, column: str) -> Pred:
    return Pred((row, column), lambda i, j: j <= i)


def upper_triangle(row: str, column: str) -> Pred:
    return Pred((row, column), lambda i, j: j >= i)
