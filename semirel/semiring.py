"""Semirings as pairs of column expressions: how values combine under products and under sums."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest finite double, which stands for "no value yet" in the tropical semirings.
LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class Semiring:
    """``total`` aggregates with the sum, ``plus`` and ``times`` combine two columns; ``zero`` is what is absent, ``one`` the value of a bare tuple."""

    name: str
    dtype: str
    zero: object
    one: object
    total: Callable[[Column], Column]
    plus: Callable[[Column, Column], Column]
    times: Callable[[Column, Column], Column]

    def lit(self, value: object) -> Column:
        return F.lit(value).cast(self.dtype)

    @property
    def zero_col(self) -> Column:
        return self.lit(self.zero)

    @property
    def one_col(self) -> Column:
        return self.lit(self.one)


COUNTING = Semiring("counting", "bigint", 0, 1, F.sum, lambda a, b: a + b, lambda a, b: a * b)
#: Whole numbers of up to 38 digits, for products of sums that 64 bits may not hold.
WIDE = Semiring("wide", "decimal(38,0)", 0, 1, F.sum, lambda a, b: a + b, lambda a, b: a * b)
REAL = Semiring("real", "double", 0.0, 1.0, F.sum, lambda a, b: a + b, lambda a, b: a * b)
FLOAT = Semiring("float", "float", 0.0, 1.0, lambda c: F.sum(c).cast("float"), lambda a, b: a + b, lambda a, b: a * b)
BOOLEAN = Semiring("boolean", "boolean", False, True, F.bool_or, lambda a, b: a | b, lambda a, b: a & b)
MIN_PLUS = Semiring("min-plus", "double", LARGEST, 0.0, F.min, F.least, lambda a, b: a + b)
MAX_PLUS = Semiring("max-plus", "double", -LARGEST, 0.0, F.max, F.greatest, lambda a, b: a + b)
#: For text under concatenation order only: the empty string is absent, the larger string wins.
MAX_TEXT = Semiring("max-text", "string", "", "", F.max, F.greatest, lambda a, b: F.concat(a, b))

_REGISTRY: dict[str, Semiring] = {s.name: s for s in (COUNTING, WIDE, REAL, FLOAT, BOOLEAN, MIN_PLUS, MAX_PLUS, MAX_TEXT)}


def register(semiring: Semiring) -> Semiring:
    """Add an own semiring; its ``times`` must distribute over its ``plus`` for eager aggregation to hold."""
    _REGISTRY[semiring.name] = semiring
    return semiring


def semiring(name: str) -> Semiring:
    return _REGISTRY[name]
