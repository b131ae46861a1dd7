"""Products: natural joins, lookups, filters, semi- and anti-joins.

Join strategies are left to Catalyst and adaptive execution; nothing here hints a
broadcast, so a side is only broadcast where its known size is under the session's limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semirel.errors import AlgebraError
from semirel.relation import VALUE, Fun, KRel, Lookup, Pred
from semirel.semiring import BOOLEAN

_LEFT, _RIGHT = "_left_value", "_right_value"


def mul(a: KRel, b: object) -> KRel:
    """The product of a table with a table, function, lookup, predicate, truth or scalar."""
    if isinstance(b, KRel):
        return mul_tables(a, b)
    if isinstance(b, Lookup):
        return mul_lookup(a, b)
    if isinstance(b, Pred):
        _known(a, b.keys)
        return a.with_df(a.df.where(b.at()), value=a.value)
    if isinstance(b, Fun):
        _known(a, b.keys)
        return _valued(a, a.semiring.times(a.column, b.at().cast(a.semiring.dtype)))
    if isinstance(b, bool) and a.semiring is not BOOLEAN:
        return _valued(a, F.when(F.lit(b), a.column).otherwise(a.semiring.zero_col))
    if isinstance(b, Column):
        return _valued(a, a.semiring.times(a.column, b))
    return _valued(a, a.semiring.times(a.column, a.semiring.lit(b)))


def _known(a: KRel, keys: tuple[str, ...]) -> None:
    if missing := [k for k in keys if k not in a.keys]:
        raise AlgebraError(f"the table does not enumerate {missing}")


def _valued(a: KRel, value: Column) -> KRel:
    return a.with_df(a.df.select(*a.keys, value.alias(VALUE)))


def joined(a: KRel, b: KRel, how: str = "inner") -> tuple[DataFrame, tuple[str, ...], tuple[str, ...]]:
    """The natural join with both values kept apart; without a shared key the cross product."""
    on = tuple(k for k in a.keys if k in b.keys)
    keys = (*a.keys, *(k for k in b.keys if k not in a.keys))
    left = a.df.withColumnRenamed(a.value, _LEFT) if a.value else a.df
    right = b.df.withColumnRenamed(b.value, _RIGHT) if b.value else b.df
    return (left.join(right, list(on), how) if on else left.crossJoin(right)), keys, on


def mul_tables(a: KRel, b: KRel) -> KRel:
    """Inner join on the shared keys, values multiplied; a side of bare truths only filters the other's values."""
    if a.semiring.dtype != b.semiring.dtype and BOOLEAN not in (a.semiring, b.semiring):
        raise AlgebraError(f"values of {a.semiring.name} and {b.semiring.name} do not multiply; convert one with .to()")
    ring = b.semiring if a.semiring is BOOLEAN else a.semiring
    df, keys, _ = joined(a, b)
    sides = []
    for rel, name in ((a, _LEFT), (b, _RIGHT)):
        if rel.value:
            value = F.col(name)
            sides.append(F.when(value, ring.one_col).otherwise(ring.zero_col) if rel.semiring is BOOLEAN and ring is not BOOLEAN else value)
    if not sides:
        return KRel(df.select(*keys), keys, None, ring)
    value = sides[0] if len(sides) == 1 else ring.times(*sides)
    return KRel(df.select(*keys, value.alias(VALUE)), keys, VALUE, ring)


def mul_lookup(a: KRel, b: Lookup) -> KRel:
    """Left join: each tuple of ``a`` stays, times what the lookup holds or its default."""
    _known(a, b.keys)
    ring, right = a.semiring, b.table.valued()
    default = ring.lit(b.default) if b.default is not None else ring.zero_col
    df, keys, _ = joined(a, right, "left")
    left = F.col(_LEFT) if a.value else ring.one_col
    return KRel(df.select(*keys, ring.times(left, F.coalesce(F.col(_RIGHT).cast(ring.dtype), default)).alias(VALUE)), keys, VALUE, ring)


def zip_pair(a: KRel, b: KRel) -> KRel:
    """Inner join that keeps both values, as a pair."""
    df, keys, _ = joined(a.valued(), b.valued())
    return KRel(df.select(*keys, F.struct(F.col(_LEFT).alias("left"), F.col(_RIGHT).alias("right")).alias(VALUE)), keys, VALUE, a.semiring)


def semi(a: KRel, b: KRel) -> KRel:
    """Tuples of ``a`` whose shared keys occur in ``b``, however often."""
    return _exists(a, b, "left_semi")


def anti(a: KRel, b: KRel) -> KRel:
    """Tuples of ``a`` whose shared keys do not occur in ``b``."""
    return _exists(a, b, "left_anti")


def _exists(a: KRel, b: KRel, how: str) -> KRel:
    on = [k for k in a.keys if k in b.keys]
    if not on:
        raise AlgebraError("no shared key")
    return a.with_df(a.df.join(b.df.select(*on), on, how), value=a.value)


def theta(a: KRel, b: KRel, condition: Callable[..., Column], on: tuple[str, ...]) -> KRel:
    """Join on the shared keys, if any, and on a comparison of the keys ``on``."""
    df, keys, _ = joined(a, b)
    both = KRel(df.where(condition(*(F.col(k) for k in on))), keys, None, a.semiring)
    sides = [F.col(n) for rel, n in ((a, _LEFT), (b, _RIGHT)) if rel.value]
    if not sides:
        return both.with_df(both.df.select(*keys), value=None)
    return both.with_df(both.df.select(*keys, (sides[0] if len(sides) == 1 else a.semiring.times(*sides)).alias(VALUE)))


def product(*factors: object) -> object:
    """The product of all factors, left to right: the order in which tables are joined."""
    out, *rest = factors
    for f in rest:
        out = out * f
    return out
