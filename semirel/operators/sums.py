"""Sums: unions that add values, and sums on the support of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from semirel.errors import AlgebraError
from semirel.operators.products import _LEFT, _RIGHT, _known, _valued, joined
from semirel.relation import VALUE, Fun, KRel, Lookup
from semirel.semiring import BOOLEAN


def add(a: KRel, b: object) -> KRel:
    """Table plus table: one aggregation over the union. Plus anything else: on the table's support only."""
    if isinstance(b, KRel):
        return seq(a, b).dedup()
    return add_on_support(a, b)


def seq(a: KRel, b: KRel) -> KRel:
    """The tuples of both, as a bag, for one accumulation."""
    if set(a.keys) != set(b.keys):
        raise AlgebraError(f"sums need the same indices, not {a.keys} and {b.keys}")
    if not a.value and not b.value:
        return a.with_df(a.df.unionByName(b.df), value=None)
    return a.with_df(a.valued().df.unionByName(b.valued().df))


def add_on_support(a: KRel, b: object) -> KRel:
    """A function, lookup or scalar has no support of its own: it is added where ``a`` has a tuple."""
    ring = a.semiring
    if isinstance(b, Lookup):
        _known(a, b.keys)
        df, keys, _ = joined(a, b.table.valued(), "left")
        default = ring.lit(b.default) if b.default is not None else ring.zero_col
        left = F.col(_LEFT) if a.value else ring.one_col
        return KRel(df.select(*keys, ring.plus(left, F.coalesce(F.col(_RIGHT).cast(ring.dtype), default)).alias(VALUE)), keys, VALUE, ring)
    if isinstance(b, Fun):
        _known(a, b.keys)
        return _valued(a, ring.plus(a.column, b.at().cast(ring.dtype)))
    return _valued(a, ring.plus(a.column, ring.lit(b)))


def union(a: KRel, b: KRel) -> KRel:
    """Set union of keys."""
    return add(a.support(BOOLEAN), b.support(BOOLEAN))


def intersect(a: KRel, b: KRel) -> KRel:
    """Set intersection of keys."""
    order = a.keys
    return KRel(a.df.select(*order).intersect(b.df.select(*order)), order, None, BOOLEAN)


def guard(condition: object, a: KRel) -> KRel:
    """``a`` where the condition (a column over its keys, or a truth) holds, and nothing elsewhere."""
    return a.with_df(a.df.where(F.lit(condition) if isinstance(condition, bool) else condition), value=a.value)
