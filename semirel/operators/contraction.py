"""Contraction: sums over indices, which are grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semirel.errors import AlgebraError
from semirel.relation import VALUE, KRel
from semirel.semiring import BOOLEAN, COUNTING


def _total(a: KRel) -> Column:
    if a.value is None and a.semiring is COUNTING:
        return F.count(F.lit(1))
    return a.semiring.total(a.column)


def select(a: KRel, names: tuple[str, ...]) -> KRel:
    """Keep the named indices and sum over all others; with none the grand total."""
    if missing := [n for n in names if n not in a.keys]:
        raise AlgebraError(f"no index {missing} in {a.keys}")
    if not names:
        return total(a)
    base = a.source or a
    if base.value is None and base.semiring is BOOLEAN:
        return KRel(base.df.select(*names).distinct(), names, None, BOOLEAN, base)
    return KRel(base.df.groupBy(*names).agg(_total(base).alias(VALUE)), names, VALUE, base.semiring, base)


def contract(a: KRel, names: tuple[str, ...]) -> KRel:
    """Sum over the named indices."""
    if missing := [n for n in names if n not in a.keys]:
        raise AlgebraError(f"no index {missing} in {a.keys}")
    return select(a, tuple(k for k in a.keys if k not in names))


def total(a: KRel) -> KRel:
    """The sum over everything: one row, the semiring's zero where there is no tuple."""
    base = a.source or a
    return KRel(base.df.agg(F.coalesce(_total(base), base.semiring.zero_col).alias(VALUE)), (), VALUE, base.semiring, base)


def fold(a: KRel, names: tuple[str, ...], aggregates: dict[str, Column]) -> DataFrame:
    """Any aggregates over the groups of the named indices (``v`` is the value)."""
    df = a.valued().df
    columns = [c.alias(n) for n, c in aggregates.items()]
    return df.groupBy(*names).agg(*columns) if names else df.agg(*columns)


def having(a: KRel, group: tuple[str, ...], condition, *, zero_default: bool = False, of: KRel | None = None) -> KRel:
    """Tuples of ``of`` (or of ``a``) whose group's sum in ``a`` passes ``condition``.

    With ``zero_default`` a group that ``a`` lacks has the sum zero and may pass; else it does not.
    """
    sums, base = select(a, group), of or a
    if zero_default:
        marked = base.df.join(sums.df.withColumnRenamed(VALUE, "_sum"), list(group), "left")
        marked = marked.where(condition(F.coalesce("_sum", a.semiring.zero_col)))
        return base.with_df(marked.drop("_sum"), value=base.value)
    passing = sums.df.where(condition(F.col(VALUE))).select(*group)
    return base.with_df(base.df.join(passing, list(group), "left_semi"), value=base.value)
