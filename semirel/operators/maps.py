"""Maps over values and keys, renames and derived keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from semirel.errors import AlgebraError
from semirel.relation import VALUE, KRel
from semirel.semiring import Semiring


def map_value(a: KRel, f: Callable[..., Column], with_keys: bool = False, semiring: Semiring | None = None) -> KRel:
    """Values through a column function, which also gets the key columns first where ``with_keys``."""
    ring = semiring or a.semiring
    value = f(*(F.col(k) for k in a.keys), a.column) if with_keys else f(a.column)
    return KRel(a.df.select(*a.keys, value.cast(ring.dtype).alias(VALUE)), a.keys, VALUE, ring)


def rename(a: KRel, names: dict[str, str]) -> KRel:
    new = tuple(names.get(k, k) for k in a.keys)
    if len(set(new)) != len(new) or a.value in new:
        raise AlgebraError(f"an index occurs twice in {new}")
    out = a.with_df(a.df.select(*(F.col(k).alias(n) for k, n in zip(a.keys, new, strict=True)), *([a.value] if a.value else [])), new, a.value)
    if a.source is None or any(n in a.source.keys and n not in a.keys for n in new):
        return out
    return replace(out, source=rename(a.source, names))


def derive(a: KRel, name: str, f: Callable[..., Column], of: tuple[str, ...]) -> KRel:
    """A further key, computed from the keys ``of``."""
    if name in a.keys:
        raise AlgebraError(f"there is an index {name} already")
    return a.with_df(a.df.select(*a.keys, f(*(F.col(k) for k in of)).alias(name), *([a.value] if a.value else [])), (*a.keys, name), a.value)


def map_key(a: KRel, name: str, f: Callable[[Column], Column], collapse: bool = True) -> KRel:
    """A key through a function; keys that meet add up, or stay a bag without ``collapse``."""
    out = a.with_df(a.df.withColumn(name, f(F.col(name))), value=a.value)
    return out.dedup() if collapse else out


def lift(a: KRel, name: str) -> KRel:
    """The value as a further index, with value one: what filters on aggregates need."""
    return KRel(a.valued().df.select(*a.keys, F.col(a.value or VALUE).alias(name)), (*a.keys, name), None, a.semiring)


def split(a: KRel, outer: tuple[str, ...]) -> KRel:
    """The relation as one nested value for each ``outer`` key: pairs of the inner keys and the value."""
    from semirel.operators.shape import nest

    return KRel(nest(a, outer).withColumnRenamed("inner", VALUE), outer, VALUE, a.semiring)
