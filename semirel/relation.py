"""Relations over a semiring: tables, functions, lookups and predicates.

A *table* is a DataFrame of key columns and at most one value column; without one
every row stands for the semiring's one. Duplicate keys are a bag: their values add
up wherever they are summed. A *function* gives a value for any key and a *predicate*
a truth, neither of which can be listed by itself; a *lookup* is a keyed table read as
a function that is zero elsewhere. Key names are the indices: a product joins on the
names that both sides have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semirel.errors import AlgebraError
from semirel.semiring import BOOLEAN, COUNTING, Semiring

VALUE = "v"


@dataclass(frozen=True)
class Fun:
    """A value for every key: ``build`` takes the key columns in the order of ``keys``."""

    keys: tuple[str, ...]
    build: Callable[..., Column]
    semiring: Semiring = COUNTING

    def at(self, names: Callable[[str], Column] = F.col) -> Column:
        return self.build(*(names(k) for k in self.keys))

    def _with(self, other: Fun, combine: Callable[[Column, Column], Column]) -> Fun:
        keys = (*self.keys, *(k for k in other.keys if k not in self.keys))

        def build(*columns: Column) -> Column:
            named = dict(zip(keys, columns, strict=True))
            return combine(self.at(named.__getitem__), other.at(named.__getitem__))

        return Fun(keys, build, self.semiring)

    def __mul__(self, other: object) -> object:
        if isinstance(other, Fun):
            return self._with(other, self.semiring.times)
        if isinstance(other, KRel):
            return other * self
        return NotImplemented

    def __add__(self, other: Fun) -> Fun:
        return self._with(other, self.semiring.plus)

    def contract(self, *_: str) -> None:
        raise AlgebraError("a function has no finite support; multiply it by a table before summing it out")

    total = select = contract


@dataclass(frozen=True)
class Pred:
    """A truth for every key; legal within a product with a table."""

    keys: tuple[str, ...]
    build: Callable[..., Column]

    def at(self, names: Callable[[str], Column] = F.col) -> Column:
        return self.build(*(names(k) for k in self.keys))

    def _with(self, other: Pred, combine: Callable[[Column, Column], Column]) -> Pred:
        f = Fun(self.keys, self.build, BOOLEAN)._with(Fun(other.keys, other.build, BOOLEAN), combine)
        return Pred(f.keys, f.build)

    def __and__(self, other: Pred) -> Pred:
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other: Pred) -> Pred:
        return self._with(other, lambda a, b: a | b)

    def __invert__(self) -> Pred:
        return Pred(self.keys, lambda *c: ~self.build(*c))

    def __mul__(self, other: object) -> object:
        if isinstance(other, Pred):
            return self & other
        if isinstance(other, KRel):
            return other * self
        return NotImplemented

    def contract(self, *_: str) -> None:
        raise AlgebraError("a predicate is not enumerable by itself; multiply it by a table before summing it out")

    total = select = contract


@dataclass(frozen=True)
class Lookup:
    """A keyed table read as a function: ``default`` (the semiring's zero) where the key is absent."""

    table: KRel
    default: object = None

    @property
    def keys(self) -> tuple[str, ...]:
        return self.table.keys

    def contract(self, *_: str) -> None:
        raise AlgebraError("a lookup is a function; sum its table instead")

    total = select = contract


@dataclass(frozen=True)
class KRel:
    """A table relation; see the module. The operators live in ``semirel.operators``, these methods call them.

    ``source`` is the bag that this relation is a sum of, if it is one: summing further indices
    out starts from there again, as sums are associative, and so takes one shuffle and not two.
    """

    df: DataFrame
    keys: tuple[str, ...]
    value: str | None = None
    semiring: Semiring = COUNTING
    source: KRel | None = None

    # --- construction ---
    @staticmethod
    def table(df: DataFrame, keys: Iterable[str], value: str | Column | None = None, semiring: Semiring = COUNTING) -> KRel:
        keys = tuple(keys)
        if len(set(keys)) != len(keys):
            raise AlgebraError(f"an index occurs twice in {keys}")
        if value is None:
            return KRel(df.select(*keys), keys, None, semiring)
        column = F.col(value) if isinstance(value, str) else value
        return KRel(df.select(*keys, column.cast(semiring.dtype).alias(VALUE)), keys, VALUE, semiring)

    @staticmethod
    def of_rows(spark, rows: list[tuple], schema: str, semiring: Semiring = COUNTING, *, valued: bool = True) -> KRel:
        """A literal relation; the last column is the value unless ``valued`` is false. Equal keys add up."""
        df = spark.createDataFrame(rows, schema)
        names = df.columns
        rel = KRel.table(df, names[:-1] if valued else names, names[-1] if valued else None, semiring)
        return rel.dedup()

    @property
    def column(self) -> Column:
        return F.col(self.value) if self.value else self.semiring.one_col

    def valued(self) -> KRel:
        """With an explicit value column."""
        return self if self.value else KRel(self.df.withColumn(VALUE, self.semiring.one_col), self.keys, VALUE, self.semiring)

    def with_df(self, df: DataFrame, keys: Iterable[str] | None = None, value: str | None = VALUE) -> KRel:
        return replace(self, df=df, keys=self.keys if keys is None else tuple(keys), value=value, source=None)

    # --- products ---
    def __mul__(self, other: object) -> KRel:
        from semirel.operators.products import mul

        return mul(self, other)

    __rmul__ = __mul__

    def __and__(self, other: KRel) -> KRel:
        return self * other

    def zip(self, other: KRel) -> KRel:
        from semirel.operators.products import zip_pair

        return zip_pair(self, other)

    def semi(self, other: KRel) -> KRel:
        from semirel.operators.products import semi

        return semi(self, other)

    def anti(self, other: KRel) -> KRel:
        from semirel.operators.products import anti

        return anti(self, other)

    def theta(self, other: KRel, condition: Callable[..., Column], on: tuple[str, ...]) -> KRel:
        from semirel.operators.products import theta

        return theta(self, other, condition, on)

    # --- sums ---
    def __add__(self, other: object) -> KRel:
        from semirel.operators.sums import add

        return add(self, other)

    __radd__ = __add__

    def __or__(self, other: KRel) -> KRel:
        return self + other

    def seq(self, other: KRel) -> KRel:
        from semirel.operators.sums import seq

        return seq(self, other)

    # --- contraction ---
    def contract(self, *names: str) -> KRel:
        from semirel.operators.contraction import contract

        return contract(self, names)

    def select(self, *names: str) -> KRel:
        from semirel.operators.contraction import select

        return select(self, names)

    def total(self) -> KRel:
        from semirel.operators.contraction import total

        return total(self)

    def dedup(self) -> KRel:
        """Unique keys; equal ones add up."""
        if self.source is not None:
            return self
        return self.select(*self.keys) if self.keys else self.total()

    def canonical(self) -> KRel:
        """Unique keys, without explicit zeros."""
        rel = self.dedup()
        return rel.with_df(rel.df.where(rel.column != rel.semiring.zero_col))

    def fold(self, names: Iterable[str], **aggregates: Column) -> DataFrame:
        from semirel.operators.contraction import fold

        return fold(self, tuple(names), aggregates)

    # --- maps ---
    def map(self, f: Callable[..., Column], *, with_keys: bool = False, semiring: Semiring | None = None) -> KRel:
        from semirel.operators.maps import map_value

        return map_value(self, f, with_keys, semiring)

    def filter_value(self, f: Callable[[Column], Column]) -> KRel:
        return self.with_df(self.df.where(f(self.column)), value=self.value)

    def rename(self, **names: str) -> KRel:
        from semirel.operators.maps import rename

        return rename(self, names)

    def label(self, *names: str) -> KRel:
        return self.rename(**dict(zip(self.keys, names, strict=True)))

    def derive(self, name: str, f: Callable[..., Column], *of: str) -> KRel:
        from semirel.operators.maps import derive

        return derive(self, name, f, of)

    def map_key(self, name: str, f: Callable[[Column], Column], *, collapse: bool = True) -> KRel:
        from semirel.operators.maps import map_key

        return map_key(self, name, f, collapse)

    def lift(self, name: str) -> KRel:
        from semirel.operators.maps import lift

        return lift(self, name)

    def to(self, semiring: Semiring) -> KRel:
        return self.map(lambda v: v.cast(semiring.dtype), semiring=semiring)

    def support(self, semiring: Semiring | None = None) -> KRel:
        """One on every key that is present."""
        return KRel(self.df.select(*self.keys), self.keys, None, semiring or self.semiring)

    # --- shape ---
    def memo(self, *, checkpoint: bool = False) -> KRel:
        from semirel.operators.shape import memo

        return memo(self, checkpoint)

    def expand(self, other: KRel) -> KRel:
        from semirel.operators.shape import expand

        return expand(self, other)

    def nest(self, *outer: str) -> DataFrame:
        from semirel.operators.shape import nest

        return nest(self, outer)

    def lookup(self, default: object = None) -> Lookup:
        return Lookup(self, default)
