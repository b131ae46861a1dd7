"""Triangles by a degree-balanced plan.

For each edge (a, b) of R the smaller of its two continuations is listed, S at b or T
at a, and the other relation is probed. The rows listed are the sum over R's edges of
the smaller degree, which stays within the bound of a worst-case optimal join, while
either binary plan lists the larger one at hub nodes. All of it is aggregates, equi-joins
and a union, so skewed keys are left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from semirel.relation import VALUE, KRel


def triangle_naive(r: KRel, s: KRel, t: KRel) -> KRel:
    """R(a,b) S(b,c) T(a,c) by binary joins."""
    return r * s * t


def triangle_balanced(r: KRel, s: KRel, t: KRel) -> KRel:
    """As ``triangle_naive``, listing the smaller side of every edge of R."""
    (a, b), c = r.keys, next(k for k in s.keys if k not in r.keys)
    from_b = s.df.groupBy(b).agg(F.count(F.lit(1)).alias("_s"))
    from_a = t.df.groupBy(a).agg(F.count(F.lit(1)).alias("_t"))
    weighed = r.df.join(from_b, b).join(from_a, a)
    by_s = r.with_df(weighed.where("_s <= _t").drop("_s", "_t"), value=r.value)
    by_t = r.with_df(weighed.where("_s > _t").drop("_s", "_t"), value=r.value)
    order = (a, b, c)
    one, two = by_s * s * t, by_t * t * s
    pick = lambda x: x.df.select(*order, *([VALUE] if x.value else []))
    return one.with_df(pick(one).unionByName(pick(two)), order, one.value)


def listed_rows(r: KRel, s: KRel, t: KRel, *, balanced: bool = True):
    """How many rows the first join of either plan lists."""
    (a, b) = r.keys
    from_b = s.df.groupBy(b).agg(F.count(F.lit(1)).alias("_s"))
    from_a = t.df.groupBy(a).agg(F.count(F.lit(1)).alias("_t"))
    weighed = r.df.join(from_b, b, "left").join(from_a, a, "left").na.fill(0, ["_s", "_t"])
    return weighed.agg(F.coalesce(F.sum(F.least("_s", "_t") if balanced else F.col("_s")), F.lit(0)).alias("listed"))
