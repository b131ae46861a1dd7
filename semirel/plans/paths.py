"""Path queries: repeated products of an edge relation in any semiring."""

from __future__ import annotations

from pyspark.sql import functions as F

from semirel.relation import KRel


def two_hop(edges: KRel) -> KRel:
    """All paths of two edges, summed over the node between: reachability, counts, cheapest or dearest by the semiring."""
    i, j = edges.keys
    return (edges.rename(**{j: "_via"}) * edges.rename(**{i: "_via"})).contract("_via")


def closure(edges: KRel, rounds: int) -> KRel:
    """Sums over all paths of up to 2**rounds edges, by repeated squaring; for idempotent sums. Each round is saved."""
    out = edges.dedup()
    for _ in range(rounds):
        out = (out + two_hop(out)).memo(checkpoint=True)
    return out


def degrees(edges: KRel, key: str) -> KRel:
    return edges.support().select(key) if edges.value is None else KRel(edges.df.groupBy(key).agg(F.count(F.lit(1)).alias("v")), (key,), "v", edges.semiring)
