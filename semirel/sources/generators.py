"""Seeded test tensors and graphs, made in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirel.relation import KRel
from semirel.semiring import BOOLEAN, REAL


def sparse_tensor(spark: SparkSession, keys: tuple[str, ...], sizes: tuple[int, ...], nonzeros: int, seed: int = 42) -> KRel:
    """About ``nonzeros`` values in [0, 1) at even strides of the tensor's cells, each moved within its stride: at most one for each cell."""
    cells = 1
    for n in sizes:
        cells *= n
    stride = max(1, cells // max(1, nonzeros))
    unit = lambda s: (F.pmod(F.xxhash64(F.col("id"), F.lit(s)), F.lit(1 << 30)) / float(1 << 30))
    at = F.col("id") * stride + F.floor(unit(seed) * stride)
    df, rest = spark.range(0, min(nonzeros, cells)).select(at.cast("long").alias("_at"), unit(seed + 1).alias("_x")).where(F.col("_at") < cells), F.col("_at")
    columns = []
    for name, n in zip(reversed(keys), reversed(sizes), strict=True):
        columns.append(F.pmod(rest, F.lit(n)).cast("long").alias(name))
        rest = F.floor(rest / n)
    return KRel.table(df.select(*reversed(columns), "_x"), keys, "_x", REAL)


def star(spark: SparkSession, n: int, a: str = "a", b: str = "b") -> KRel:
    """Edges (1, x) and (x, 1) for x = 1..n, 2n - 1 of them: the instance on which binary triangle plans go quadratic."""
    x = spark.range(1, n + 1).select(F.col("id").alias("x"))
    edges = x.select(F.lit(1).cast("long").alias(a), F.col("x").alias(b)).union(x.where("x > 1").select(F.col("x").alias(a), F.lit(1).cast("long").alias(b)))
    return KRel(edges, (a, b), None, BOOLEAN)


def numbered(spark: SparkSession, n: int, name: str = "i") -> DataFrame:
    """``n`` keys with their own number as value."""
    return spark.range(0, n).select(F.col("id").alias(name), F.col("id").alias("v"))
