"""Shapes: broadcasts over an index, materialised parts, dense fill and nested output."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirel.relation import VALUE, KRel
from semirel.semiring import COUNTING, Semiring


def expand(a: KRel, other: KRel) -> KRel:
    """``a`` over the indices of ``other`` that it lacks: one copy for each of those keys."""
    missing = [k for k in other.keys if k not in a.keys]
    return a * KRel(other.df.select(*missing).distinct(), tuple(missing), None, a.semiring) if missing else a


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for written intermediates; only a local master, whose tasks see the driver's folders, may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="semirel-checkpoint-"))
    return sc.getCheckpointDir()


def memo(a: KRel, checkpoint: bool = False) -> KRel:
    """The relation with unique keys, as one aggregate; with ``checkpoint`` also written, for use in several places."""
    out = a.dedup()
    if checkpoint:
        shared_folder(a.df.sparkSession)
    return out.with_df(out.df.checkpoint() if checkpoint else out.df, value=out.value)


def index_range(spark: SparkSession, name: str, low: int, high: int, semiring: Semiring = COUNTING) -> KRel:
    """All of ``low <= name < high``."""
    return KRel(spark.range(low, high).select(F.col("id").alias(name)), (name,), None, semiring)


def replicate(spark: SparkSession, name: str, n: int, value: object, semiring: Semiring = COUNTING) -> KRel:
    """The same value for each of ``n`` keys."""
    return index_range(spark, name, 0, n, semiring) * value


def empty(spark: SparkSession, keys: str, semiring: Semiring = COUNTING) -> KRel:
    """The zero relation; ``keys`` is a schema such as ``"i long, j long"``."""
    df = spark.createDataFrame([], keys)
    return KRel(df.withColumn(VALUE, semiring.zero_col), tuple(df.columns), VALUE, semiring)


def dense_fill(a: KRel, name: str, low: int, high: int) -> KRel:
    """One row for each key of a range, zero where ``a`` has none. ``a`` has that one key."""
    return dense_box(a, {name: (low, high)})


def dense_box(a: KRel, ranges: dict[str, tuple[int, int]]) -> KRel:
    """A dense matrix or tensor: one row for each point of the box ``{key: (low, high)}``, zero where ``a`` has none.

    Points are the digits of one range of numbers, dealt evenly over the tasks; ``a`` has exactly these keys.
    """
    sizes = {k: max(0, high - low) for k, (low, high) in ranges.items()}
    points, at = a.df.sparkSession.range(math.prod(sizes.values())), F.col("id")
    keys = {}
    for k in reversed(list(ranges)):
        n = max(1, sizes[k])
        keys[k], at = (F.pmod(at, F.lit(n)) + ranges[k][0]).cast("long").alias(k), F.floor(at / n)
    box = points.select(*(keys[k] for k in ranges))
    filled = box.join(a.dedup().df, list(ranges), "left")
    return a.with_df(filled.select(*ranges, F.coalesce(VALUE, a.semiring.zero_col).alias(VALUE)), tuple(ranges))


def nest(a: KRel, outer: tuple[str, ...]) -> DataFrame:
    """One row for each ``outer`` key with its inner tuples as a sorted array of structs."""
    inner = [k for k in a.keys if k not in outer]
    pair = F.struct(*inner, F.col(VALUE).alias("value"))
    return a.valued().df.groupBy(*outer).agg(F.array_sort(F.collect_list(pair)).alias("inner"))


def unnest(df: DataFrame, outer: tuple[str, ...], inner: tuple[str, ...], semiring: Semiring = COUNTING) -> KRel:
    """The inverse of ``nest``."""
    flat = df.select(*outer, F.explode("inner").alias("p")).select(*outer, *(F.col(f"p.{k}").alias(k) for k in inner), F.col("p.value").alias(VALUE))
    return KRel(flat, (*outer, *inner), VALUE, semiring)


def of_array(df: DataFrame, keys: tuple[str, ...], array: str, position: str, semiring: Semiring = COUNTING) -> KRel:
    """A dense array column as an index ``position`` and its values."""
    return KRel.table(df.select(*keys, F.posexplode(array).alias(position, "_x")), (*keys, position), "_x", semiring)


def of_map(df: DataFrame, keys: tuple[str, ...], entries: str, index: str, semiring: Semiring = COUNTING) -> KRel:
    """A map column as an index and its values."""
    return KRel.table(df.select(*keys, F.explode(entries).alias(index, "_x")), (*keys, index), "_x", semiring)
