"""Results as scalars, maps, sorted tables, CSV and nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirel.errors import AlgebraError
from semirel.relation import VALUE, KRel


def scalar(rel: KRel) -> object:
    """The value of a grand total."""
    row = rel.total().df.first()
    return row[0]


def as_map(rel: KRel, *outer: str) -> DataFrame:
    """One map column from the remaining key to the value for each ``outer`` key; maps are bounded by the key's groups."""
    inner = [k for k in rel.keys if k not in outer]
    if len(inner) != 1:
        raise AlgebraError("a map has one key; nest the others")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner[0], VALUE))))
    rows = rel.dedup().df
    return rows.groupBy(*outer).agg(pairs.alias("entries")) if outer else rows.agg(pairs.alias("entries"))


def write_csv(df: DataFrame, path: str, *, header: bool = True, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", delimiter).csv(path)


def write_sorted(rel: KRel, path: str, partitions: int | None = None) -> None:
    """Parquet in the order of the keys, so that later scans skip row groups by their bounds."""
    rows = rel.dedup().df
    ranged = rows.repartitionByRange(partitions, *rel.keys) if partitions else rows.repartitionByRange(*rel.keys)
    ranged.sortWithinPartitions(*rel.keys).write.mode("overwrite").parquet(path)
