"""Tables and tensors from Parquet, CSV, databases, MatrixMarket and arrays.

Every reader selects its columns at once, so that a columnar source reads no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semirel.functions.scalars import atof, atoi
from semirel.relation import KRel
from semirel.semiring import COUNTING, REAL, Semiring


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str | T.StructType, *, header: bool = True, delimiter: str = ",") -> DataFrame:
    """Delimited text with a declared schema; nothing is inferred, so the text is read once."""
    return spark.read.option("header", header).option("sep", delimiter).schema(schema).csv(path)


def jdbc(spark: SparkSession, url: str, table: str, *columns: str, driver: str | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database table, where the session has the driver. ``partition``: column, low, high and number of parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if driver:
        reader = reader.option("driver", driver)
    if partition:
        for name, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(name, value)
    df = reader.load()
    return df.select(*columns) if columns else df


def sqlite(spark: SparkSession, path: str, table: str, schema: str, *, batch: int = 50_000) -> DataFrame:
    """A table of an SQLite file that the executors can reach, read in one task a batch at a time, without any driver."""

    def rows(batches):
        import sqlite3

        import pyarrow as pa

        names = [f.name for f in kind.fields]
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for _ in batches:
                cursor = db.execute(f"SELECT {', '.join(names)} FROM {table}")  # noqa: S608
                while got := cursor.fetchmany(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = T._parse_datatype_string(schema)
    types = [to_arrow_type(f.dataType) for f in kind.fields]
    return spark.range(0, 1, 1, 1).mapInArrow(rows, kind)


def coo(df: DataFrame, keys: tuple[str, ...], value: str | None = None, semiring: Semiring = COUNTING, *, dedup: bool = True) -> KRel:
    """A tensor as coordinates; equal coordinates add up unless ``dedup`` is false, which keeps a bag."""
    rel = KRel.table(df, keys, value, semiring)
    return rel.dedup() if dedup else rel


def text_coo(df: DataFrame, keys: tuple[str, ...], value: str, semiring: Semiring = REAL) -> KRel:
    """Coordinates and values that come as text; junk reads as zero."""
    typed = df.select(*(atoi(F.col(k)).alias(k) for k in keys), atof(F.col(value)).alias("_x"))
    return coo(typed, keys, "_x", semiring)


def matrix_market(spark: SparkSession, path: str, row: str = "i", column: str = "j", semiring: Semiring = REAL) -> KRel:
    """A ``coordinate`` MatrixMarket file as a zero-based matrix: ``general``, or ``symmetric``, whose other half is implied,
    or ``skew-symmetric``, whose other half is implied with the sign changed; with numbers or a ``pattern`` (all one).

    The line of sizes is told by its place, the first line that is no comment; an entry that reads like it is an entry.
    Other kinds (``array``, ``complex``, ``hermitian``) raise an error. The file may be large, as only its first lines pass the driver.
    """
    return matrix_market_lines(spark.read.text(path), row, column, semiring)


def matrix_market_lines(text: DataFrame, row: str = "i", column: str = "j", semiring: Semiring = REAL) -> KRel:
    """As ``matrix_market``, for lines (``value``) whose partitions are in the file's order."""
    lines = text.select("value", F.monotonically_increasing_id().alias("_line"))
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).select("value").first()
    kind = (head[0] if head else "%%MatrixMarket matrix coordinate real general").lower().split()[1:]
    if len(kind) != 4 or kind[:2] != ["matrix", "coordinate"] or kind[2] not in ("real", "integer", "double", "pattern") or kind[3] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"this kind of MatrixMarket file is not read: {' '.join(kind)}")
    body = lines.where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))
    first = body.agg(F.min("_line")).first()[0]
    p = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if kind[2] == "pattern" else F.get(p, 2).cast("double")
    flat = body.where(F.col("_line") > F.lit(first)).select((p[0].cast("long") - 1).alias(row), (p[1].cast("long") - 1).alias(column), value.alias("_x"))
    if kind[3] != "general":
        other = -F.col("_x") if kind[3] == "skew-symmetric" else F.col("_x")
        flat = flat.unionByName(flat.where(F.col(row) != F.col(column)).select(F.col(column).alias(row), F.col(row).alias(column), other.alias("_x")))
    return coo(flat, (row, column), "_x", semiring)
