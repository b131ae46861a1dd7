"""Sources, sinks, scalar functions, streaming and plans."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from semirel.functions import scalars as S
from semirel.operators import predicates as P
from semirel.relation import KRel
from semirel.semiring import COUNTING, REAL
from semirel.sources import generators, readers, sinks
from semirel.streaming.incremental import streaming_select, windowed_select


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", 2.5), (2, None, 3.5)], "k long, s string, x double")
    sinks.write_csv(df, str(tmp_path / "t"), delimiter="|")
    back = readers.csv(spark, str(tmp_path / "t"), "k long, s string, x double", delimiter="|")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "db") as db:
        db.execute("CREATE TABLE t (i INT, x REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, i / 2) for i in range(10)])
    df = readers.sqlite(spark, str(tmp_path / "db"), "t", "i long, x double", batch=3)
    assert sorted(map(tuple, df.collect())) == [(i, i / 2) for i in range(10)]


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 3 2\n1 2 1.5\n3 3 2\n")
    rows = readers.matrix_market(spark, str(tmp_path / "m.mtx")).df.collect()
    assert {(r["i"], r["j"]): r["v"] for r in rows}[(0, 1)] == 1.5
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 1\n2 1\n")
    assert {(r["i"], r["j"]) for r in readers.matrix_market(spark, str(tmp_path / "s.mtx")).df.collect()} >= {(0, 1), (1, 0)}


def test_matrix_market_entries_like_sizes(spark, tmp_path):
    """Entries that read like the line of sizes stay; the other half of a skew-symmetric matrix changes its sign; other kinds are refused."""
    def read(text):
        (tmp_path / "x.mtx").write_text(text)
        return {(r["i"], r["j"]): r["v"] for r in readers.matrix_market(spark, str(tmp_path / "x.mtx")).df.collect()}

    assert read("%%MatrixMarket matrix coordinate real general\n3 3 3\n1 1 1\n3 3 3\n2 1 4\n") == {(0, 0): 1.0, (2, 2): 3.0, (1, 0): 4.0}
    assert read("%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 5\n") == {(1, 0): 5.0, (0, 1): -5.0}
    for kind in ("array real general", "coordinate complex general", "coordinate real hermitian"):
        with pytest.raises(ValueError, match="not read"):
            read(f"%%MatrixMarket matrix {kind}\n1 1 1\n1 1 1\n")


def test_text_coo(spark):
    df = spark.createDataFrame([("1", "2.5x"), ("1", "junk"), ("7up", "1e1")], "i string, x string")
    assert {r["i"]: r["v"] for r in readers.text_coo(df, ("i",), "x").df.collect()} == {1: 2.5, 7: 10.0}


def test_generators(spark):
    a = generators.sparse_tensor(spark, ("i", "j"), (50, 60), 300)
    assert a.df.count() == a.df.select("i", "j").distinct().count() == 300
    assert a.df.where("i < 0 or i >= 50 or j < 0 or j >= 60 or v < 0 or v >= 1").isEmpty()
    assert sorted(map(tuple, a.df.collect())) == sorted(map(tuple, generators.sparse_tensor(spark, ("i", "j"), (50, 60), 300).df.collect()))


def test_sinks(spark, tmp_path):
    rel = KRel.of_rows(spark, [(1, 2, 5), (1, 3, 7)], "i long, j long, x long")
    assert sinks.as_map(rel, "i").first()["entries"] == {2: 5, 3: 7}
    sinks.write_sorted(rel, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.find_str("b", F.lit("abc"))) == 1 and value(S.find_str("z", F.lit("abc"))) == -1 and value(S.find_str("z", F.lit(None).cast("string"))) == -1
    assert value(S.atoi(F.lit("12abc"))) == 12 and value(S.atoi(F.lit("x"))) == 0 and value(S.atof(F.lit("-2.5e1z"))) == -25.0
    assert value(S.epoch_to_year(F.lit(757382400))) == 1994 and value(S.epoch_to_year(F.lit(757382399))) == 1993
    assert value(S.mid(F.lit(3), F.lit(6))) == 4 and value(S.divide(F.lit(1.0), F.lit(0.0))) is None
    assert value(S.access(F.array(F.lit(4), F.lit(5)), F.lit(1))) == 5 and value(S.lt_real(F.lit(1), F.lit(2))) == 1.0


def test_pushdown(spark, sf):
    rel = KRel.table(spark.read.parquet(f"{sf}/lineitem.parquet"), ("l_orderkey", "l_suppkey"), "l_quantity", REAL)
    plan = (rel * P.ge("l_suppkey", 5)).select("l_orderkey").df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_suppkey,5)" in plan and "l_shipdate" not in plan


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, x long").write.parquet(src)
    rel = KRel.table(spark.readStream.schema("k string, x long").parquet(src), ("k",), "x", COUNTING)
    job = streaming_select(rel, "k").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    try:
        job.processAllAvailable()
        assert {r["k"]: r["v"] for r in spark.table("sums").collect()} == {"a": 4, "b": 2}
    finally:
        job.stop()


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2020-01-01 00:00:10' AS t, 'a' AS k UNION ALL SELECT timestamp'2020-01-01 00:01:10', 'a'").write.parquet(src)
    rel = KRel.table(spark.readStream.schema("t timestamp, k string").parquet(src), ("t", "k"))
    job = windowed_select(rel, "t", "1 minute", "10 minutes", "k").writeStream.outputMode("update").format("memory").queryName("windows").start()
    try:
        job.processAllAvailable()
        assert [r["v"] for r in spark.table("windows").collect()] == [1, 1]
    finally:
        job.stop()
