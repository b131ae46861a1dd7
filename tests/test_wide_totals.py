"""Totals beyond 64 bits."""

import pytest

from semirel import queries as Q


@pytest.mark.parametrize(("quantity", "kind"), [(10**4, "bigint"), (10**10, "decimal(38,0)")])
def test_mttkrp_beyond_64_bits(spark, tmp_path, quantity, kind):
    line = "1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, CAST({} AS DOUBLE) AS l_quantity, CAST(1.0 AS DOUBLE) AS l_discount"
    spark.sql(f"SELECT {line.format(quantity)}").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Q.mttkrp(spark, str(tmp_path))
    assert got.schema["total"].dataType.simpleString() == kind
    assert int(got.first()[0]) == 100 * quantity**2
