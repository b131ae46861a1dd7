"""The registered queries over the driver's tables, each beside the SQL that it must equal.

Tensors have whole-number values (quantities, cents, hundredths), so that sums are exact
in any order; sums of prices are rounded far above their last digit for the same reason.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirel.functions import scalars as S
from semirel.operators import predicates as P
from semirel.operators import shape, sums
from semirel.operators.contraction import having
from semirel.operators.products import product
from semirel.plans import eager, paths
from semirel.plans.skew import salted_contraction
from semirel.plans.triangle import triangle_balanced, triangle_naive
from semirel.relation import VALUE, Fun, KRel
from semirel.semiring import BOOLEAN, COUNTING, MAX_PLUS, MIN_PLUS, REAL, WIDE, Semiring
from semirel.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def same_as(other: str) -> str:
    return ORACLE_SQL[other]


# --- inputs --------------------------------------------------------------------


def _read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return readers.parquet(spark, f"{sf}/{name}.parquet", *columns)


def _lineitem(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return _read(spark, sf, "lineitem", *columns)


def matrix_a(spark: SparkSession, sf: str, i: str = "i", j: str = "j") -> KRel:
    """Part by supplier: quantity."""
    df = _lineitem(spark, sf, "l_partkey", "l_suppkey", "l_quantity")
    return readers.coo(df.select(F.col("l_partkey").alias(i), F.col("l_suppkey").alias(j), "l_quantity"), (i, j), "l_quantity")


def matrix_b(spark: SparkSession, sf: str, i: str = "j", j: str = "k") -> KRel:
    """Supplier by line number: discount in hundredths."""
    df = _lineitem(spark, sf, "l_suppkey", "l_linenumber", "l_discount")
    return readers.coo(df.select(F.col("l_suppkey").alias(i), F.col("l_linenumber").alias(j), F.round(F.col("l_discount") * 100).alias("x")), (i, j), "x")


def tensor_c(spark: SparkSession, sf: str, i: str = "i", j: str = "j", k: str = "k") -> KRel:
    """Part group by supplier by line number: quantity."""
    df = _lineitem(spark, sf, "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return readers.coo(df.select((F.col("l_partkey") % 50).alias(i), F.col("l_suppkey").alias(j), F.col("l_linenumber").alias(k), "l_quantity"), (i, j, k), "l_quantity")


def vector_v(spark: SparkSession, sf: str, i: str = "j") -> KRel:
    """Supplier: balance in cents."""
    df = _read(spark, sf, "supplier", "s_suppkey", "s_acctbal")
    return readers.coo(df.select(F.col("s_suppkey").alias(i), F.round(F.col("s_acctbal") * 100).alias("x")), (i,), "x")


A_SQL = "a AS (SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
B_SQL = "b AS (SELECT l_suppkey AS j, l_linenumber AS k, CAST(sum(round(l_discount * 100)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
C_SQL = "c AS (SELECT l_partkey % 50 AS i, l_suppkey AS j, l_linenumber AS k, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"
V_SQL = "v AS (SELECT s_suppkey AS j, CAST(round(s_acctbal * 100) AS BIGINT) AS v FROM supplier)"


def edges(spark: SparkSession, sf: str, x: str, y: str, left: str, right: str) -> KRel:
    """Distinct pairs of two expressions over events."""
    df = _read(spark, sf, "events", "user_id", "event_id")
    return KRel.table(df.select(F.expr(left).alias(x), F.expr(right).alias(y)).distinct(), (x, y), None, BOOLEAN)


def triangle_inputs(spark: SparkSession, sf: str) -> tuple[KRel, KRel, KRel]:
    return (
        edges(spark, sf, "a", "b", "user_id % 40", "event_id % 40"),
        edges(spark, sf, "b", "c", "event_id % 40", "user_id % 37"),
        edges(spark, sf, "a", "c", "user_id % 40", "user_id % 37"),
    )


RST_SQL = """r AS (SELECT DISTINCT user_id % 40 AS a, event_id % 40 AS b FROM events),
s AS (SELECT DISTINCT event_id % 40 AS b, user_id % 37 AS c FROM events),
t AS (SELECT DISTINCT user_id % 40 AS a, user_id % 37 AS c FROM events)"""


def _out(rel: KRel, **names: str) -> DataFrame:
    """The keys, renamed where asked, and the value as ``total``."""
    value = names.pop("value", "total")
    return rel.valued().df.select(*(F.col(k).alias(names.get(k, k)) for k in rel.keys), F.col(VALUE).alias(value))


def _whole_out(total: KRel) -> DataFrame:
    """A grand total of wide numbers: BIGINT as in the SQL, and all its digits as a decimal where that type does not hold it."""
    saved = total.memo(checkpoint=True)
    fits = not saved.df.where(F.col(VALUE).between(F.lit(-(2**63)), F.lit(2**63 - 1))).isEmpty()
    return _out(saved.to(COUNTING) if fits else saved)


# --- star-schema queries ---------------------------------------------------------


def q5(spark: SparkSession, sf: str, region: str = "ASIA", start: str = "1996-01-01", end: str = "1997-01-01") -> KRel:
    lineitem = KRel.table(_lineitem(spark, sf, "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), ("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), None, REAL)
    orders = KRel.table(_read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate"), ("o_orderkey", "o_custkey", "o_orderdate"), None, REAL).label("l_orderkey", "custkey", "o_orderdate")
    customer = KRel.table(_read(spark, sf, "customer", "c_custkey", "c_nationkey"), ("c_custkey", "c_nationkey"), None, REAL).label("custkey", "nationkey")
    supplier = KRel.table(_read(spark, sf, "supplier", "s_suppkey", "s_nationkey"), ("s_suppkey", "s_nationkey"), None, REAL).label("l_suppkey", "nationkey")
    nation = KRel.table(_read(spark, sf, "nation"), ("n_nationkey", "n_regionkey", "n_name"), None, REAL).label("nationkey", "regionkey", "n_name")
    regions = KRel.table(_read(spark, sf, "region"), ("r_regionkey", "r_name"), None, REAL).label("regionkey", "r_name")
    revenue = Fun(("l_extendedprice", "l_discount"), lambda p, d: p * (1 - d), REAL)
    dated = orders * P.where(lambda d: (d >= F.lit(start).cast("timestamp_ntz")) & (d < F.lit(end).cast("timestamp_ntz")), "o_orderdate")
    places = nation * (regions * P.between_incl("r_name", region, region))
    return product(lineitem * revenue, dated, customer, supplier, places).select("n_name")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
def tpch_q5(spark: SparkSession, sf: str) -> DataFrame:
    return q5(spark, sf).df.select("n_name", F.round(VALUE, 0).alias("revenue"))


@query("""WITH partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY 1, 2)
SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year,
  round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 0) AS sum_profit
FROM part, supplier, lineitem, partsupp, orders, nation
WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey
  AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%blue%' GROUP BY 1, 2""")
def tpch_q9(spark: SparkSession, sf: str) -> DataFrame:
    line = KRel.table(_lineitem(spark, sf, "l_partkey", "l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount"), ("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount"), None, REAL)
    part = KRel.table(_read(spark, sf, "part", "p_partkey", "p_name"), ("p_partkey", "p_name"), None, REAL).label("l_partkey", "p_name") * P.contains("p_name", "blue")
    cost = KRel.table(_lineitem(spark, sf, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), ("l_partkey", "l_suppkey"), F.col("l_extendedprice") / F.col("l_quantity"), MIN_PLUS).dedup().lift("cost")
    supplier = KRel.table(_read(spark, sf, "supplier", "s_suppkey", "s_nationkey"), ("s_suppkey", "s_nationkey"), None, REAL).label("l_suppkey", "nationkey")
    orders = KRel.table(_read(spark, sf, "orders", "o_orderkey", "o_orderdate"), ("o_orderkey", "o_orderdate"), None, REAL).label("l_orderkey", "o_orderdate").derive("o_year", S.date_to_year, "o_orderdate")
    nation = KRel.table(_read(spark, sf, "nation", "n_nationkey", "n_name"), ("n_nationkey", "n_name"), None, REAL).label("nationkey", "nation")
    profit = Fun(("l_extendedprice", "l_discount", "cost", "l_quantity"), lambda p, d, c, q: p * (1 - d) - c * q, REAL)
    wanted = product(line, part, cost.support(REAL), orders, supplier, nation) * profit
    return wanted.select("nation", "o_year").df.select("nation", "o_year", F.round(VALUE, 0).alias("sum_profit"))


# --- cyclic joins -----------------------------------------------------------------


@query(f"WITH {RST_SQL} SELECT count(*) AS triangles FROM r, s, t WHERE r.b = s.b AND s.c = t.c AND r.a = t.a")
def triangle_count(spark: SparkSession, sf: str) -> DataFrame:
    return _out(triangle_naive(*triangle_inputs(spark, sf)).support(COUNTING).total(), value="triangles")


@query(same_as("triangle_count"))
def triangle_balanced_count(spark: SparkSession, sf: str) -> DataFrame:
    return _out(triangle_balanced(*triangle_inputs(spark, sf)).support(COUNTING).total(), value="triangles")


@query(f"WITH {RST_SQL} SELECT r.a, r.b, s.c FROM r, s, t WHERE r.b = s.b AND s.c = t.c AND r.a = t.a")
def triangle_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    return triangle_balanced(*triangle_inputs(spark, sf)).df.select("a", "b", "c")


@query("SELECT CAST(3 * n - 2 AS BIGINT) AS triangles FROM (SELECT 1000 AS n)")
def triangle_star(spark: SparkSession, sf: str) -> DataFrame:
    from semirel.sources.generators import star

    return _out(triangle_balanced(star(spark, 1000), star(spark, 1000, "b", "c"), star(spark, 1000, "a", "c")).support(COUNTING).total(), value="triangles")


# --- sparse linear and tensor algebra ------------------------------------------------


@query(f"WITH {A_SQL}, {V_SQL} SELECT CAST(coalesce(sum(a.v * v.v), 0) AS BIGINT) AS total FROM a JOIN v USING (j)")
def spmv(spark: SparkSession, sf: str) -> DataFrame:
    return _out(eager.sum_product([matrix_a(spark, sf), vector_v(spark, sf)]))


@query(f"WITH {A_SQL}, {V_SQL} SELECT i, CAST(sum(a.v * v.v) AS BIGINT) AS total FROM a JOIN v USING (j) GROUP BY i")
def matvec(spark: SparkSession, sf: str) -> DataFrame:
    return _out((matrix_a(spark, sf) * vector_v(spark, sf)).select("i"))


def _filtered(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    line = readers.coo(_lineitem(spark, sf, "l_orderkey", "l_suppkey", "l_quantity"), ("l_orderkey", "l_suppkey"), "l_quantity", dedup=False)
    price = KRel.table(_read(spark, sf, "orders", "o_orderkey", "o_totalprice"), ("o_orderkey",), F.round(F.col("o_totalprice") * 100)).label("l_orderkey")
    over = price.filter_value(lambda v: v > 20_000_000 if strict else v >= 20_000_000)
    return _out((line * over).total())


FILTERED_SQL = """SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT) * p), 0) AS BIGINT) AS total
FROM lineitem JOIN (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders) ON o_orderkey = l_orderkey WHERE p {} 20000000"""


@query(FILTERED_SQL.format(">"))
def filtered_spmv(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, True)


@query(FILTERED_SQL.format(">="))
def filtered_spmv_at_least(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, False)


@query(f"WITH {A_SQL}, {B_SQL} SELECT CAST(coalesce(sum(a.v * b.v), 0) AS BIGINT) AS total FROM a JOIN b USING (j)")
def matmul_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _out(eager.sum_product([matrix_a(spark, sf), matrix_b(spark, sf)]))


@query(same_as("matmul_sum"))
def matmul_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _out((matrix_a(spark, sf) * matrix_b(spark, sf)).contract("j").contract("k").total())


@query(f"WITH {A_SQL}, {B_SQL} SELECT i, k, CAST(sum(a.v * b.v) AS BIGINT) AS total FROM a JOIN b USING (j) GROUP BY i, k")
def matmul(spark: SparkSession, sf: str) -> DataFrame:
    return _out(eager.matmul(matrix_a(spark, sf), matrix_b(spark, sf)))


@query(f"WITH {B_SQL} SELECT x.j AS i, y.j AS j, CAST(sum(x.v * y.v) AS BIGINT) AS total FROM b x JOIN b y USING (k) GROUP BY x.j, y.j")
def matmul_abt(spark: SparkSession, sf: str) -> DataFrame:
    return _out(eager.matmul(matrix_b(spark, sf, "i", "k"), matrix_b(spark, sf, "j", "k")))


@query(f"WITH {B_SQL} SELECT CAST(coalesce(sum(x.v * y.v), 0) AS BIGINT) AS total FROM b x JOIN b y USING (k)")
def matmul_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _out(eager.sum_product([matrix_b(spark, sf, "i", "k"), matrix_b(spark, sf, "j", "k")]))


@query(f"""WITH {C_SQL}, {B_SQL}, d AS (SELECT l_linenumber AS k, l_suppkey % 7 AS l, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
e AS (SELECT j, k % 7 AS l, v FROM b)
SELECT CAST(coalesce(sum(CAST(c.v AS HUGEINT) * d.v * e.v), 0) AS BIGINT) AS total FROM c JOIN e USING (j) JOIN d ON c.k = d.k AND d.l = e.l""")
def mttkrp(spark: SparkSession, sf: str) -> DataFrame:
    d = readers.coo(_lineitem(spark, sf, "l_linenumber", "l_suppkey", "l_quantity").select(F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % 7).alias("l"), "l_quantity"), ("k", "l"), "l_quantity")
    e = matrix_b(spark, sf, "j", "l").map_key("l", lambda l: l % 7)
    return _whole_out(eager.sum_product([tensor_c(spark, sf).contract("i").to(WIDE), e.to(WIDE), d.to(WIDE)]))


@query(f"WITH {C_SQL}, {B_SQL} SELECT CAST(coalesce(sum(c.v * b.v), 0) AS BIGINT) AS total FROM c JOIN (SELECT k, j AS m, v FROM b) b USING (k)")
def ttm_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _out(eager.sum_product([tensor_c(spark, sf), matrix_b(spark, sf, "m", "k")]))


@query(f"WITH {C_SQL}, d AS (SELECT l_partkey % 50 AS i, l_suppkey AS j, l_linenumber AS k, count(*) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT CAST(coalesce(sum(c.v * d.v), 0) AS BIGINT) AS total FROM c JOIN d USING (i, j, k)")
def inner3(spark: SparkSession, sf: str) -> DataFrame:
    df = _lineitem(spark, sf, "l_partkey", "l_suppkey", "l_linenumber").select((F.col("l_partkey") % 50).alias("i"), F.col("l_suppkey").alias("j"), F.col("l_linenumber").alias("k"))
    return _out((tensor_c(spark, sf) * KRel.table(df, ("i", "j", "k")).dedup()).total())


TWO_SQL = """x AS (SELECT l_suppkey AS i, l_linenumber AS j, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
y AS (SELECT l_suppkey AS i, l_linenumber AS j, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)"""


def _two(spark: SparkSession, sf: str) -> tuple[KRel, KRel]:
    df = _lineitem(spark, sf, "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    part = lambda flag: readers.coo(df.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j"), "l_quantity"), ("i", "j"), "l_quantity")
    return part("R"), part("A")


@query(f"WITH {TWO_SQL} SELECT CAST(coalesce(sum(x.v * y.v), 0) AS BIGINT) AS total FROM x JOIN y USING (i, j)")
def inner_product(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two(spark, sf)
    return _out((x * y).total())


@query(f"WITH {TWO_SQL} SELECT i, j, x.v * y.v AS total FROM x JOIN y USING (i, j)")
def elementwise_product(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two(spark, sf)
    return _out(x * y)


@query(f"WITH {V_SQL} SELECT j, CAST(v.v * s.n * s.q AS BIGINT) AS total FROM v JOIN (SELECT l_suppkey AS j, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) s USING (j)")
def vec_mul3(spark: SparkSession, sf: str) -> DataFrame:
    count = KRel.table(_lineitem(spark, sf, "l_suppkey"), ("l_suppkey",)).label("j").dedup()
    return _out(product(vector_v(spark, sf), count, matrix_a(spark, sf).select("j")))


@query(f"WITH {TWO_SQL} SELECT CAST(coalesce(sum(coalesce(x.v, 0) + coalesce(y.v, 0)), 0) AS BIGINT) AS total FROM x FULL JOIN y USING (i, j)")
def add_sum(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two(spark, sf)
    return _out(x.seq(y).total())


@query(f"WITH {TWO_SQL} SELECT i, j, CAST(coalesce(x.v, 0) + coalesce(y.v, 0) AS BIGINT) AS total FROM x FULL JOIN y USING (i, j)")
def add_rows(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two(spark, sf)
    return _out(x + y)


@query(f"WITH {TWO_SQL} SELECT i, j, CAST(x.v + coalesce(y.v, 0) AS BIGINT) AS total FROM x LEFT JOIN y USING (i, j)")
def add_on_support(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two(spark, sf)
    return _out(x + y.lookup())


@query(f"WITH {TWO_SQL} SELECT i, j, x.v + 10 * i + j AS total FROM x")
def add_function(spark: SparkSession, sf: str) -> DataFrame:
    x, _ = _two(spark, sf)
    return _out(x + Fun(("i", "j"), lambda i, j: 10 * i + j))


@query(f"WITH {A_SQL} SELECT i, CAST(sum(v) AS BIGINT) AS total FROM a GROUP BY i")
def row_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _out(matrix_a(spark, sf).contract("j"))


@query(f"WITH {A_SQL} SELECT j, CAST(sum(v) AS BIGINT) AS total FROM a GROUP BY j")
def col_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _out(matrix_a(spark, sf).contract("i"))


@query(f"WITH {A_SQL} SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM a")
def total_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _out(matrix_a(spark, sf).total())


@query("SELECT CAST(0 AS BIGINT) AS total")
def empty_total(spark: SparkSession, sf: str) -> DataFrame:
    return _out((matrix_a(spark, sf) * P.lt("i", -1)).total())


CHAIN_SQL = f"""{A_SQL}, {B_SQL}, w AS (SELECT l_linenumber AS k, l_returnflag AS l, count(*) AS v FROM lineitem GROUP BY 1, 2)
SELECT i, l, CAST(sum(CAST(a.v AS HUGEINT) * b.v * w.v) AS BIGINT) AS total FROM a JOIN b USING (j) JOIN w USING (k) GROUP BY i, l"""


def _chain(spark: SparkSession, sf: str) -> tuple[KRel, KRel, KRel]:
    w = KRel.table(_lineitem(spark, sf, "l_linenumber", "l_returnflag").select(F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("l")), ("k", "l")).dedup()
    return matrix_a(spark, sf), matrix_b(spark, sf), w


@query("WITH " + CHAIN_SQL)
def abc_fused(spark: SparkSession, sf: str) -> DataFrame:
    """The last two factors meet first: their index of few values becomes columns, and each row of the first sums them once."""
    a, b, w = _chain(spark, sf)
    return _out(eager.matmul(a, (b * w).contract("k").memo(checkpoint=True)))


@query("WITH " + CHAIN_SQL)
def abc_memo(spark: SparkSession, sf: str) -> DataFrame:
    """The first product is one aggregate, with unique keys, that the second reads."""
    a, b, w = _chain(spark, sf)
    return _out(eager.matmul(eager.matmul(a, b), w))


@query(f"WITH {B_SQL} SELECT x.j AS i, y.j AS j, CAST(sum(x.v * y.v) AS BIGINT) AS total FROM b x JOIN b y ON x.k = y.k AND x.k <= x.j AND y.k >= y.j GROUP BY 1, 2")
def masked_matmul(spark: SparkSession, sf: str) -> DataFrame:
    lower = matrix_b(spark, sf, "i", "k") * P.lower_triangle("i", "k")
    upper = matrix_b(spark, sf, "j", "k") * P.upper_triangle("j", "k")
    return _out((lower * upper).contract("k"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
heads AS (SELECT label, min(vec_id) AS m FROM embeddings GROUP BY label), pairs AS (SELECT vec_id AS p, m FROM embeddings JOIN heads USING (label))
SELECT p, m, round(sum(a.x::DOUBLE * b.x::DOUBLE), 6) AS total FROM pairs JOIN e a ON a.vec_id = p JOIN e b ON b.vec_id = m AND a.i = b.i GROUP BY p, m""")
def sddmm(spark: SparkSession, sf: str) -> DataFrame:
    """Dot products only where they are requested: each vector with the first one of its label."""
    df = _read(spark, sf, "embeddings", "vec_id", "embedding", "label")
    person = KRel.table(df, ("vec_id", "label"), None, REAL).label("p", "label")
    heads = KRel.table(df, ("label",), "vec_id", MIN_PLUS).dedup().map(lambda v: v.cast("long"), semiring=COUNTING).lift("m").support(REAL)
    vectors = lambda name: shape.of_array(df.withColumnRenamed("vec_id", name), (name,), "embedding", "i", REAL)
    request = (person * heads).select("p", "m").support()
    return _out(product(request, vectors("p"), vectors("m")).contract("i").map(lambda v: F.round(v, 6)))


# --- sets, filters, lookups ------------------------------------------------------------


def _sets(spark: SparkSession, sf: str) -> tuple[KRel, KRel]:
    df = _read(spark, sf, "events", "user_id", "event_id", "event_type")
    side = lambda kind: KRel.table(df.where(F.col("event_type") == kind).select((F.col("user_id") % 50).alias("x"), (F.col("event_id") % 50).alias("y")), ("x", "y"), None, BOOLEAN)
    return side("click"), side("view")


SETS_SQL = "SELECT user_id % 50 AS x, event_id % 50 AS y FROM events WHERE event_type = 'click' {} SELECT user_id % 50, event_id % 50 FROM events WHERE event_type = 'view'"


@query(SETS_SQL.format("UNION"))
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return sums.union(*_sets(spark, sf)).df.select("x", "y")


@query(SETS_SQL.format("INTERSECT"))
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return sums.intersect(*_sets(spark, sf)).df.select("x", "y")


@query(SETS_SQL.format("EXCEPT"))
def anti_filter(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _sets(spark, sf)
    return x.select("x", "y").anti(y).df.select("x", "y")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    customer = KRel.table(_read(spark, sf, "customer", "c_custkey", "c_nationkey"), ("c_custkey", "c_nationkey"))
    urgent = KRel.table(_read(spark, sf, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'"), ("o_custkey",)).label("c_custkey")
    return customer.semi(urgent).df


@query("SELECT CAST(coalesce(count(*), 0) AS BIGINT) AS total FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) < 1998")
def count_range(spark: SparkSession, sf: str) -> DataFrame:
    fires = KRel.table(_read(spark, sf, "orders", "o_orderkey", "o_orderdate"), ("o_orderkey", "o_orderdate")).derive("year", S.date_to_year, "o_orderdate")
    return _out((fires * P.between("year", 1996, 1998)).total())


def _indicator(name: str, sign: str, pred: Callable[[str, object], object]) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        orders = KRel.table(_read(spark, sf, "orders", "o_orderkey", "o_custkey"), ("o_orderkey", "o_custkey"))
        return (orders * pred("o_custkey", 70)).df

    f.__name__ = f"indicator_{name}"
    query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {sign} 70")(f)


for _name, _sign, _pred in (("eq", "=", P.eq), ("ge", ">=", P.ge), ("gt", ">", P.gt), ("le", "<=", P.le), ("lt", "<", P.lt)):
    _indicator(_name, _sign, _pred)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 50 AND 70 OR o_custkey = 90")
def indicator_combined(spark: SparkSession, sf: str) -> DataFrame:
    orders = KRel.table(_read(spark, sf, "orders", "o_orderkey", "o_custkey"), ("o_orderkey", "o_custkey"))
    return (orders * (P.between_incl("o_custkey", 50, 70) | P.between_incl("o_custkey", 90, 90))).df


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS total FROM orders GROUP BY 1")
def derive_year(spark: SparkSession, sf: str) -> DataFrame:
    orders = KRel.table(_read(spark, sf, "orders", "o_orderkey", "o_orderdate"), ("o_orderkey", "o_orderdate"))
    return _out(orders.derive("year", S.date_to_year, "o_orderdate").select("year"))


@query("SELECT upper(event_type) AS event_type, count(*) AS total FROM events GROUP BY 1")
def key_map_upper(spark: SparkSession, sf: str) -> DataFrame:
    return _out(KRel.table(_read(spark, sf, "events", "event_type"), ("event_type",)).map_key("event_type", F.upper))


LOOKUP_SQL = """WITH counts AS (SELECT upper(event_type) AS k, count(*) AS n FROM events WHERE value > 50 GROUP BY 1),
keys AS (SELECT DISTINCT event_type AS k FROM events)
SELECT {} FROM keys LEFT JOIN counts ON upper(keys.k) = counts.k WHERE length(keys.k) > 4 {}"""


def _lookup(spark: SparkSession, sf: str) -> KRel:
    events = _read(spark, sf, "events", "event_type", "value")
    locations = KRel.table(events, ("event_type",), None, BOOLEAN).dedup().support(COUNTING)
    counts = KRel.table(events.where("value > 50"), ("event_type",)).map_key("event_type", F.upper)
    chosen = locations * P.where(lambda k: F.length(k) > 4, "event_type")
    return chosen.map_key("event_type", F.upper, collapse=False) * counts.lookup()


@query(LOOKUP_SQL.format("upper(keys.k) AS event_type, CAST(coalesce(n, 0) AS BIGINT) AS total", ""))
def lookup_default_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_lookup(spark, sf))


@query(LOOKUP_SQL.format("CAST(coalesce(sum(coalesce(n, 0)), 0) AS BIGINT) AS total", ""))
def filter_map_lookup_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_lookup(spark, sf).total())


HAVING_SQL = """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN
(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) <= 4) {}"""


def _having(spark: SparkSession, sf: str, zero_default: bool) -> DataFrame:
    orders = KRel.table(_read(spark, sf, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'"), ("o_custkey",)).label("c_custkey")
    customer = KRel.table(_read(spark, sf, "customer", "c_custkey", "c_mktsegment"), ("c_custkey", "c_mktsegment"))
    return having(orders, ("c_custkey",), lambda n: n <= 4, zero_default=zero_default, of=customer).df


@query(HAVING_SQL.format(""))
def having_count(spark: SparkSession, sf: str) -> DataFrame:
    return _having(spark, sf, False)


@query(HAVING_SQL.format("OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"))
def having_zero_default(spark: SparkSession, sf: str) -> DataFrame:
    return _having(spark, sf, True)


@query("""SELECT c_mktsegment, count(*) AS total FROM customer WHERE c_custkey IN
(SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) <= 10) GROUP BY 1""")
def small_company_employees(spark: SparkSession, sf: str) -> DataFrame:
    size = KRel.table(_read(spark, sf, "orders", "o_custkey"), ("o_custkey",)).label("c_custkey").dedup().lift("size")
    customer = KRel.table(_read(spark, sf, "customer", "c_custkey", "c_mktsegment"), ("c_custkey", "c_mktsegment"))
    return _out((customer * (size * P.le("size", 10))).select("c_mktsegment"))


# --- other semirings ------------------------------------------------------------------


@query("WITH e AS (SELECT DISTINCT user_id % 30 AS i, event_id % 30 AS j FROM events WHERE event_type = 'purchase') SELECT DISTINCT x.i, y.j FROM e x JOIN e y ON x.j = y.i")
def bool_paths(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events", "user_id", "event_id", "event_type").where("event_type = 'purchase'")
    e = KRel.table(df.select((F.col("user_id") % 30).alias("i"), (F.col("event_id") % 30).alias("j")).distinct(), ("i", "j"), None, BOOLEAN)
    return paths.two_hop(e).df.select("i", "j")


def _weighted(spark: SparkSession, sf: str, ring) -> KRel:
    df = _read(spark, sf, "events", "user_id", "event_id", "value")
    return readers.coo(df.select((F.col("user_id") % 30).alias("i"), (F.col("event_id") % 30).alias("j"), "value"), ("i", "j"), "value", ring)


PATHS_SQL = "WITH e AS (SELECT user_id % 30 AS i, event_id % 30 AS j, {0}(value) AS v FROM events GROUP BY 1, 2) SELECT x.i, y.j, round({0}(x.v + y.v), 6) AS total FROM e x JOIN e y ON x.j = y.i GROUP BY 1, 2"


@query(PATHS_SQL.format("min"))
def minplus_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _out(paths.two_hop(_weighted(spark, sf, MIN_PLUS)).map(lambda v: F.round(v, 6)))


@query(PATHS_SQL.format("max"))
def maxplus_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _out(paths.two_hop(_weighted(spark, sf, MAX_PLUS)).map(lambda v: F.round(v, 6)))


@query(f"WITH {A_SQL} SELECT CAST(coalesce(max(greatest(i, j)), -1.7976931348623157e308) AS DOUBLE) AS total FROM a")
def udf_max(spark: SparkSession, sf: str) -> DataFrame:
    mask = matrix_a(spark, sf).support(MAX_PLUS)
    return _out((mask * Fun(("i", "j"), lambda i, j: S.maximum(i, j).cast("double"), MAX_PLUS)).total())


@query("SELECT min(l_quantity) AS total FROM lineitem")
def min_total(spark: SparkSession, sf: str) -> DataFrame:
    return _out(KRel.table(_lineitem(spark, sf, "l_orderkey", "l_quantity"), ("l_orderkey",), "l_quantity", MIN_PLUS).total())


@query("SELECT l_shipmode_exists AS total FROM (SELECT bool_or(l_quantity > 49) AS l_shipmode_exists FROM lineitem)")
def exists_total(spark: SparkSession, sf: str) -> DataFrame:
    return _out(KRel.table(_lineitem(spark, sf, "l_orderkey", "l_quantity"), ("l_orderkey",), F.col("l_quantity") > 49, BOOLEAN).total())


# --- shapes and maps --------------------------------------------------------------------


@query(f"WITH {TWO_SQL} SELECT i, j, x.v AS left_value, y.v AS right_value FROM x JOIN y USING (i, j)")
def zip_pair(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two(spark, sf)
    return x.zip(y).df.select("i", "j", F.col("v.left").alias("left_value"), F.col("v.right").alias("right_value"))


@query("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey")
def theta_lt(spark: SparkSession, sf: str) -> DataFrame:
    x = KRel.table(_read(spark, sf, "nation", "n_nationkey"), ("n_nationkey",)).label("x")
    y = KRel.table(_read(spark, sf, "region", "r_regionkey"), ("r_regionkey",)).label("y")
    return x.theta(y, S.lt, ("x", "y")).df


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def dedup_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _out(readers.coo(_lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_quantity"), ("l_orderkey", "l_linenumber"), "l_quantity"))


@query("SELECT CAST(g.k AS BIGINT) AS k, CAST(coalesce(n, 0) AS BIGINT) AS total FROM (SELECT unnest(range(0, 40)) AS k) g LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s USING (k)")
def dense_fill(spark: SparkSession, sf: str) -> DataFrame:
    return _out(shape.dense_fill(KRel.table(_read(spark, sf, "supplier", "s_nationkey"), ("s_nationkey",)).label("k"), "k", 0, 40))


@query("SELECT n_nationkey, r_regionkey, CAST(1 AS BIGINT) AS total FROM nation CROSS JOIN region")
def expand_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    nation = KRel.table(_read(spark, sf, "nation", "n_nationkey"), ("n_nationkey",))
    region = KRel.table(_read(spark, sf, "region", "r_regionkey"), ("r_regionkey",))
    return _out(nation.expand(region))


@query("SELECT l_suppkey AS i, l_linenumber AS j, CAST(2 * sum(l_quantity) + 1 AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def map_value(spark: SparkSession, sf: str) -> DataFrame:
    rel = readers.coo(_lineitem(spark, sf, "l_suppkey", "l_linenumber", "l_quantity"), ("l_suppkey", "l_linenumber"), "l_quantity").label("i", "j")
    return _out(rel.map(lambda v: 2 * v + 1))


@query("SELECT l_suppkey AS i, CAST(sum(l_quantity) * l_suppkey AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey")
def map_with_index(spark: SparkSession, sf: str) -> DataFrame:
    rel = readers.coo(_lineitem(spark, sf, "l_suppkey", "l_quantity"), ("l_suppkey",), "l_quantity").label("i")
    return _out(rel.map(lambda i, v: v * i, with_keys=True))


@query("SELECT l_suppkey, l_linenumber, CAST(1 AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def support_indicator(spark: SparkSession, sf: str) -> DataFrame:
    rel = readers.coo(_lineitem(spark, sf, "l_suppkey", "l_linenumber", "l_quantity"), ("l_suppkey", "l_linenumber"), "l_quantity")
    return _out(rel.support())


@query("SELECT s_suppkey, CAST(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS total FROM supplier")
def bool_times_value(spark: SparkSession, sf: str) -> DataFrame:
    rel = KRel.table(_read(spark, sf, "supplier", "s_suppkey", "s_acctbal"), ("s_suppkey", "s_acctbal"))
    return _out(rel * Fun(("s_acctbal",), lambda x: S.of_bool(x > 0))).select("s_suppkey", "total")


@query("SELECT s_suppkey, s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) AS total FROM supplier WHERE s_acctbal > 5000")
def value_filter(spark: SparkSession, sf: str) -> DataFrame:
    rel = KRel.table(_read(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), ("s_suppkey", "s_nationkey"), F.round(F.col("s_acctbal") * 100))
    return _out(rel.filter_value(lambda v: v > 500_000))


@query("""SELECT l_suppkey, count(*) AS n, CAST(min(l_quantity) AS BIGINT) AS least, CAST(max(l_quantity) AS BIGINT) AS most FROM lineitem GROUP BY 1""")
def fold_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rel = KRel.table(_lineitem(spark, sf, "l_suppkey", "l_quantity"), ("l_suppkey",), "l_quantity")
    return rel.fold(("l_suppkey",), n=F.count("*"), least=F.min(VALUE), most=F.max(VALUE))


@query("""SELECT p_partkey, p_size < 25 AS lt, CAST(p_size <= 25 AS DOUBLE) AS le_real, p_size = 25 AS eq, greatest(p_size, 25) AS most, least(p_size, 25) AS least,
CAST((p_size + 25) // 2 AS BIGINT) AS mid, NOT (p_size < 25) AS neg, p_size + 1 AS succ, CASE WHEN p_size > 0 THEN 1.0 / p_size END AS div,
CASE WHEN p_size < 25 THEN p_name ELSE p_brand END AS pick, CAST(instr(p_name, 'blue') - 1 AS INTEGER) AS place, contains(p_name, 'blue') AS has,
CAST(coalesce(TRY_CAST(regexp_extract(p_brand, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS BIGINT) AS number, CAST(p_size AS DOUBLE) AS real FROM part""")
def scalar_ops(spark: SparkSession, sf: str) -> DataFrame:
    size, k = F.col("p_size"), F.lit(25)
    return _read(spark, sf, "part", "p_partkey", "p_size", "p_name", "p_brand").select(
        "p_partkey", S.lt(size, k).alias("lt"), S.le(size, k).cast("double").alias("le_real"), S.eq(size, k).alias("eq"), S.maximum(size, k).alias("most"), S.minimum(size, k).alias("least"),
        S.mid(size, k).alias("mid"), S.negate(S.lt(size, k)).alias("neg"), S.succ(size).alias("succ"), S.divide(F.lit(1.0), size).alias("div"),
        S.ternary(S.lt(size, k), F.col("p_name"), F.col("p_brand")).alias("pick"), S.find_str("blue", F.col("p_name")).alias("place"), S.has_substr(F.col("p_name"), "blue").alias("has"),
        S.atoi(F.col("p_brand")).alias("number"), S.to_num(size).alias("real"),
    )


@query(f"WITH {B_SQL} SELECT j, CAST(count(*) AS INTEGER) AS entries, CAST(sum(v) AS BIGINT) AS total FROM b GROUP BY j")
def nested_trie(spark: SparkSession, sf: str) -> DataFrame:
    nested = matrix_b(spark, sf).nest("j")
    return nested.select("j", F.size("inner").alias("entries"), F.aggregate("inner", F.lit(0).cast("long"), lambda a, p: a + p["value"]).alias("total"))


@query(f"WITH {B_SQL} SELECT j, k, v AS total FROM b")
def unnest_trie(spark: SparkSession, sf: str) -> DataFrame:
    return _out(shape.unnest(matrix_b(spark, sf).nest("j"), ("j",), ("k",)))


@query("SELECT vec_id, round(sum(x), 5) AS total FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id")
def array_source(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "embeddings", "vec_id", "embedding")
    return _out(shape.of_array(df, ("vec_id",), "embedding", "i", REAL).contract("i").map(lambda v: F.round(v, 5)))


@query(f"WITH {A_SQL}, {B_SQL}, {V_SQL} SELECT k, CAST(sum(CAST(a.v AS HUGEINT) * b.v * v.v) AS BIGINT) AS total FROM a JOIN b USING (j) JOIN v USING (j) GROUP BY k")
def eager_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _out(eager.sum_product([matrix_a(spark, sf), matrix_b(spark, sf), vector_v(spark, sf)], ("k",)))


# --- functions, ranges, rings and shapes beyond those above ----------------------------


@query("SELECT s_suppkey, s_nationkey, CAST(1 AS BIGINT) AS total FROM supplier WHERE s_nationkey < 10")
def guarded_sum(spark: SparkSession, sf: str) -> DataFrame:
    rel = KRel.table(_read(spark, sf, "supplier", "s_suppkey", "s_nationkey"), ("s_suppkey", "s_nationkey"))
    return _out(sums.seq(sums.guard(F.col("s_nationkey") < 10, rel), sums.guard(False, rel)))


@query("SELECT s_suppkey, s_nationkey, CAST(s_nationkey + 1 + 2 * s_suppkey AS BIGINT) AS total FROM supplier")
def function_sum(spark: SparkSession, sf: str) -> DataFrame:
    rel = KRel.table(_read(spark, sf, "supplier", "s_suppkey", "s_nationkey"), ("s_suppkey", "s_nationkey"))
    return _out(rel * (Fun(("s_nationkey",), lambda n: (n + 1).cast("long")) + Fun(("s_suppkey",), lambda k: 2 * k)))


@query("SELECT l_suppkey, CAST(3 * count(*) AS BIGINT) AS total FROM lineitem WHERE l_linenumber BETWEEN 0 AND 4 GROUP BY 1")
def replicate_product(spark: SparkSession, sf: str) -> DataFrame:
    rel = KRel.table(_lineitem(spark, sf, "l_suppkey", "l_linenumber"), ("l_suppkey", "l_linenumber"))
    return _out((rel * shape.replicate(spark, "l_linenumber", 5, 3)).select("l_suppkey"))


@query("SELECT l_linenumber, CAST(count(*) AS BIGINT) AS total FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 5 GROUP BY 1")
def index_range_slice(spark: SparkSession, sf: str) -> DataFrame:
    rel = KRel.table(_lineitem(spark, sf, "l_linenumber"), ("l_linenumber",))
    return _out((rel * shape.index_range(spark, "l_linenumber", 2, 5)).select("l_linenumber"))


@query("SELECT l_suppkey, CAST(bit_xor(l_orderkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def own_semiring(spark: SparkSession, sf: str) -> DataFrame:
    xor = Semiring("xor", "bigint", 0, 1, F.bit_xor, lambda a, b: a.bitwiseXOR(b), lambda a, b: a.bitwiseAND(b))
    return _out(KRel.table(_lineitem(spark, sf, "l_suppkey", "l_orderkey"), ("l_suppkey",), "l_orderkey", xor).dedup())


@query("""SELECT CAST(x.k AS BIGINT) AS nation, CAST(y.d AS BIGINT) AS digit, CAST(coalesce(n, 0) AS BIGINT) AS total
FROM (SELECT unnest(range(0, 25)) AS k) x CROSS JOIN (SELECT unnest(range(-1, 10)) AS d) y
LEFT JOIN (SELECT s_nationkey AS k, s_suppkey % 10 AS d, count(*) AS n FROM supplier GROUP BY 1, 2) s USING (k, d)""")
def dense_matrix(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "supplier", "s_nationkey", "s_suppkey").select(F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_suppkey") % 10).alias("digit"))
    return _out(shape.dense_box(KRel.table(df, ("nation", "digit")), {"nation": (0, 25), "digit": (-1, 10)}))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey <> l_partkey AS ne, l_suppkey - l_partkey AS sub, CAST(l_quantity > 25 AS INTEGER) AS big, CAST(l_partkey AS DOUBLE) AS number,
CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem""")
def scalar_more(spark: SparkSession, sf: str) -> DataFrame:
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    days = F.unix_date(F.to_date("l_shipdate"))
    return _lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate").select(
        "l_orderkey", "l_linenumber", S.ne(supp, part).alias("ne"), (supp - part).alias("sub"), S.of_bool(F.col("l_quantity") > 25, "int").alias("big"), S.to_num(part).alias("number"),
        S.epoch_to_year(days.cast("long") * 86400).cast("int").alias("ship_year"),
    )


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[100000]::DOUBLE AS beyond FROM embeddings")
def array_access(spark: SparkSession, sf: str) -> DataFrame:
    df, x = _read(spark, sf, "embeddings", "vec_id", "embedding"), F.col("embedding")
    return df.select("vec_id", S.access(x, F.lit(0)).cast("double").alias("first"), S.access(x, F.lit(99_999)).cast("double").alias("beyond"))


FOUR_SQL = """r AS (SELECT DISTINCT l_suppkey AS a, l_linenumber AS b FROM lineitem), s AS (SELECT DISTINCT l_linenumber AS b, l_partkey % 997 AS c FROM lineitem),
t AS (SELECT DISTINCT l_partkey % 997 AS c, CAST(l_quantity AS BIGINT) AS d FROM lineitem), u AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS d, l_suppkey AS a FROM lineitem)"""


@query(f"""WITH {FOUR_SQL}, x AS (SELECT a, c, count(*) AS n FROM r JOIN s USING (b) GROUP BY 1, 2), y AS (SELECT c, a, count(*) AS n FROM t JOIN u USING (d) GROUP BY 1, 2)
SELECT CAST(sum(x.n * y.n) AS BIGINT) AS total FROM x JOIN y USING (a, c)""")
def four_cycle_count(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles a, b, c, d: either half is summed to its two ends before the halves meet, so no cycle is listed."""
    df = _lineitem(spark, sf, "l_suppkey", "l_linenumber", "l_partkey", "l_quantity")
    at = {"a": F.col("l_suppkey"), "b": F.col("l_linenumber"), "c": F.col("l_partkey") % 997, "d": F.col("l_quantity").cast("long")}
    r, s, t, u = (KRel.table(df.select(at[x].alias(x), at[y].alias(y)).distinct(), (x, y)) for x, y in ("ab", "bc", "cd", "da"))
    return _out(eager.sum_product([r, s, t, u]))


@query(same_as("matmul_abt"))
def matmul_abt_salted(spark: SparkSession, sf: str) -> DataFrame:
    """Seven line numbers are the only join keys: the rows that share them are dealt to 32 parts."""
    return _out(salted_contraction(matrix_b(spark, sf, "i", "k"), matrix_b(spark, sf, "j", "k"), salts=32, least_rows=64))


# --- sources and sinks ---------------------------------------------------------------


def _fresh(spark: SparkSession) -> str:
    return f"{shape.shared_folder(spark)}/written-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 2) AS price FROM orders")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path, names = _fresh(spark), ("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    sinks.write_csv(_read(spark, sf, "orders", *names), path, delimiter="|")
    back = readers.csv(spark, path, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double", delimiter="|")
    return back.select(*names[:3], F.round("o_totalprice", 2).alias("price"))


@query(f"WITH {B_SQL} SELECT j, k, v AS total FROM b")
def sorted_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _fresh(spark)
    sinks.write_sorted(matrix_b(spark, sf), path)
    return readers.parquet(spark, path).select("j", "k", F.col(VALUE).alias("total"))


@query("SELECT l_suppkey, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2")
def text_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    names = ("l_suppkey", "l_linenumber", "l_quantity")
    text = _lineitem(spark, sf, *names).select(*(F.concat(F.lit(" "), F.col(x).cast("string")).alias(x) for x in names))
    return _out(readers.text_coo(text, names[:2], names[2]))


@query(f"WITH {B_SQL} SELECT j, k, CAST(v AS DOUBLE) AS total FROM b")
def matrix_market_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix as MatrixMarket lines of one-based places; a file of its own holds the head and is read first."""
    path, rows = _fresh(spark), matrix_b(spark, sf).df
    n = rows.agg(F.max("j").alias("j"), F.max("k").alias("k"), F.count("*").alias("n")).select(F.concat_ws(" ", F.col("j") + 1, F.col("k") + 1, "n").alias("value"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general")], "at int, value string").union(n.select(F.lit(1), "value"))
    head.coalesce(1).sortWithinPartitions("at").select("value").write.text(f"{path}/0")
    rows.select(F.concat_ws(" ", F.col("j") + 1, F.col("k") + 1, VALUE)).write.text(f"{path}/1")
    lines = spark.read.text(f"{path}/0").union(spark.read.text(f"{path}/1"))
    return _out(readers.matrix_market_lines(lines, "j", "k"))


@query(f"WITH {B_SQL} SELECT j, count(*) AS entries, CAST(max(v) FILTER (k = 1) AS BIGINT) AS first FROM b GROUP BY j")
def map_sink(spark: SparkSession, sf: str) -> DataFrame:
    maps = sinks.as_map(matrix_b(spark, sf), "j")
    return maps.select("j", F.size("entries").cast("long").alias("entries"), F.try_element_at("entries", F.lit(1)).alias("first"))
