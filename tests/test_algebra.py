"""Laws and edge cases of the algebra, against dictionaries and known values."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semirel.errors import AlgebraError
from semirel.operators import predicates as P
from semirel.operators import shape, sums
from semirel.operators.contraction import having
from semirel.plans import eager, paths
from semirel.plans.skew import salted_product
from semirel.plans.triangle import listed_rows, triangle_balanced, triangle_naive
from semirel.relation import Fun, KRel
from semirel.semiring import BOOLEAN, COUNTING, LARGEST, MAX_PLUS, MIN_PLUS, REAL, Semiring, register, semiring
from semirel.sources import generators, sinks


def rel(spark, entries, keys="i j", ring=COUNTING):
    names = keys.split()
    schema = ", ".join(f"{k} long" for k in names) + f", x {ring.dtype}"
    return KRel.table(spark.createDataFrame([(*k, v) for k, v in entries], schema), names, "x", ring)


def content(r):
    r = r.canonical()
    return {tuple(row[k] for k in sorted(r.keys)): row["v"] for row in r.df.collect()}


def times(a, ka, b, kb):
    out = {}
    for (x, v), (y, w) in itertools.product(a, b):
        left, right = dict(zip(ka.split(), x, strict=True)), dict(zip(kb.split(), y, strict=True))
        if all(left[k] == right[k] for k in left.keys() & right.keys()):
            key = tuple(v for _, v in sorted((left | right).items()))
            out[key] = out.get(key, 0) + v * w
    return {k: v for k, v in out.items() if v}


def total(entries):
    out = {}
    for k, v in entries:
        out[k] = out.get(k, 0) + v
    return {k: v for k, v in out.items() if v}


matrix = st.lists(st.tuples(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.integers(-2, 3)), max_size=8)
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(a=matrix, b=matrix, c=matrix)
def test_laws(spark, a, b, c):
    x, y, z = rel(spark, a), rel(spark, b, "j k"), rel(spark, c, "j k")
    assert content(x * y) == times(a, "i j", b, "j k")  # bags multiply
    assert content(y + z) == total([*b, *c])
    assert content(x * (y + z)) == content(x * y + x * z)
    assert content((x * y).contract("j")) == content(eager.sum_product([x, y], ("i", "k")))
    assert sinks.scalar(x * y) == sinks.scalar(eager.sum_product([x, y]))
    assert content(x * P.le("i", 1)) == total([e for e in a if e[0][0] <= 1])


def test_bag_multiplicities(spark):
    one, two = rel(spark, [((1,), 1)] * 2, "i"), rel(spark, [((1,), 1)] * 2, "i")
    assert sinks.scalar(one * one.dedup()) == 4 and sinks.scalar(one * two) == 4


def test_empty_totals(spark):
    none = shape.empty(spark, "i long")
    assert sinks.scalar(none) == 0
    assert sinks.scalar(shape.empty(spark, "i long", BOOLEAN)) is False
    assert sinks.scalar(shape.empty(spark, "i long", MIN_PLUS)) == LARGEST
    assert sinks.scalar(shape.empty(spark, "i long", MAX_PLUS)) == -LARGEST


def test_functions_are_not_enumerable(spark):
    f = Fun(("i",), lambda i: i * 2)
    for x in (f, P.eq("i", 1), rel(spark, [((1,), 1)], "i").lookup()):
        with pytest.raises(AlgebraError):
            x.contract("i")
    with pytest.raises(AlgebraError):
        rel(spark, [((1,), 1)], "i") * Fun(("j",), lambda j: j)
    with pytest.raises(AlgebraError):
        rel(spark, [((1,), 1)], "i").contract("k")
    both = f * Fun(("j",), lambda j: j + 1)
    assert content(rel(spark, [((2, 3), 1)]) * both) == {(2, 3): 16}
    assert content(rel(spark, [((2, 3), 1)]) * (f + Fun(("j",), lambda j: j))) == {(2, 3): 7}


def test_products_with_truths_and_scalars(spark):
    x = rel(spark, [((1,), 5), ((2,), 7)], "i")
    members = KRel.table(spark.createDataFrame([(1,)], "i long"), ("i",), None, BOOLEAN)
    assert content(x * members) == {(1,): 5} and content(x.semi(members)) == {(1,): 5} and content(x.anti(members)) == {(2,): 7}
    assert content(x * 3) == {(1,): 15, (2,): 21} and content(3 * x) == content(x * 3)
    assert (x * False).df.count() == 2 and content(x * False) == {}  # explicit zeros, absent in canonical form
    assert content(x + 1) == {(1,): 6, (2,): 8}
    assert content(x * rel(spark, [((1,), 2)], "i").lookup()) == {(1,): 10}
    assert content(x + rel(spark, [((1,), 2)], "i").lookup()) == {(1,): 7, (2,): 7}
    assert content(sums.guard(F.col("i") > 1, x)) == {(2,): 7} and content(sums.guard(False, x)) == {}
    with pytest.raises(AlgebraError):
        x * rel(spark, [((1,), 2.0)], "i", REAL)


def test_keys(spark):
    x = rel(spark, [((1, 2), 5), ((3, 2), 7)])
    assert content(x.label("a", "b").contract("a")) == {(2,): 12}
    assert content(x.map_key("i", lambda i: i % 2)) == {(1, 2): 12}
    assert content(x.derive("k", lambda i, j: i + j, "i", "j").select("k")) == {(3,): 5, (5,): 7}
    assert content(x.lift("n").select("n")) == {(5,): 1, (7,): 1}
    with pytest.raises(AlgebraError):
        x.rename(i="j")
    assert sorted(r["v"]["left"] + r["v"]["right"] for r in x.zip(x).df.collect()) == [10, 14]
    nested = x.nest("j")
    assert [(r["j"], [(p["i"], p["value"]) for p in r["inner"]]) for r in nested.collect()] == [(2, [(1, 5), (3, 7)])]
    assert content(shape.unnest(nested, ("j",), ("i",))) == content(x)


def test_literal_relation_adds_duplicates(spark):
    assert sinks.scalar(KRel.of_rows(spark, [(0, 1), (1, 3)], "i long, x long")) == 4
    assert content(KRel.of_rows(spark, [(0, 1), (0, 3)], "i long, x long")) == {(0,): 4}


def test_filter_map_lookup_sum(spark):
    places = KRel.table(spark.createDataFrame([("Hi",), ("There",)], "k string"), ("k",))
    counts = KRel.of_rows(spark, [("HI", 10), ("THERE", 3)], "k string, x long")
    long_ones = places * P.where(lambda k: F.length(k) > 3, "k")
    assert sinks.scalar(long_ones.map_key("k", F.upper) * counts.lookup()) == 3


def test_having(spark):
    members = rel(spark, [((1,), 1)] * 3 + [((2,), 1)], "i")
    base = KRel.table(spark.createDataFrame([(1,), (2,), (3,)], "i long"), ("i",))
    low = lambda n: n <= 2
    assert set(content(having(members, ("i",), low, of=base))) == {(2,)}
    assert set(content(having(members, ("i",), low, of=base, zero_default=True))) == {(2,), (3,)}


@pytest.mark.parametrize("n", [1, 2, 50, 300])
def test_star_triangles(spark, n):
    r, s, t = generators.star(spark, n), generators.star(spark, n, "b", "c"), generators.star(spark, n, "a", "c")
    assert triangle_balanced(r, s, t).df.count() == 3 * n - 2
    assert listed_rows(r, s, t).first()[0] == 3 * n - 2
    if n <= 50:
        assert triangle_naive(r, s, t).df.count() == 3 * n - 2
        assert listed_rows(r, s, t, balanced=False).first()[0] == n * n + n - 1


def test_balanced_plan_keeps_values(spark):
    r = rel(spark, [((1, 2), 2), ((1, 3), 5)], "a b")
    s = rel(spark, [((2, 4), 3), ((3, 4), 7)], "b c")
    t = rel(spark, [((1, 4), 11)], "a c")
    assert content(triangle_balanced(r, s, t)) == content(triangle_naive(r, s, t)) == {(1, 2, 4): 66, (1, 3, 4): 385}


def test_salted_product(spark):
    a = [((i, 0 if i % 3 else i), 1 + i) for i in range(60)]
    b = [((0, k), 2 * k + 1) for k in range(5)] + [((3, 7), 4), ((99, 1), 5)]
    plain = rel(spark, a) * rel(spark, b, "j k")
    salted = salted_product(rel(spark, a), rel(spark, b, "j k"), salts=4, least_rows=10)
    assert content(salted) == content(plain) and salted.df.count() == plain.df.count()


def test_paths(spark):
    e = rel(spark, [((1, 2), 4.0), ((2, 3), 5.0), ((1, 3), 20.0)], "i j", MIN_PLUS)
    assert content(paths.two_hop(e)) == {(1, 3): 9.0}
    assert content(paths.closure(e, 1))[(1, 3)] == 9.0


def test_own_semiring(spark):
    register(Semiring("xor", "bigint", 0, 1, F.bit_xor, lambda a, b: a.bitwiseXOR(b), lambda a, b: a.bitwiseAND(b)))
    assert content(rel(spark, [((1,), 6), ((1,), 3)], "i", semiring("xor"))) == {(1,): 5}


def test_ranges_and_fill(spark):
    assert shape.index_range(spark, "i", 2, 5).df.count() == 3
    assert content(shape.replicate(spark, "i", 3, 7)) == {(0,): 7, (1,): 7, (2,): 7}
    filled = shape.dense_fill(rel(spark, [((1,), 4)], "i"), "i", 0, 3)
    assert sorted((r["i"], r["v"]) for r in filled.df.collect()) == [(0, 0), (1, 4), (2, 0)]
    assert content(shape.of_map(spark.createDataFrame([(1, {"a": 2})], "k long, m map<string,long>"), ("k",), "m", "n")) == {(1, "a"): 2}
