"""Wrong plans and wrong operators must differ from the right plan's SQL on these rows: the comparison has teeth."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.support import Tables
from tidewake.compare import differences
from tidewake.functions.expr import add, cast, col, div, eq, ge, gt, is_null, le, lit, logic_and, logic_not, logic_or, lt, mod, mul, ne, sub
from tidewake.operators import crowds
from tidewake.plans.plan import SortKey, avg, count, count_star, max_, min_, sum_
from tidewake.types import Type

I32, I64, F64, BOOL, TS, STR = Type
N = None
PAIRS = [(7, 2), (-7, 2), (7, 0), (N, 2), (2**31 - 1, 1), (3, N), (2, 2)]
MARKS = [(1, 0, 10), (1, 5, 20), (1, 12, N), (1, 30, 60), (2, 3, 40), (2, 21, 50), (N, 4, 70), (1, 5, 20)]
A, B = col(I32, 0), col(I32, 1)
#: Operator: (right, wrong) as functions of the plans over PAIRS (p) and MARKS (m).
MUTANTS = {
    **{name: (lambda p, m, f=f: p.project([("x", f(A, B))]), lambda p, m, g=g: p.project([("x", g(A, B))])) for name, f, g in (("add", add, sub), ("sub", sub, add), ("mul", mul, add), ("div", div, mod), ("mod", mod, div))},
    **{name: (lambda p, m, f=f: p.filter(f(A, B)), lambda p, m, g=g: p.filter(g(A, B))) for name, f, g in (("gt", gt, ge), ("le", le, lt), ("eq", eq, le), ("ne", ne, gt))},
    "wrap": (lambda p, m: p.project([("x", add(A, B))]), lambda p, m: p.project([("x", add(cast(A, I64), B))])),
    "cast": (lambda p, m: p.project([("x", div(cast(A, F64), cast(B, F64)))]), lambda p, m: p.project([("x", cast(div(A, B), F64))])),
    "and": (lambda p, m: p.project([("x", logic_and(gt(A, B), gt(B, lit(I32, 1))))]), lambda p, m: p.project([("x", logic_or(gt(A, B), gt(B, lit(I32, 1))))])),
    "not": (lambda p, m: p.filter(logic_not(gt(A, B))), lambda p, m: p.filter(logic_or(logic_not(gt(A, B)), is_null(A)))),
    "is_null": (lambda p, m: p.filter(is_null(B)), lambda p, m: p.filter(is_null(A))),
    **{name: (lambda p, m, f=f: m.aggregate([0], [f(2, "x")]), lambda p, m, g=g: m.aggregate([0], [g(2, "x")])) for name, f, g in (("min", min_, max_), ("max", max_, min_), ("sum", sum_, max_), ("avg", avg, sum_))},
    "count": (lambda p, m: m.aggregate([0], [count(2, "x")]), lambda p, m: m.aggregate([0], [count_star("x")])),
    "group by null": (lambda p, m: m.aggregate([0], [count_star("x")]), lambda p, m: m.filter(logic_not(is_null(A))).aggregate([0], [count_star("x")])),
    "semi": (lambda p, m: m.join(p, [0], [1], "semi"), lambda p, m: m.join(p, [0], [1], "anti")),
    "left": (lambda p, m: m.join(p, [0], [1], "left"), lambda p, m: m.join(p, [0], [1])),
    "two keys": (lambda p, m: p.join(p, [0, 1], [0, 1]), lambda p, m: p.join(p, [1], [1])),
    "distinct": (lambda p, m: m.distinct(), lambda p, m: m),
    "union": (lambda p, m: m.union_all(m), lambda p, m: m.union_all(m).distinct()),
    "sort": (lambda p, m: m.sort([SortKey(0), SortKey(1)]), lambda p, m: m.sort([SortKey(1), SortKey(0)])),
    "nulls first": (lambda p, m: m.sort([SortKey(0, False, True), SortKey(1)]), lambda p, m: m.sort([SortKey(0), SortKey(1)])),
    "as-of": (lambda p, m: m.asof_join(m, [0], [0], 1, 1), lambda p, m: m.asof_join(m.filter(gt(col(I32, 1), lit(I32, 4))), [0], [0], 1, 1)),
    "as-of keys": (lambda p, m: m.asof_join(m, [0], [0], 1, 1, "left"), lambda p, m: m.asof_join(m, [], [], 1, 1, "left")),
    "tolerance": (lambda p, m: m.asof_join(m.filter(eq(col(I32, 2), lit(I32, 10))), [], [], 1, 1, "left", 4), lambda p, m: m.asof_join(m.filter(eq(col(I32, 2), lit(I32, 10))), [], [], 1, 1, "left", 5)),
    "bucket": (lambda p, m: m.window_tumbling([0], 1, 5, [count_star("x")]), lambda p, m: m.window_tumbling([0], 1, 6, [count_star("x")])),
    "frame": (lambda p, m: m.window_sliding([0], 1, 2, [count_star("x")]), lambda p, m: m.window_sliding([0], 1, 1, [count_star("x")])),
    "frame keys": (lambda p, m: m.window_sliding([0], 1, 3, [count_star("x")]), lambda p, m: m.window_sliding([], 1, 3, [count_star("x")])),
}


@pytest.fixture(scope="module")
def tables(spark):
    t = Tables(spark)
    return t, t.add("p", [I32, I32], PAIRS), t.add("m", [I32, I32, I32], MARKS)


@pytest.mark.parametrize("name", MUTANTS)
def test_wrong_plans_are_seen(tables, name):
    t, *plans = tables
    right, wrong = (make(*plans) for make in MUTANTS[name])
    ordered = right.node.kind == "sort"
    golden = t.golden(right)
    assert not differences(t.run(right), golden, ordered)
    assert differences(t.run(wrong), golden, ordered)


@pytest.mark.parametrize("keys", [[], [0]])
def test_wrong_ranges_of_time_are_seen(spark, monkeypatch, keys):
    """Ranges in the wrong order must show. Without keys an as-of join's ranges begin with build rows, so order is nothing to it."""
    monkeypatch.setattr(crowds, "CROWD", 5)
    monkeypatch.setattr(crowds, "FEW_BYTES", -1)
    t = Tables(spark)
    m = t.add("m", [I32, I64], [(1, 3 * i) for i in range(80)])
    plans = [m.window_sliding(keys, 1, 4, [sum_(1, "x")])]
    if keys:
        plans.append(m.asof_join(m.filter(eq(mod(col(I64, 1), lit(I64, 9)), lit(I64, 0))), keys, keys, 1, 1))
    for plan in plans:
        assert not differences(t.run(plan), t.golden(plan))
    true = crowds.range_of
    monkeypatch.setattr(crowds, "range_of", lambda time, limits: F.size(limits) - true(time, limits))
    for plan in plans:
        assert differences(t.run(plan), t.golden(plan))
