from __future__ import annotations

import math

import pytest

from tests.support import Tables
from tidewake.compare import differences
from tidewake.functions.expr import add, cast, col, div, eq, ge, gt, le, lit, logic_and, logic_not, logic_or, lt, mod, mul, ne, sub
from tidewake.types import Type

I32, I64, F64, BOOL, TS, STR = Type
NAN = math.nan


def same(a, b):
    assert not (d := differences(a, b)), d


def test_kleene(spark):
    t = Tables(spark)
    v = [False, True, None]
    p = t.add("t", [BOOL, BOOL], [(a, b) for a in v for b in v])
    a, b = col(BOOL, 0), col(BOOL, 1)
    got = t.run(p.project([("a", a), ("b", b), ("x", logic_and(a, b)), ("y", logic_or(a, b)), ("z", logic_not(a))]))

    def both(x, y):
        return False if False in (x, y) else None if None in (x, y) else True

    same(got, [(x, y, both(x, y), None if both(None if x is None else not x, None if y is None else not y) is None else not both(not x if x is not None else None, not y if y is not None else None), None if x is None else not x) for x in v for y in v])


def test_null_if_any_and_division_by_zero(spark):
    t = Tables(spark)
    p = t.add("t", [I32, I32, F64], [(10, 3, 1.0), (None, 4, 0.0), (30, None, None), (10, 0, -0.0), (-7, 2, 2.5), (-(2**31), -1, 3.0)])
    a, b, f = col(I32, 0), col(I32, 1), col(F64, 2)
    plan = p.project([("s", add(a, b)), ("l", lt(a, b)), ("d", div(a, b)), ("m", mod(a, b)), ("f", div(a, f)), ("g", mod(cast(a, F64), f))])
    got = t.run(plan)
    same(got, [(13, False, 3, 1, 10.0, 0.0), (None, None, None, None, None, None), (None, None, None, None, None, None), (10, False, None, None, None, None), (-5, True, -3, -1, -2.8, -2.0), (2**31 - 1, True, -(2**31), 0, -(2**31) / 3, -2.0)])
    same(got, t.golden(plan))


def test_wraparound_equals_sql(spark):
    t = Tables(spark)
    p = t.add("t", [I32, I64], [(2**31 - 1, 2**63 - 1), (-(2**31), -(2**63)), (0, 1), (None, None), (65537, 2**62 + 3)])
    a, b = col(I32, 0), col(I64, 1)
    plan = p.project([("a", add(a, lit(I32, 1))), ("s", sub(a, lit(I32, 1))), ("m", mul(a, a)), ("b", add(b, lit(I64, 1))), ("c", mul(b, b)), ("d", div(b, lit(I64, -1)))])
    same(t.run(plan), t.golden(plan))
    assert t.run(plan)[0][0] == -(2**31)


def test_nan_comparisons(spark):
    t = Tables(spark)
    v = [None, NAN, 1.0]
    p = t.add("t", [F64, F64], [(a, b) for a in v for b in v])
    a, b = col(F64, 0), col(F64, 1)
    plan = p.project([("a", a), ("b", b), *((n, f(a, b)) for n, f in (("eq", eq), ("lt", lt), ("le", le), ("gt", gt), ("ge", ge), ("ne", ne)))])
    want = []
    for x in v:
        for y in v:
            if x is None or y is None:
                want.append((x, y, *[None] * 6))
            else:
                want.append((x, y, x == y, x < y, x <= y, x > y, x >= y, x != y))
    same(t.run(plan), want)
    same(t.golden(plan), want)


FLOATS = {2.5: 3, -2.5: -3, 0.5: 1, -0.5: -1, 0.49999999999999994: 0, 9223372036854774784.0: 9223372036854774784, 9223372036854775808.0: None, -9223372036854775808.0: -(2**63), -9.3e18: None, math.inf: None, -math.inf: None, -7901924385117227.0: -7901924385117227}


def test_cast_from_float(spark):
    t = Tables(spark)
    p = t.add("t", [F64], [(x,) for x in [*FLOATS, NAN, None]])
    plan = p.project([("x", col(F64, 0)), ("l", cast(col(F64, 0), I64)), ("b", cast(col(F64, 0), BOOL))])
    same(t.run(plan), [*((x, y, x != 0) for x, y in FLOATS.items()), (NAN, None, True), (None, None, None)])
    same(t.run(plan), t.golden(plan))
    p = t.add("u", [F64], [(2147483647.4,), (2147483647.5,), (-2147483648.5,), (-2147483648.4,), (1e18,)])
    same(t.run(p.project([("i", cast(col(F64, 0), I32))])), [(2147483647,), (None,), (None,), (-2147483648,), (None,)])


def test_cast_between_the_rest(spark):
    t = Tables(spark)
    p = t.add("t", [I32, I64, BOOL, TS], [(1, 2**31, True, -5), (-1, -(2**31) - 1, False, 2**40), (0, 7, None, None)])
    kinds = [I32, I64, F64, BOOL, TS]
    plan = p.project([(f"x{i}_{k.name}", cast(col(s, i), k)) for i, s in enumerate([I32, I64, BOOL, TS]) for k in kinds])
    same(t.run(plan), t.golden(plan))
    assert t.run(plan)[0][5:7] == (None, 2**31)


def test_build_errors():
    with pytest.raises(ValueError):
        add(col(STR, 0), col(I32, 1))
    with pytest.raises(ValueError):
        add(col(TS, 0), col(TS, 1))
    with pytest.raises(ValueError):
        eq(col(STR, 0), col(I32, 1))
    with pytest.raises(ValueError):
        logic_and(col(I32, 0), col(BOOL, 1))
    with pytest.raises(ValueError):
        cast(col(STR, 0), I32)
    assert cast(col(I32, 0), I32) == col(I32, 0)


def test_the_callers_ansi_setting_is_left(spark):
    t = Tables(spark)
    spark.conf.set("spark.sql.ansi.enabled", "true")
    p = t.add("t", [I32], [(2**31 - 1,)])
    assert t.run(p.project([("a", add(col(I32, 0), lit(I32, 1)))])) == [(-(2**31),)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_filters_with_nan_and_null(spark):
    t = Tables(spark)
    v = [None, NAN, 1.0, 2.0]
    p = t.add("t", [F64, F64], [(a, b) for a in v for b in v])
    a, b = col(F64, 0), col(F64, 1)
    for f in (eq, lt, le, gt, ge, ne):
        for x, y in ((a, b), (a, lit(F64, 1.0)), (lit(F64, 1.0), b), (a, lit(F64, NAN)), (a, lit(F64))):
            plan = p.filter(f(x, y))
            same(t.run(plan), t.golden(plan))
            plan = p.filter(logic_or(logic_not(f(x, y)), logic_and(f(y, x), gt(b, a))))
            same(t.run(plan), t.golden(plan))


def test_comparisons_reach_the_scan(spark, capsys):
    from tidewake.operators.lower import to_df
    from tidewake.queries import plans
    from tidewake.sources.tables import load

    to_df(plans()["filter_group_sort"], spark, load(spark, "/root/testdata/sf0.001", ["lineitem"])).explain("formatted")
    shown = capsys.readouterr().out
    assert "GreaterThan(l_quantity,0.0)" in shown and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in shown
