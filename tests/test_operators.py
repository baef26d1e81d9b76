from __future__ import annotations

import math

import pytest

from tests.support import Tables, rows
from tidewake.compare import differences
from tidewake.functions.expr import add, col, gt, lit, lt
from tidewake.plans.plan import SortKey, avg, compressed_scan, count, count_star, max_, min_, sum_
from tidewake.types import Type

I32, I64, F64, BOOL, TS, STR = Type
NAN, N = math.nan, None


def same(a, b, ordered=False):
    assert not (d := differences(a, b, ordered)), d


A3 = rows([1, 1, 2, 2, 3, 1, 2, 3, N, N], [N, 20, 30, 40, 50, 60, 70, 80, 90, 100], [1.5, 2.5, N, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5])
AGGS = [count_star("n"), count("c1", "c"), sum_("c1", "s"), min_("c1", "lo"), max_("c1", "hi"), avg("c1", "a"), sum_("c2", "f"), avg("c2", "g")]


def test_aggregates(spark):
    t = Tables(spark)
    p = t.add("t", [I32, I32, F64], A3)
    keyed = p.aggregate(["c0"], AGGS)
    same(t.run(keyed), [(1, 3, 2, 80, 20, 60, 40.0, 10.5, 3.5), (2, 3, 3, 140, 30, 70, 46.666666666666664, 12.0, 6.0), (3, 2, 2, 130, 50, 80, 65.0, 14.0, 7.0), (N, 2, 2, 190, 90, 100, 95.0, 20.0, 10.0)])
    same(t.run(keyed), t.golden(keyed))
    same(t.run(p.aggregate([], AGGS)), [(10, 9, 540, 20, 100, 60.0, 56.5, 6.277777777777778)])
    none = p.filter(gt(col(I32, 1), lit(I32, 1000)))
    same(t.run(none.aggregate([], AGGS)), [(0, 0, N, N, N, N, N, N)])
    same(t.run(none.aggregate(["c0"], AGGS)), [])
    same(t.run(p.aggregate(["c0", "c0"], [count_star("n")])), [(1, 1, 3), (2, 2, 3), (3, 3, 2), (N, N, 2)])


def test_aggregate_nan_zero_and_bool(spark):
    t = Tables(spark)
    p = t.add("t", [I32, F64], rows([1, 1, 2, 2, 3, 3, 4, 4], [NAN, 1.5, NAN, NAN, 2.5, 3.5, NAN, N]))
    same(t.run(p.aggregate(["c0"], [min_("c1", "lo"), max_("c1", "hi"), count("c1", "n")])), [(1, 1.5, NAN, 2), (2, NAN, NAN, 2), (3, 2.5, 3.5, 2), (4, NAN, NAN, 1)])
    p = t.add("z", [F64, BOOL], rows([0.0, -0.0, NAN, -NAN, N, N], [True, False, N, N, True, True]))
    plan = p.aggregate(["c0"], [count_star("n"), sum_("c1", "s"), avg("c1", "a"), max_("c1", "hi")])
    same(t.run(plan), [(0.0, 2, 1, 0.5, True), (NAN, 2, N, N, N), (N, 2, 2, 1.0, True)])


def test_joins(spark):
    t = Tables(spark)
    build = t.add("b", [I32, I64], [(1, 10), (1, 11), (2, 20), (5, 50), (5, 51), (5, 52), (N, 1)])
    probe = t.add("p", [I32, I64], [(1, 100), (2, 200), (3, 300), (5, 500), (N, 999)])
    for how, n in (("inner", 6), ("left", 8), ("semi", 3), ("anti", 2)):
        plan = probe.join(build, [0], [0], how)
        assert len(t.run(plan)) == n
        same(t.run(plan), t.golden(plan))
    b = t.add("b2", [I32, F64, I32], [(1, 1.0, 11), (1, 2.0, 12), (2, 1.0, 21), (2, 2.0, 22)])
    p = t.add("p2", [I32, F64], [(1, 2.0), (1, 9.0), (2, 1.0), (2, 2.0)])
    assert sorted(r[4] for r in t.run(p.join(b, [0, 1], [0, 1]))) == [12, 21, 22]
    s = t.add("s", [STR, I64], [("AAPL", 10), ("MSFT", 20)])
    q = t.add("q", [STR], [("ZZZ",), ("AAPL",)])
    assert t.run(q.join(s, ["c0"], ["c0"])) == [("AAPL", "AAPL", 10)]
    z = t.add("z", [F64], [(0.0,), (NAN,)])
    assert len(t.run(z.join(t.add("y", [F64], [(-0.0,), (NAN,)]), [0], [0]))) == 2
    fan = t.add("fan", [I32], [(7,)] * 3000)
    assert len(t.run(t.add("few", [I32], [(7,), (9,), (7,)]).join(fan, [0], [0], "left"))) == 6001


def test_sort(spark):
    t = Tables(spark)
    p = t.add("t", [I32, F64], rows([5, -3, N, 7, 2, N, 4, 100], [N, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5]))
    for down in (False, True):
        for first in (False, True):
            plan = p.sort([SortKey("c0", down, first), SortKey("c1")])
            some = sorted((x for x in [5, -3, 7, 2, 4, 100]), reverse=down)
            assert [r[0] for r in t.run(plan)] == ([N, N, *some] if first else [*some, N, N])
            same(t.run(plan), t.golden(plan), ordered=True)
    p = t.add("f", [F64, I64], rows([NAN, 2.0, -math.inf, NAN, N, math.inf, -3.5, NAN, 7.25], list(range(9))))
    assert [r[1] for r in t.run(p.sort(["c0", "c1"]))] == [2, 6, 1, 8, 5, 0, 3, 7, 4]
    z = t.add("z", [F64, I64], [(0.0, 3), (-0.0, 2), (0.0, 1)])
    assert [r[1] for r in t.run(z.sort(["c0", "c1"]))] == [1, 2, 3]
    s = t.add("s", [I32, I64], [(i % 3, i) for i in range(50)])
    assert [r[1] for r in t.run(s.sort([SortKey("c0", True)], stable_by="c1"))] == [i for k in (2, 1, 0) for i in range(50) if i % 3 == k]
    g = t.add("g", [I32, I64], [(1, 10), (2, 20), (1, 30), (3, 5), (2, 7), (1, 1), (3, 9), (2, 3)])
    assert t.run(g.aggregate(["c0"], [sum_("c1", "s")]).sort([SortKey("s", True), "c0"])) == [(1, 41), (2, 30), (3, 14)]


BUILD = [(1, 10, 100), (1, 20, 200), (1, 30, 300), (2, 15, 150)]
PROBE = [(1, 5), (1, 10), (1, 25), (2, 15), (3, 99), (1, 50)]


@pytest.mark.parametrize(("how", "tolerance"), [("inner", None), ("left", None), ("inner", 10), ("left", 10), ("left", 0)])
def test_asof(spark, how, tolerance):
    t = Tables(spark)
    p, b = t.add("p", [I32, TS], PROBE), t.add("b", [I32, TS, I64], BUILD)
    plan = p.asof_join(b, ["c0"], ["c0"], "c1", "c1", how, tolerance)
    want = []
    for k, x in PROBE:
        near = max((r for r in BUILD if r[0] == k and r[1] <= x), key=lambda r: r[1], default=None)
        if near and tolerance is not None and x - near[1] > tolerance:
            near = None
        if near or how == "left":
            want.append((k, x, *(near or (N, N, N))))
    same(t.run(plan), want)
    same(t.golden(plan), want)


def test_asof_edges(spark):
    t = Tables(spark)
    prices = t.add("prices", [STR, I64, TS, F64], [("oil", 1, 4, 70.5), ("oil", 1, 9, 71.0), ("oil", 1, 9, 71.5), ("oil", 2, 6, 3.0), ("tin", 1, N, 8.0), (N, 1, 2, 9.0), ("tin", N, 2, 9.5)])
    asks = t.add("asks", [STR, I64, TS], [("oil", 1, 3), ("oil", 1, 4), ("oil", 1, 8), ("oil", 1, 50), ("oil", 2, 7), ("tin", 1, 60), (N, 1, 60), ("tin", N, 60), ("oil", 1, N)])
    at = lambda *rest, **k: asks.asof_join(prices, [0, 1], [0, 1], 2, 2, *rest, **k)
    hits = [("oil", 1, 4, "oil", 1, 4, 70.5), ("oil", 1, 8, "oil", 1, 4, 70.5), ("oil", 1, 50, "oil", 1, 9, 71.5), ("oil", 2, 7, "oil", 2, 6, 3.0)]  # of ties the greatest
    missed = [("oil", 1, 3), ("tin", 1, 60), (N, 1, 60), ("tin", N, 60), ("oil", 1, N)]  # nulls match nothing
    same(t.run(at()), hits)
    same(t.run(at("left")), hits + [(*m, N, N, N, N) for m in missed])
    same(t.run(at("inner", 3)), [hits[0], hits[3]])
    when = t.add("moments", [TS], [(x,) for x in (2, 5, 8, N)])
    marks = t.add("marks", [TS, BOOL], [(5, True), (7, False), (N, True)])
    same(t.run(when.asof_join(marks, [], [], 0, 0, "left")), [(2, N, N), (5, 5, True), (8, 7, False), (N, N, N)])
    same(t.run(when.asof_join(marks, [], [], 0, 0, "left", 0)), [(2, N, N), (5, 5, True), (8, N, N), (N, N, N)])
    top, low = t.add("top", [TS], [(2**63 - 1,)]), t.add("low", [TS], [(-(2**63),)])
    assert t.run(top.asof_join(low, [], [], 0, 0, "inner", 2**63 - 1)) == []  # the distance is over 2^63 - 1
    with pytest.raises(ValueError):
        at("left", -1)


def test_asof_without_keys_over_many_ranges(spark):
    t = Tables(spark)
    b = t.add("b", [I64, I64], [(7 * i, i) for i in range(500)])
    p = t.add("p", [I64], [(3 * i - 40,) for i in range(1500)])
    plan = p.asof_join(b, [], [], 0, 0, "left")
    same(t.run(plan), t.golden(plan))


CROWDED = [(k, (i * 37) % 401 - 50 if i % 29 else N, i) for i in range(401) for k in ((1, 1, N, 2)[i % 4],)] + [(3, 7, 1000 + i) for i in range(60)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("crowd", [1, 25, 10**6])
def test_asof_with_crowded_keys(spark, monkeypatch, how, crowd):
    """Most rows under one key, one key with one time only, null keys and times; crowd: rows of a key that a task may have."""
    from tidewake.operators import crowds

    monkeypatch.setattr(crowds, "CROWD", crowd)
    monkeypatch.setattr(crowds, "FEW_BYTES", -1)
    t = Tables(spark)
    b = t.add("b", [I32, I64, I64], [(k, x if x is N else 3 * x, i) for k, x, i in CROWDED[:400] if i % 3 == 0] + [(3, 7, 5), (4, 1, 1)])
    p = t.add("p", [I32, I64, I64], CROWDED)
    for tolerance in (None, 4):
        plan = p.asof_join(b, ["c0"], ["c0"], "c1", "c1", how, tolerance)
        same(t.run(plan), t.golden(plan))


@pytest.mark.parametrize("preceding", [0, 1, 7, 60, 1000])
@pytest.mark.parametrize("crowd", [1, 25, 10**6])
def test_sliding_with_crowded_keys(spark, monkeypatch, preceding, crowd):
    from tidewake.operators import crowds

    monkeypatch.setattr(crowds, "CROWD", crowd)
    monkeypatch.setattr(crowds, "FEW_BYTES", -1)
    t = Tables(spark)
    # each time comes once in a key, as rows of equal times may come in any order
    p = t.add("t", [I32, I64, I64], [(k, x, i) for k, x, i in dict(((k, x), (k, x, i)) for k, x, i in CROWDED).values()])
    plan = p.window_sliding(["c0"], "c1", preceding, [count_star("n"), sum_("c2", "s"), min_("c2", "lo")])
    same(t.run(plan), t.golden(plan))


def test_plans_look_for_crowded_keys_by_size_only(spark, tmp_path):
    from tidewake.operators import crowds

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    small = spark.read.parquet(str(tmp_path / "t"))
    assert not crowds.possible(small, small) and crowds.possible(spark.range(1 << 30), small)


A7 = rows([1, 1, 1, 2, 2, 1], [0, 5, 12, 3, 21, 30], [10, 20, N, 40, 50, 60], [1.5, 2.5, 3.5, 4.5, 5.5, 6.5])
FRAME = [count_star("n"), count("c2", "c"), sum_("c2", "s"), min_("c2", "lo"), max_("c2", "hi"), avg("c3", "a")]


def test_tumbling(spark):
    t = Tables(spark)
    p = t.add("t", [I32, TS, I64, F64], A7)
    same(t.run(p.window_tumbling(["c0"], "c1", 10, FRAME)), [(1, 0, 2, 2, 30, 10, 20, 2.0), (1, 10, 1, 0, N, N, N, 3.5), (1, 30, 1, 1, 60, 60, 60, 6.5), (2, 0, 1, 1, 40, 40, 40, 4.5), (2, 20, 1, 1, 50, 50, 50, 5.5)])
    plan = p.window_tumbling([], "c1", 8, FRAME)
    same(t.run(plan), t.golden(plan))
    q = t.add("n", [I64], [(7,), (-7,), (-13,), (N,), (N,)])
    plan = q.window_tumbling([], "c0", 10, [count_star("n")])
    same(t.run(plan), [(0, 2), (-10, 1), (N, 2)])
    same(t.golden(plan), t.run(plan))


def test_sliding(spark):
    t = Tables(spark)
    p = t.add("t", [I32, TS, I64, F64], A7)
    same([(r[0], r[1], *r[4:]) for r in t.run(p.window_sliding(["c0"], "c1", 2, FRAME))], [(1, 0, 1, 1, 10, 10, 10, 1.5), (1, 5, 2, 2, 30, 10, 20, 2.0), (1, 12, 3, 2, 30, 10, 20, 2.5), (1, 30, 3, 2, 80, 20, 60, 4.166666666666667), (2, 3, 1, 1, 40, 40, 40, 4.5), (2, 21, 2, 2, 90, 40, 50, 5.0)])
    for keys, n in ((["c0"], 0), ([], 100), ([], 0), ([], 2)):
        plan = p.window_sliding(keys, "c1", n, FRAME)
        same(t.run(plan), t.golden(plan))
    q = t.add("n", [I32, I64, I64], [(1, 5, 10), (1, 0, 20), (1, N, 30), (1, 12, 40), (2, 3, 50), (2, N, 60), (2, 9, 70)])
    same([(r[0], r[1], *r[3:]) for r in t.run(q.window_sliding(["c0"], "c1", 1, [count_star("n"), sum_("c2", "s"), min_("c2", "lo"), avg("c2", "a")]))], [(1, 0, 1, 20, 20, 20.0), (1, 5, 2, 30, 10, 15.0), (1, 12, 2, 50, 10, 25.0), (1, N, 2, 70, 30, 35.0), (2, 3, 1, 50, 50, 50.0), (2, 9, 2, 120, 50, 60.0), (2, N, 2, 130, 60, 65.0)])


@pytest.mark.parametrize("preceding", [1, 7, 60])
def test_sliding_without_keys_over_many_ranges(spark, preceding):
    t = Tables(spark)
    p = t.add("t", [I64, I64], [((i * 37) % 211, i) for i in range(211)])
    plan = p.window_sliding([], "c0", preceding, [count_star("n"), sum_("c1", "s"), min_("c1", "lo")])
    same(t.run(plan), t.golden(plan))


def test_printing_and_validation():
    from tidewake.plans.plan import scan

    trips = scan("trips", [("km", F64), ("seats", I32), ("city", STR), ("left", TS)])
    far = trips.filter(gt(col(F64, 0), lit(F64, 12.5)))
    lines = str(far.project([("place", col(STR, 2)), ("twice", add(col(I32, 1), col(I32, 1)))])).splitlines()
    assert lines == ["Project [place=city, twice=(seats + seats)]", "  Filter (km > 12.5)", "    Scan [km:F64, seats:I32, city:STR, left:TS]"]
    lines = str(far.aggregate(["city"], [max_("km", "most"), count("seats", "n")]).sort([SortKey("n"), SortKey("most", True, True)])).splitlines()
    assert lines[:2] == ["Sort [2 ASC NULLS LAST, 1 DESC NULLS FIRST]", "  Aggregate keys=[city] aggs=[MAX(km) AS most, COUNT(seats) AS n]"] and len(lines) == 4
    lines = str(trips.join(far, ["city"], ["city"], "left")).splitlines()
    assert lines[0] == "Join LEFT left_keys=[2] right_keys=[2]" and [x[:6] for x in lines[1:]] == ["  Scan", "  Filt", "    Sc"]
    p = scan("t", [("c0", I32), ("c1", I64)])
    assert str(p.aggregate(["c0"], [count_star("n")])) == str(p.aggregate([0], [count_star("n")]))
    for bad in (lambda: p.filter(col(I32, 0)), lambda: p.aggregate(["nope"], [count_star("n")]), lambda: p.sort([9]), lambda: p.sort([]), lambda: p.aggregate([0], []), lambda: p.join(p, [0], [1]), lambda: p.join(p, [], []), lambda: p.filter(gt(col(I32, 1), lit(I32, 0))), lambda: p.window_tumbling([], "c0", 0, [count_star("n")]), lambda: p.window_sliding([], "c0", -1, [count_star("n")]), lambda: compressed_scan("t", [("s", STR)]), lambda: scan("s", [("s", STR)]).aggregate([], [sum_("s", "x")]), lambda: p.project([])):
        with pytest.raises(ValueError):
            bad()


def test_mutants_are_seen(spark):
    """A wrong plan must differ from the right one's SQL: the comparison has teeth."""
    t = Tables(spark)
    p, b = t.add("p", [I32, TS], PROBE), t.add("b", [I32, TS, I64], BUILD)
    s = t.add("s", [I32, TS, I64, F64], A7)
    n = t.add("n", [I32, I32], [(1, N), (1, 3), (2, 5), (N, 8)])
    asof = lambda **k: p.asof_join(b, ["c0"], ["c0"], "c1", "c1", **k)
    pairs = [
        (asof(how="left", tolerance=10), asof(how="left", tolerance=9 + 21)),
        (asof(how="inner"), asof(how="left")),
        (s.window_sliding(["c0"], "c1", 2, FRAME), s.window_sliding(["c0"], "c1", 1, FRAME)),
        (s.window_tumbling(["c0"], "c1", 10, FRAME), s.window_tumbling(["c0"], "c1", 12, FRAME)),
        (n.sort([SortKey("c1")]), n.sort([SortKey("c1", True)])),
        (n.sort([SortKey("c1", False, True)]), n.sort([SortKey("c1")])),
        (n.join(n, [0], [0], "left"), n.join(n, [0], [0])),
        (n.aggregate(["c0"], [count("c1", "n")]), n.aggregate(["c0"], [count_star("n")])),
        (n.filter(gt(col(I32, 1), lit(I32, 3))), n.filter(lt(lit(I32, 2), col(I32, 1)))),
    ]
    for right, wrong in pairs:
        assert not differences(t.run(right), t.golden(right), ordered=right.node.kind == "sort")
        assert differences(t.run(wrong), t.golden(right), ordered=right.node.kind == "sort")
