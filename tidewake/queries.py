"""The engine's queries: each is one plan, run by Spark and rendered to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewake.functions.expr import add, cast, col, div, eq, ge, gt, is_null, le, lit, logic_and, logic_not, logic_or, lt, mod, mul, ne, sub
from tidewake.operators.lower import to_df
from tidewake.plans.plan import Node, Plan, SortKey, avg, compressed_scan, count, count_star, max_, min_, scan, sum_
from tidewake.plans.sql import to_sql
from tidewake.session import shared_folder
from tidewake.sources import compressed
from tidewake.sources.tables import load
from tidewake.types import Schema, Type

I32, I64, F64, BOOL, TS, STR = Type
TABLES = {
    "region": [("r_regionkey", I32), ("r_name", STR)],
    "nation": [("n_nationkey", I32), ("n_name", STR), ("n_regionkey", I32)],
    "customer": [("c_custkey", I64), ("c_name", STR), ("c_nationkey", I32), ("c_acctbal", F64), ("c_mktsegment", STR)],
    "supplier": [("s_suppkey", I64), ("s_name", STR), ("s_nationkey", I32), ("s_acctbal", F64)],
    "part": [("p_partkey", I64), ("p_name", STR), ("p_brand", STR), ("p_type", STR), ("p_size", I32), ("p_retailprice", F64)],
    "orders": [("o_orderkey", I64), ("o_custkey", I64), ("o_orderstatus", STR), ("o_totalprice", F64), ("o_orderdate", TS), ("o_orderpriority", STR)],
    "lineitem": [("l_orderkey", I64), ("l_partkey", I64), ("l_suppkey", I64), ("l_linenumber", I32), ("l_quantity", F64), ("l_extendedprice", F64), ("l_discount", F64), ("l_tax", F64), ("l_returnflag", STR), ("l_linestatus", STR), ("l_shipdate", TS)],
    "events": [("event_id", I64), ("ts", TS), ("user_id", I64), ("event_type", STR), ("value", F64)],
}
#: Columns of events that the compressed copy has.
TICKS = [f for f in TABLES["events"] if f[1] is not STR]
VIEWS = {"orders": "SELECT * REPLACE (epoch_us(o_orderdate) * 1000 AS o_orderdate) FROM orders", "lineitem": "SELECT * REPLACE (epoch_us(l_shipdate) * 1000 AS l_shipdate) FROM lineitem", "events": "SELECT * REPLACE (epoch_us(ts) * 1000 AS ts) FROM events"}
HOUR = 3_600_000_000_000


def table(name: str) -> Plan:
    return scan(name, TABLES[name])


def of(plan: Plan, name: str):
    """A column of a plan by name."""
    return col(plan.schema, name)


def pick(plan: Plan, *names: str) -> Plan:
    return plan.project([(n, of(plan, n)) for n in names])


def _renamed(plan: Plan, prefix: str) -> Plan:
    return plan.project([(prefix + f.name, col(f.type, i)) for i, f in enumerate(plan.schema)])


def plans() -> dict[str, Plan]:
    out: dict[str, Plan] = {}
    li, od, cu, na, ev, pa, su = (table(t) for t in ("lineitem", "orders", "customer", "nation", "events", "part", "supplier"))
    c = lambda n: of(li, n)
    i32, i64, f64 = (lambda v: lit(I32, v)), (lambda v: lit(I64, v)), (lambda v: lit(F64, v))

    out["filter_group_sort"] = li.filter(gt(c("l_quantity"), f64(0))).aggregate(["l_suppkey"], [count_star("n"), sum_("l_quantity", "s"), min_("l_quantity", "lo"), max_("l_quantity", "hi")]).sort(["l_suppkey"])
    out["scan_identity"] = na
    keys = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    for name, op in (("lt", lt), ("le", le), ("gt", gt), ("ge", ge), ("eq", eq), ("ne", ne)):
        out[f"filter_cmp_{name}"] = pick(li.filter(logic_and(op(c("l_quantity"), f64(25)), op(c("l_linenumber"), i64(3)))), *keys)
    out["filter_and_or_not"] = pick(li.filter(logic_or(logic_and(gt(c("l_quantity"), f64(40)), logic_not(eq(c("l_returnflag"), lit(STR, "R")))), lt(c("l_linenumber"), i32(2)))), *keys)
    out["filter_null_predicate"] = pick(li.filter(logic_or(lit(BOOL), gt(c("l_quantity"), f64(45)))), *keys)
    out["filter_str_cmp"] = pick(li.filter(lt(c("l_returnflag"), c("l_linestatus"))), "l_orderkey", "l_returnflag", "l_linestatus")
    out["filter_ts_cmp"] = pick(od.filter(ge(of(od, "o_orderdate"), lit(TS, 820_454_400_000_000_000))), "o_orderkey", "o_orderdate")
    n, q = c("l_linenumber"), c("l_quantity")
    out["project_arith"] = li.project([("a", add(n, i32(7))), ("b", sub(c("l_orderkey"), n)), ("m", mul(n, i64(3))), ("f", add(mul(q, f64(2)), n)), ("g", sub(n, q))])
    out["project_int_div_mod"] = li.project([("d", div(sub(i32(0), c("l_linenumber")), i32(2))), ("m", mod(sub(i64(3), c("l_orderkey")), i64(7))), ("f", mod(q, f64(7)))])
    zero = sub(n, i32(1))
    out["project_div_zero"] = li.project([("k", c("l_orderkey")), ("d", div(c("l_orderkey"), zero)), ("m", mod(n, zero))])
    out["project_float_div_zero"] = li.project([("k", c("l_orderkey")), ("d", div(q, cast(zero, F64)))])
    out["project_wrap_i32"] = li.project([("a", add(n, i32(2_147_483_645))), ("s", sub(i32(-2_147_483_646), n)), ("m", mul(mul(n, i32(65_536)), i32(32_769))), ("w", mul(c("l_orderkey"), i64(9_223_372_036_854_775_807)))])
    out["project_cast_widen"] = li.project([("a", cast(n, I64)), ("b", cast(n, F64)), ("d", cast(c("l_orderkey"), F64)), ("t", cast(n, TS))])
    out["project_cast_round"] = li.project([("i", cast(div(q, f64(4)), I32)), ("l", cast(sub(f64(0), div(q, f64(4))), I64)), ("t", cast(c("l_extendedprice"), TS))])
    big = mul(q, f64(1e8))
    out["project_cast_oor"] = li.project([("i", cast(big, I32)), ("n", cast(mul(c("l_orderkey"), i64(1_000_000)), I32)), ("l", cast(mul(big, f64(1e10)), I64))])
    out["project_cast_bool"] = li.project([("b", cast(zero, BOOL)), ("f", cast(sub(q, f64(5)), BOOL)), ("i", cast(gt(q, f64(20)), I32)), ("d", cast(gt(q, f64(20)), F64))])
    out["project_is_null"] = li.project([("k", c("l_orderkey")), ("x", is_null(div(n, zero)))])
    out["join_inner"] = pick(cu.join(od, ["c_custkey"], ["o_custkey"]), "c_custkey", "c_name", "o_orderkey", "o_totalprice")
    out["join_left"] = pick(cu.join(od.filter(gt(of(od, "o_totalprice"), f64(150_000))), ["c_custkey"], ["o_custkey"], "left"), "c_custkey", "c_name", "o_orderkey", "o_orderdate")
    pairs = li.aggregate(["l_partkey", "l_suppkey"], [count_star("pairs")])
    out["join_composite"] = pick(li.join(_renamed(pairs, "p_"), ["l_partkey", "l_suppkey"], ["p_l_partkey", "p_l_suppkey"]), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_pairs")
    kinds = _renamed(ev.aggregate(["event_type"], [count_star("n"), max_("value", "most")]), "k_")
    out["join_str_key"] = pick(ev.join(kinds, ["event_type"], ["k_event_type"]), "event_id", "event_type", "k_n", "k_most")
    out["join_fanout"] = pick(na.join(cu, ["n_nationkey"], ["c_nationkey"]), "n_name", "c_custkey")
    # dear orders only, so that some customers have one and some have none
    dear = od.filter(gt(of(od, "o_totalprice"), f64(450_000)))
    out["join_semi"] = pick(cu.join(dear, ["c_custkey"], ["o_custkey"], "semi"), "c_custkey")
    out["join_anti"] = pick(cu.join(dear, ["c_custkey"], ["o_custkey"], "anti"), "c_custkey")
    every = [count_star("n"), count("l_partkey", "c"), sum_("l_quantity", "s"), min_("l_extendedprice", "lo"), max_("l_extendedprice", "hi"), avg("l_linenumber", "a")]
    out["agg_global"] = li.aggregate([], every)
    out["agg_global_empty"] = li.filter(lt(q, f64(0))).aggregate([], every)
    out["agg_keyed_empty"] = li.filter(lt(q, f64(0))).aggregate(["l_returnflag"], every)
    out["agg_group_count_sum_min_max_avg"] = li.aggregate(["l_returnflag", "l_linestatus"], every)
    out["agg_minmax_str"] = cu.aggregate(["c_nationkey"], [min_("c_name", "lo"), max_("c_mktsegment", "hi"), count("c_name", "n")])
    out["agg_str_key"] = cu.aggregate(["c_mktsegment"], [count_star("n"), min_("c_custkey", "lo")])
    big_order = od.project([("p", of(od, "o_orderpriority")), ("b", gt(of(od, "o_totalprice"), f64(100_000)))])
    out["agg_bool"] = big_order.aggregate(["p"], [sum_("b", "s"), avg("b", "a"), min_("b", "lo"), max_("b", "hi"), count("b", "n")])
    out["agg_ts"] = od.aggregate(["o_orderstatus"], [min_("o_orderdate", "lo"), max_("o_orderdate", "hi"), count("o_orderdate", "n")])
    out["agg_avg_int"] = li.aggregate(["l_suppkey"], [avg("l_orderkey", "a"), avg("l_linenumber", "b")])
    out["agg_distinct_emulation"] = pick(na, "n_regionkey").distinct()
    left = pick(cu.join(od.filter(gt(of(od, "o_totalprice"), f64(200_000))), ["c_custkey"], ["o_custkey"], "left"), "c_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    out["sort_asc_desc_multi"] = pick(li, "l_suppkey", "l_quantity", "l_orderkey", "l_partkey").sort([SortKey("l_suppkey"), SortKey("l_quantity", True), SortKey("l_orderkey"), SortKey("l_partkey", True)])
    out["sort_nulls_first_last"] = left.sort([SortKey("o_totalprice", True, True), SortKey("o_orderkey"), SortKey("c_custkey", True)])
    out["sort_ts"] = pick(od, "o_orderdate", "o_orderkey").sort([SortKey("o_orderdate", True), "o_orderkey"])
    out["sort_str"] = pick(pa, "p_brand", "p_name", "p_partkey").sort([SortKey("p_brand", True), "p_name", "p_partkey"])
    out["sort_f64"] = pick(pa, "p_retailprice", "p_partkey").sort([SortKey("p_retailprice"), "p_partkey"])
    out["sort_limit"] = pick(od, "o_totalprice", "o_orderkey").sort([SortKey("o_totalprice", True), "o_orderkey"]).limit(100)
    out["union_all"] = pick(su, "s_suppkey", "s_name").union_all(pick(cu, "c_custkey", "c_name"))
    frame = [count_star("n"), count("value", "c"), sum_("event_id", "s"), min_("value", "lo"), max_("value", "hi"), avg("event_id", "a")]
    out["tumbling_1key"] = ev.window_tumbling(["user_id"], "ts", HOUR, frame)
    out["tumbling_0key"] = ev.window_tumbling([], "ts", 24 * HOUR, frame)
    out["tumbling_w1"] = pick(li, "l_linenumber", "l_quantity").window_tumbling([], "l_linenumber", 1, [count_star("n"), sum_("l_quantity", "s")])
    slim = pick(ev, "event_id", "ts", "user_id", "value")
    for p in (0, 5):
        out[f"sliding_p{p}"] = slim.window_sliding(["user_id"], "ts", p, frame)
    out["sliding_0key_wide"] = slim.window_sliding([], "ts", 100, frame)
    kind = lambda k, *names: pick(ev.filter(eq(of(ev, "event_type"), lit(STR, k))), *names)
    probe, build = kind("purchase", "event_id", "user_id", "ts"), _renamed(kind("view", "event_id", "user_id", "ts", "value"), "v_")
    for name, how, tolerance in (("inner", "inner", None), ("left", "left", None), ("tol_inner", "inner", 6 * HOUR), ("tol_left", "left", 6 * HOUR)):
        out[f"asof_{name}"] = probe.asof_join(build, ["user_id"], ["v_user_id"], "ts", "v_ts", how, tolerance)
    out["asof_0key"] = probe.asof_join(build, [], [], "ts", "v_ts", "left")
    # the second key is the event's own, so that a match by user alone is often wrong
    parity = lambda p, u, k: p.project([*((f.name, col(f.type, i)) for i, f in enumerate(p.schema)), (k, mod(of(p, u), i64(3)))])
    out["asof_2key"] = parity(probe, "event_id", "g").asof_join(parity(build, "v_event_id", "v_g"), ["user_id", "g"], ["v_user_id", "v_g"], "ts", "v_ts")
    ticks = compressed_scan("events", TICKS)
    out["compressed_scan"] = ticks
    out["compressed_scan_filter_agg"] = ticks.filter(gt(of(ticks, "value"), f64(50))).aggregate(["user_id"], [count_star("n"), min_("value", "lo"), max_("ts", "hi")])
    out["deep_filter_join_agg_sort"] = li.filter(gt(q, f64(10))).join(od.filter(lt(of(od, "o_totalprice"), f64(200_000))), ["l_orderkey"], ["o_orderkey"]).aggregate(["o_orderpriority", "l_returnflag"], [count_star("n"), sum_("l_quantity", "s"), max_("o_orderdate", "hi")]).sort([SortKey("s", True), "o_orderpriority"])
    # overflow gives infinities, 0 times one NaN, x / 0.0 null: all beside plain values
    huge = mul(q, mul(f64(1e307), sub(n, i32(3))))
    nan = li.project([("k", c("l_suppkey")), ("i", c("l_orderkey")), ("j", c("l_partkey")), ("x", add(mul(huge, f64(0)), div(q, f64(4)))), ("z", div(huge, cast(zero, F64)))])
    x, z = of(nan, "x"), of(nan, "z")
    out["nan_compare"] = nan.project([("i", of(nan, "i")), ("lt", lt(x, z)), ("eq", eq(x, x)), ("ne", ne(x, x)), ("ge", ge(z, x)), ("null", is_null(z))])
    out["nan_filter"] = pick(nan.filter(logic_not(le(x, f64(5)))), "i", "j", "z")
    out["nan_min_max"] = nan.aggregate(["k"], [count_star("n"), count("x", "c"), min_("x", "lo"), max_("x", "hi"), min_("z", "zlo"), max_("z", "zhi")])
    out["nan_sort"] = nan.sort([SortKey("x", True), SortKey("z", False, True), "i", "j", "k"])
    # times around 0 and null, null keys
    seen = slim.project([("event_id", of(slim, "event_id")), ("user_id", of(slim, "user_id")), ("m", mod(of(slim, "user_id"), i64(4))), ("v", of(slim, "value"))])
    near = seen.project([("event_id", of(seen, "event_id")), ("k", div(of(seen, "user_id"), of(seen, "m"))), ("t", div(mul(sub(of(seen, "event_id"), i64(2000)), i64(7)), mod(of(seen, "event_id"), i64(11)))), ("v", of(seen, "v"))])
    out["tumbling_negative_null"] = near.window_tumbling([], "t", 500, [count_star("n"), min_("v", "lo"), max_("event_id", "hi")])
    out["tumbling_null_key"] = near.window_tumbling(["k"], "t", 5000, [count_star("n"), sum_("event_id", "s")])
    right = _renamed(near.filter(lt(of(near, "v"), f64(20))).aggregate(["k", "t"], [max_("event_id", "e")]), "r_")
    out["asof_null"] = near.asof_join(right, ["k"], ["r_k"], "t", "r_t", "left", 900)
    keyed = near.aggregate(["k"], [count_star("n")])
    out["join_null_key"] = pick(near, "event_id", "k").join(_renamed(keyed, "r_"), ["k"], ["r_k"], "left")
    out["join_agg_nulls"] = left.aggregate(["o_orderstatus"], [count_star("n"), count("o_orderkey", "c"), sum_("o_orderkey", "s"), min_("o_totalprice", "lo"), avg("o_orderkey", "a")])
    return out


def _tables(node: Node) -> set[tuple[str, str]]:
    return {(node.kind, node.table)} if node.table else set().union(*map(_tables, node.children))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = plans()[name]
        used = _tables(plan.node)
        frames = load(spark, sf_dir, [t for _, t in used])
        for kind, t in used:
            if kind == "compressed_scan":
                folder = shared_folder(spark)
                compressed.write(frames[t], folder, Schema(TICKS))
                frames[t] = compressed.read(spark, folder, Schema(TICKS))
                # times come back as the longs that they are in plans
        return to_df(plan, spark, frames)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in plans()}


def oracle_sql() -> dict[str, str]:
    return {name: to_sql(plan, VIEWS) for name, plan in plans().items()}
