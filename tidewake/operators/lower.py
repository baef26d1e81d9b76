"""Plans to Spark data frames: declarative, one node at a time, columns named by place inside.

Nothing here runs a job but as-of joins without keys (see asof); Catalyst prunes columns, pushes filters and picks joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.columns import column, truth
from tidewake.plans.plan import Agg, Node, Plan
from tidewake.session import wrapping
from tidewake.sources.tables import positional
from tidewake.types import Type

from .asof import asof_join
from .windows import sliding, tumbling


def to_df(plan: Plan, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The plan over data frames by name, with its public column names (which may repeat)."""
    with wrapping(spark):
        return _lower(plan.node, tables).toDF(*[f.name for f in plan.schema])


def aggregate(a: Agg, node: Node, over: object = None) -> Column:
    """An aggregate; over: the window for a windowed one."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    if a.func == "count_star":
        return at(F.count(F.lit(1)))
    x, kind = F.col(f"o{a.column}"), node.children[0].schema[a.column].type
    if a.func == "count":
        return at(F.count(x))
    if a.func in ("sum", "avg"):
        if kind is Type.F64:
            return at(F.sum(x) if a.func == "sum" else F.avg(x))
        total = at(F.sum(x.cast("bigint")))  # wraps without ANSI, as the mean's sum does
        return total if a.func == "sum" else total.cast("double") / at(F.count(x))
    return at(F.min(x) if a.func == "min" else F.max(x))


def _renamed(df: DataFrame, first: int) -> DataFrame:
    return df.toDF(*[f"o{first + i}" for i in range(len(df.columns))])


def _lower(node: Node, tables: dict[str, DataFrame]) -> DataFrame:
    below = [_lower(c, tables) for c in node.children]
    width = len(node.children[0].schema) if node.children else 0
    if node.kind in ("scan", "compressed_scan"):
        return positional(tables[node.table], node.schema)
    if node.kind == "filter":
        return below[0].filter(truth(node.exprs[0]))
    if node.kind == "project":
        return below[0].select(*[column(e).alias(f"o{i}") for i, e in enumerate(node.exprs)])
    if node.kind == "aggregate":
        made = [aggregate(a, node).alias(f"a{i}") for i, a in enumerate(node.aggs)]
        keys = [f"o{k}" for k in node.keys]
        if not keys:
            return _renamed(below[0].agg(*made), 0)
        grouped = below[0].groupBy(*dict.fromkeys(keys)).agg(*made)  # a key named twice is grouped once
        return grouped.select(*[F.col(k).alias(f"o{i}") for i, k in enumerate(keys)], *[F.col(f"a{i}").alias(f"o{len(keys) + i}") for i in range(len(made))])
    if node.kind == "join":
        right = _renamed(below[1], width)
        on = None
        for a, b in zip(node.keys, node.right_keys, strict=True):
            one = below[0][f"o{a}"] == right[f"o{width + b}"]  # never null-safe: null keys match nothing
            on = one if on is None else on & one
        return below[0].join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(node.how, node.how))
    if node.kind == "asof":
        return asof_join(below[0], _renamed(below[1], width), node, width)
    if node.kind == "window" and node.how == "tumbling":
        return tumbling(below[0], node, aggregate)
    if node.kind == "window":
        return sliding(below[0], node, aggregate)
    if node.kind == "sort":
        order = [getattr(F.col(f"o{k.column}"), f"{'desc' if k.descending else 'asc'}_nulls_{'first' if k.nulls_first else 'last'}")() for k in node.sort]
        return below[0].orderBy(*order)
    if node.kind == "limit":
        return below[0].limit(node.number)
    if node.kind == "union":
        return below[0].union(below[1])
    raise ValueError(node.kind)
