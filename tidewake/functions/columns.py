"""Expressions as Spark columns over o0, o1, ...; to be built while session.wrapping() holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.types import RANGES, Type

from .expr import COMPARISON, Expr

_OPS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "mod": lambda a, b: a % b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}


def column(e: Expr) -> Column:
    if e.kind == "column":
        return F.col(f"o{e.value}")
    if e.kind == "literal":
        return F.lit(e.value).cast(e.type.spark)
    a = [column(x) for x in e.args]
    if e.kind == "not":
        return ~a[0]
    if e.kind == "is_null":
        return a[0].isNull()
    if e.kind == "cast":
        return _cast(a[0], e.args[0].type, e.type)
    if e.kind == "div":
        # int division truncates; F64 / 0 is null without ANSI
        return a[0] / a[1] if e.type is Type.F64 else F.call_function("div", *a).cast(e.type.spark)
    out = _OPS[e.kind](*a)
    if e.kind in COMPARISON and e.args[0].type is Type.F64:
        # Spark holds NaN equal to itself and greater than all; here only != is true of it
        odd = F.isnan(a[0]) | F.isnan(a[1])
        out = F.when(~(a[0].isNull() | a[1].isNull()), out | odd if e.kind == "ne" else out & ~odd)
    return out


def _cast(x: Column, source: Type, to: Type) -> Column:
    if to is Type.BOOL:
        return x != F.lit(0)
    if source is Type.F64:
        low, high = RANGES[to]
        whole = F.round(x)  # half away from zero
        return F.when(~F.isnan(x) & (whole >= F.lit(float(low))) & (whole < F.lit(float(high))), whole.cast(to.spark))
    if to is Type.I32 and source in (Type.I64, Type.TS):
        low, high = RANGES[to]
        return F.when((x >= F.lit(low)) & (x < F.lit(high)), x.cast("int"))
    return x.cast(to.spark)


def truth(e: Expr) -> Column:
    """A column that is true where e is; where e is false or null it is either.

    That is all a filter asks, and it leaves comparisons bare, so that they reach the scan. As NaN is Spark's greatest
    value, `<` needs a guard on its right side only, `>` on its left side, `=` and `!=` on one of the two.
    """
    if e.kind in ("and", "or"):
        return _OPS[e.kind](truth(e.args[0]), truth(e.args[1]))
    if e.kind not in COMPARISON or e.args[0].type is not Type.F64:
        return column(e)
    a, b = map(column, e.args)
    sure = [x.kind == "literal" and x.value == x.value for x in e.args]
    out = _OPS[e.kind](a, b)
    if e.kind == "ne":
        return out if any(sure) else out | (F.isnan(a) & F.isnan(b))
    if e.kind == "eq":
        return out if any(sure) else out & ~F.isnan(a)
    side = 1 if e.kind in ("lt", "le") else 0
    return out if sure[side] else out & ~F.isnan((a, b)[side])
