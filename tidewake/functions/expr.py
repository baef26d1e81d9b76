"""Typed expressions: built and checked without execution, rendered to Spark columns or to SQL."""

from __future__ import annotations

from dataclasses import dataclass

from tidewake.types import NUMERIC, Schema, Type, promoted

ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}
COMPARISON = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}


@dataclass(frozen=True)
class Expr:
    kind: str  # column, literal, is_null, cast, and, or, not, or a key of the tables above
    type: Type
    args: tuple[Expr, ...] = ()
    value: object = None  # a column's index, a literal's value

    def text(self, schema: Schema) -> str:
        a = [x.text(schema) for x in self.args]
        if self.kind == "column":
            return schema[self.value].name if self.value < len(schema) else f"c?{self.value}"
        if self.kind == "literal":
            if self.value is None:
                return f"NULL:{self.type.name}"
            return str(self.value).lower() if self.type is Type.BOOL else f"{self.value:g}" if self.type is Type.F64 else str(self.value)
        if self.kind == "cast":
            return f"CAST({a[0]} AS {self.type.name})"
        if self.kind == "not":
            return f"(NOT {a[0]})"
        if self.kind == "is_null":
            return f"({a[0]} IS NULL)"
        return f"({a[0]} {(ARITHMETIC | COMPARISON).get(self.kind) or self.kind.upper()} {a[1]})"

    def check(self, schema: Schema) -> Expr:
        """Itself, if its columns are in the schema with their types."""
        if self.kind == "column" and schema[schema.index(self.value)].type is not self.type:
            raise ValueError(f"column {self.value} is {schema[self.value].type.name}, not {self.type.name}")
        for x in self.args:
            x.check(schema)
        return self


def col(where: Type | Schema, ref: int | str) -> Expr:
    """A column by type and index, or by schema and name or index."""
    if isinstance(where, Type):
        return Expr("column", where, value=ref)
    i = where.index(ref)
    return Expr("column", where[i].type, value=i)


def lit(kind: Type, value: object = None) -> Expr:
    """A literal; None is a typed null."""
    if value is not None:
        value = {Type.BOOL: bool, Type.F64: float, Type.STR: str}.get(kind, int)(value)
    return Expr("literal", kind, value=value)


def cast(e: Expr, to: Type) -> Expr:
    if e.type is to:
        return e
    if Type.STR in (e.type, to):
        raise ValueError(f"no cast from {e.type.name} to {to.name}")
    return Expr("cast", to, (e,))


def _arithmetic(kind: str):
    def build(a: Expr, b: Expr) -> Expr:
        to = promoted(a.type, b.type)
        return Expr(kind, to, (cast(a, to), cast(b, to)))

    return build


def _comparison(kind: str):
    def build(a: Expr, b: Expr) -> Expr:
        if a.type in NUMERIC and b.type in NUMERIC:
            to = promoted(a.type, b.type)
            a, b = cast(a, to), cast(b, to)
        elif a.type is not b.type:
            raise ValueError(f"{a.type.name} and {b.type.name} don't compare")
        return Expr(kind, Type.BOOL, (a, b))

    return build


add, sub, mul, div, mod = map(_arithmetic, ARITHMETIC)
lt, le, gt, ge, eq, ne = map(_comparison, COMPARISON)


def _logic(kind: str, *args: Expr) -> Expr:
    for a in args:
        if a.type is not Type.BOOL:
            raise ValueError(f"{kind} takes BOOL, not {a.type.name}")
    return Expr(kind, Type.BOOL, args)


def logic_and(a: Expr, b: Expr) -> Expr:
    return _logic("and", a, b)


def logic_or(a: Expr, b: Expr) -> Expr:
    return _logic("or", a, b)


def logic_not(a: Expr) -> Expr:
    return _logic("not", a)


def is_null(a: Expr) -> Expr:
    return Expr("is_null", Type.BOOL, (a,))
