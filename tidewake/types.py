"""The closed set of six types, schemas, and what they are in Spark and in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Type(Enum):
    I32 = "int"
    I64 = "bigint"
    F64 = "double"
    BOOL = "boolean"
    #: Nanoseconds since the epoch, a long: Spark's timestamps hold microseconds only.
    TS = "timestamp_ns"
    STR = "string"

    @property
    def spark(self) -> str:
        return "bigint" if self is Type.TS else self.value

    @property
    def sql(self) -> str:
        return {Type.I32: "INTEGER", Type.I64: "BIGINT", Type.F64: "DOUBLE", Type.BOOL: "BOOLEAN", Type.TS: "BIGINT", Type.STR: "VARCHAR"}[self]


NUMERIC = (Type.I32, Type.I64, Type.F64)
TIMES = (Type.I32, Type.I64, Type.TS)
RANGES = {Type.I32: (-(2**31), 2**31), Type.I64: (-(2**63), 2**63), Type.TS: (-(2**63), 2**63)}


@dataclass(frozen=True)
class Field:
    name: str
    type: Type


class Schema(tuple):
    """Fields in order; names may repeat, the first one is found by name."""

    def __new__(cls, fields: object = ()) -> Schema:
        return super().__new__(cls, (f if isinstance(f, Field) else Field(*f) for f in fields))

    def index(self, ref: int | str) -> int:  # type: ignore[override]
        if isinstance(ref, str):
            for i, f in enumerate(self):
                if f.name == ref:
                    return i
            raise ValueError(f"no column named {ref!r}")
        if not 0 <= ref < len(self):
            raise ValueError(f"no column {ref} among {len(self)}")
        return ref

    def __str__(self) -> str:
        return "[" + ", ".join(f"{f.name}:{f.type.name}" for f in self) + "]"


def promoted(a: Type, b: Type) -> Type:
    if a not in NUMERIC or b not in NUMERIC:
        raise ValueError(f"{a.name} and {b.name} are not both numeric")
    return NUMERIC[max(NUMERIC.index(a), NUMERIC.index(b))]


def of_spark(kind: T.DataType) -> Type:
    """Of a Spark column. Timestamps are taken as TS (see sources.tables)."""
    for spark, own in ((T.IntegerType, Type.I32), (T.ShortType, Type.I32), (T.ByteType, Type.I32), (T.LongType, Type.I64), (T.DoubleType, Type.F64), (T.FloatType, Type.F64), (T.BooleanType, Type.BOOL), (T.TimestampType, Type.TS), (T.TimestampNTZType, Type.TS), (T.StringType, Type.STR)):
        if isinstance(kind, spark):
            return own
    raise ValueError(f"no column type for {kind.simpleString()}")
