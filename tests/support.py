"""One plan over literal rows, in Spark and in DuckDB."""

from __future__ import annotations

import duckdb
import pyarrow as pa

from tidewake.operators.lower import to_df
from tidewake.plans.plan import Plan, scan
from tidewake.plans.sql import to_sql
from tidewake.types import Type

ARROW = {Type.I32: pa.int32(), Type.I64: pa.int64(), Type.F64: pa.float64(), Type.BOOL: pa.bool_(), Type.TS: pa.int64(), Type.STR: pa.string()}


def rows(*columns: list) -> list[tuple]:
    return list(zip(*columns, strict=True))


class Tables:
    def __init__(self, spark):
        self.spark, self.frames, self.duck = spark, {}, duckdb.connect()

    def add(self, name: str, kinds: list[Type], data: list[tuple], prefix: str = "c") -> Plan:
        schema = [(f"{prefix}{i}", k) for i, k in enumerate(kinds)]
        self.frames[name] = self.spark.createDataFrame(data, ", ".join(f"{n} {k.spark}" for n, k in schema))
        columns = list(zip(*data, strict=True)) if data else [[] for _ in kinds]
        table = pa.table([pa.array(list(c), ARROW[k]) for c, (_, k) in zip(columns, schema, strict=True)], [n for n, _ in schema])
        self.duck.register(f"{name}_arrow", table)
        self.duck.sql(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
        return scan(name, schema)

    def run(self, plan: Plan) -> list[tuple]:
        return [tuple(r) for r in to_df(plan, self.spark, self.frames).collect()]

    def golden(self, plan: Plan) -> list[tuple]:
        return self.duck.sql(to_sql(plan)).fetchall()
