"""All queries of the engine against their SQL at the smallest size, and random plans."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tests.support import Tables
from tidewake import queries
from tidewake.compare import differences
from tidewake.functions.expr import add, cast, col, ge, gt, lit, logic_and, logic_or, lt, mul, ne, sub
from tidewake.plans.plan import SortKey, avg, count, count_star, max_, min_, sum_
from tidewake.types import Type

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", list(queries.plans()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    want = duck.sql(queries.oracle_sql()[name])
    assert df.columns == want.columns
    assert not differences([tuple(r) for r in df.collect()], want.fetchall(), ordered=queries.plans()[name].node.kind == "sort")


def test_composite_join_runs_over_the_whole_table(spark, duck):
    rows = duck.sql("SELECT count(*) FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").fetchall()[0][0]
    assert queries.queries()["join_composite"](spark, DATA).count() == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("seed", range(12))
def test_random_plans(spark, seed):
    r = random.Random(seed)
    t = Tables(spark)
    kinds = [Type.I32, *r.choices([Type.I32, Type.I64, Type.F64], k=r.randint(1, 3)), Type.I64]
    limit = {Type.I32: 30_000, Type.I64: 10**9, Type.F64: 10**6}

    def value(k):
        return None if r.random() < 0.15 else (r.uniform(-1, 1) * 1000 if k is Type.F64 else r.randint(-limit[k], limit[k]))

    def table(name, n):
        return t.add(name, kinds, [(r.randint(0, 9) if r.random() > 0.15 else None, *map(value, kinds[1:-1]), i) for i in range(n)])

    p, b = table("p", 400), table("b", 40)

    def number():
        i = r.randrange(len(kinds))
        e = cast(col(kinds[i], i), Type.F64) if r.random() < 0.3 else col(kinds[i], i)
        return r.choice([add, sub])(e, lit(Type.I32, r.randint(-50, 50))) if r.random() < 0.5 else mul(e, lit(Type.I64, r.randint(-9, 9)))

    def predicate(depth=2):
        if depth and r.random() < 0.5:
            return r.choice([logic_and, logic_or])(predicate(depth - 1), predicate(depth - 1))
        return r.choice([lt, gt, ge, ne])(number(), number())

    plan = p.filter(predicate()) if r.random() < 0.7 else p
    if r.random() < 0.6:
        plan = plan.join(b, [0], [0], r.choice(["inner", "left"]))
    shape = r.randrange(3)
    if shape == 0:
        plan = plan.project([(f"x{i}", number()) for i in range(3)])
    elif shape == 1:
        ints = [i for i, f in enumerate(plan.schema) if f.type in (Type.I32, Type.I64)]
        plan = plan.aggregate([0] if r.random() < 0.8 else [], [count_star("n"), *[r.choice([count, sum_, min_, max_, avg])(r.choice(ints), f"a{i}") for i in range(3)]])
        if r.random() < 0.5 and len(plan.schema) == 5:
            plan = plan.sort([SortKey(0, r.random() < 0.5, r.random() < 0.5)])
    assert not differences(t.run(plan), t.golden(plan), ordered=plan.node.kind == "sort"), (seed, str(plan))


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewake.streaming.tumbling import tumbling

    spark.sql("SELECT k, timestamp_seconds(s) AS ts, v FROM VALUES (1, 0, 5), (1, 30, 6), (2, 61, 7), (1, 200, 8) AS t(k, s, v)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp, v int").parquet(str(tmp_path / "in"))
    query = tumbling(stream, ["k"], "ts", "1 minute", "0 seconds", F.sum("v").alias("s")).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.k, r.s) for r in spark.table("tumbled").collect()) == [(1, 8), (1, 11), (2, 7)]
