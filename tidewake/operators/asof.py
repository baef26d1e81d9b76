"""As-of joins, backward and inclusive, with one exchange and one sort.

Build rows and probe rows are put in one table and ordered by time in each group of keys, build rows first at equal
times; the last build row seen is a probe row's match. Build rows that tie on keys and time are ordered by their
columns, so the greatest one is taken.

Without keys there is no group to deal by. Then time itself is dealt to ranges whose limits come from a quantile sketch
of the build times; each range starts from the last build row of those before it, one row a range, so no task has all
rows. With keys, a key of more than CROWD rows is dealt to ranges of its own times in the same way (see crowds.py). Rows
with a null key or time match nothing and are dealt anyhow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import crowds
from tidewake.plans.plan import Node


def asof_join(probe: DataFrame, build: DataFrame, node: Node, width: int) -> DataFrame:
    """probe has columns o0.., build has columns o{width}.., as the result."""
    t, u = node.times
    build_columns = build.columns
    some = [F.col(f"o{width + k}").isNotNull() for k in node.right_keys] + [F.col(f"o{width + u}").isNotNull()]
    present = some[0]
    for c in some[1:]:
        present &= c
    keys = [f"k{i}" for i in range(len(node.keys))]
    right = build.filter(present).select(*[F.col(f"o{width + b}").alias(k) for k, b in zip(keys, node.right_keys, strict=True)], F.col(f"o{width + u}").alias("t"), F.lit(0).alias("side"), F.struct(*build_columns).alias("r"))
    left = probe.select(*[F.col(f"o{a}").alias(k) for k, a in zip(keys, node.keys, strict=True)], F.col(f"o{t}").alias("t"), F.lit(1).alias("side"), F.struct(*probe.columns).alias("l"))
    both = left.withColumn("r", F.lit(None).cast(right.schema["r"].dataType)).unionByName(right.withColumn("l", F.lit(None).cast(left.schema["l"].dataType)))
    if not keys:
        last = _last_in_ranges(both, right)
    elif crowds.possible(probe, build):
        last = _last_split(both, keys)
    else:
        last = _last(both, keys).withColumn("carry", F.lit(None).cast(right.schema["r"].dataType))
    near = F.coalesce("m", "carry")
    seen = last.filter("side = 1").withColumn("m", near)
    ok: Column = F.col("t").isNotNull()
    for k in keys:
        ok &= F.col(k).isNotNull()
    if node.number is not None:
        # a difference beyond 2^63 - 1 wraps to a negative one
        apart = F.col("t").cast("bigint") - F.col(f"m.o{width + u}").cast("bigint")
        ok &= (apart >= 0) & (apart <= F.lit(node.number))
    seen = seen.withColumn("m", F.when(ok, F.col("m")))
    if node.how == "inner":
        seen = seen.filter("m IS NOT NULL")
    return seen.select("l.*", *[F.col(f"m.{c}").alias(c) for c in build_columns])


def _last(both: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("t").asc_nulls_last(), "side", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("m", F.last("r", ignorenulls=True).over(order))


def _last_split(both: DataFrame, keys: list[str]) -> DataFrame:
    """m as in _last, within ranges of time for keys of many rows; carry: the last build row of a key's ranges before."""
    idle = F.col("t").isNull()
    for k in keys:
        idle |= F.col(k).isNull()
    bounds = crowds.limits(both.filter(~idle), keys, "t")
    named = [F.col(k).alias(f"b_{k}") for k in keys]
    limits = bounds.select(*named, "limits")
    same = [F.col(k) == F.col(f"b_{k}") for k in keys]
    dealt = both.join(limits, same, "left")
    part = F.when(idle, F.pmod(F.xxhash64("t", "l"), F.lit(4096)).cast("int")).when(F.col("limits").isNull(), F.lit(0)).otherwise(crowds.range_of(F.col("t"), F.col("limits")))
    dealt = dealt.withColumn("p", part)
    ends = dealt.filter(F.col("limits").isNotNull() & (F.col("side") == 0) & ~idle).groupBy(*keys, "p").agg(F.max(F.struct("t", "r")).alias("e"))
    ranges = bounds.select(*keys, F.explode(F.sequence(F.lit(0), F.size("limits"))).alias("p"))
    # a row for each range of a crowded key
    earlier = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.join(ends, [*keys, "p"], "left").select(*named, F.col("p").alias("q"), F.last("e.r", ignorenulls=True).over(earlier).alias("carry"))
    last = _last(dealt.drop("limits", *[f"b_{k}" for k in keys]), [*keys, "p"])
    return last.join(carried, [*same, F.col("p") == F.col("q")], "left")


def _last_in_ranges(both: DataFrame, right: DataFrame) -> DataFrame:
    parts = min(crowds.RANGES, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limits = sorted(set(right.agg(F.percentile_approx("t", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000).alias("q")).first()["q"] or [])) if parts > 1 else []
    # a null time matches nothing, whichever range it is in
    part = crowds.range_of(F.col("t"), F.array(*[F.lit(x) for x in limits]).cast("array<bigint>")) if limits else F.lit(0)
    dealt = both.withColumn("p", part)
    last = _last(dealt, ["p"])
    ends = dealt.filter("side = 0").groupBy("p").agg(F.max(F.struct("t", "r")).alias("e"))
    # one row for each range
    before = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    numbers = both.sparkSession.range(0, len(limits) + 1, 1, 1).select(F.col("id").cast("int").alias("q"))
    carried = numbers.join(ends, F.col("q") == F.col("p"), "left").select("q", F.last("e.r", ignorenulls=True).over(before).alias("carry"))
    return last.join(F.broadcast(carried), F.col("p") == F.col("q"))
