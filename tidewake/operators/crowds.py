"""Keys of so many rows that one task should not sort them all: they are dealt to ranges of time.

Whether a plan looks for such keys depends on its size alone: below FEW_BYTES, as Catalyst estimates it, no key can have
more than a task sorts with ease. Results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task sorts with ease, and bytes of input below which no key is looked at.
CROWD, FEW_BYTES = 2_000_000, 256 << 20
#: Ranges of time that a crowded key is dealt to at most.
RANGES = 4096


def possible(*tables: DataFrame) -> bool:
    return sum(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in tables) > FEW_BYTES


def limits(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys and limits (a sorted array of times, one fewer than ranges) of each key with more than CROWD rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > CROWD)
    counts = counts.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.least(F.ceil(F.col("n_") / CROWD), F.lit(RANGES)).cast("int").alias("parts_"))
    same = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]
    steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    sketch = df.select(*keys, F.col(time).cast("bigint").alias("t_")).join(counts, same).groupBy(*keys).agg(F.percentile_approx("t_", steps, 50_000).alias("q_"), F.first("parts_").alias("parts_"))
    taken = F.expr(f"array_distinct(filter(transform(sequence(1, parts_ - 1), k -> get(q_, CAST(k * {RANGES} DIV parts_ AS INT) - 1)), x -> x IS NOT NULL))")
    return sketch.select(*keys, taken.alias("limits"))


def range_of(time: Column, limits: Column) -> Column:
    """How many limits (sorted, RANGES at most) are not above a time, by binary search. A null time is above all."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(RANGES.bit_length()))])
    found = F.aggregate(halves, F.lit(0), lambda n, h: F.when(F.get(limits, n + h - 1) <= time.cast("bigint"), n + h).otherwise(n))
    return F.when(time.isNull(), F.size(limits)).otherwise(found)
