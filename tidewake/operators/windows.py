"""Time windows.

Tumbling buckets are arithmetic, so that they truncate towards zero and a null time is a bucket of its own. Sliding
frames are native row frames. Without keys a sliding frame would put all rows in one task; they are dealt to ranges of
time instead, and each range also gets the last rows before it that its first frames reach back to. So are the rows of a
key that has too many for one task (see crowds.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import crowds
from tidewake.plans.plan import Node


def tumbling(df: DataFrame, node: Node, aggregate: Callable) -> DataFrame:
    t = node.times[0]
    kind = node.children[0].schema[t].type.spark
    width = F.lit(node.number).cast("bigint")
    bucket = (F.call_function("div", F.col(f"o{t}").cast("bigint"), width) * width).cast(kind)
    n = len(node.keys)
    keys = [F.col(f"o{k}").alias(f"k{i}") for i, k in enumerate(node.keys)]
    made = df.groupBy(*keys, bucket.alias(f"k{n}")).agg(*[aggregate(a, node).alias(f"a{i}") for i, a in enumerate(node.aggs)])
    return made.toDF(*[f"o{i}" for i in range(len(made.columns))])


def sliding(df: DataFrame, node: Node, aggregate: Callable) -> DataFrame:
    width = len(df.columns)
    time = F.col(f"o{node.times[0]}").asc_nulls_last()
    keys = [f"o{k}" for k in node.keys]
    if keys and crowds.possible(df):
        dealt = _dealt_by_key(df, keys, f"o{node.times[0]}", node.number)
        frame = Window.partitionBy(*keys, "p_").orderBy(time).rowsBetween(-node.number, Window.currentRow)
        made = dealt.select("*", *[aggregate(a, node, frame).alias(f"o{width + i}") for i, a in enumerate(node.aggs)])
        return made.filter("NOT guest_").drop("p_", "guest_")
    if keys:
        frame = Window.partitionBy(*keys).orderBy(time).rowsBetween(-node.number, Window.currentRow)
        return df.select("*", *[aggregate(a, node, frame).alias(f"o{width + i}") for i, a in enumerate(node.aggs)])
    dealt = _dealt(df, node.times[0], node.number)
    frame = Window.partitionBy("p_").orderBy(time).rowsBetween(-node.number, Window.currentRow)
    made = dealt.select("*", *[aggregate(a, node, frame).alias(f"o{width + i}") for i, a in enumerate(node.aggs)])
    return made.filter("NOT guest_").drop("p_", "guest_")


def _dealt(df: DataFrame, time: int, preceding: int) -> DataFrame:
    """df with p_, a range of time, and for each range copies (guest_) of the `preceding` rows before it.

    Rows are numbered within their ranges; a range's first rows are known by the sizes of those before it, one number a
    range.
    """
    spark, t = df.sparkSession, f"o{time}"
    parts = min(crowds.RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    limits = sorted(set(df.agg(F.percentile_approx(F.col(t).cast("bigint"), F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000).alias("q")).first()["q"] or [])) if parts > 1 else []
    bounds = F.array(*[F.lit(x) for x in limits]).cast("array<bigint>")
    last = len(limits)
    ranged = df.withColumn("p_", crowds.range_of(F.col(t), bounds) if limits else F.lit(0))
    sizes = {r["p_"]: r["n"] for r in ranged.groupBy("p_").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    # row n from the end of range p is a guest of each later range q while fewer than `preceding` rows lie between
    between, targets = {}, []
    for p in range(last + 1):
        gap, reach = 0, []
        for q in range(p + 1, last + 1):
            if gap >= preceding:
                break
            reach.append((q, preceding - gap))
            gap += sizes.get(q, 0)
        between[p] = reach
        targets.append("array(" + ", ".join(f"struct({q} AS q, {n} AS n)" for q, n in reach) + ")" if reach else "CAST(array() AS array<struct<q:int,n:int>>)")
    back = Window.partitionBy("p_").orderBy(F.col(t).desc_nulls_first())
    numbered = ranged.withColumn("b_", F.row_number().over(back))
    reach = F.expr(f"array({', '.join(targets)})[p_]")
    guests = F.transform(F.filter(reach, lambda x: F.col("b_") <= x["n"]), lambda x: F.struct(x["q"].alias("q"), F.lit(True).alias("g")))
    all_of = F.concat(F.array(F.struct(F.col("p_").alias("q"), F.lit(False).alias("g"))), guests)
    return numbered.withColumn("d_", F.explode(all_of)).select(*df.columns, F.col("d_.q").alias("p_"), F.col("d_.g").alias("guest_"))


def _dealt_by_key(df: DataFrame, keys: list[str], t: str, preceding: int) -> DataFrame:
    """As _dealt, for each key of many rows apart; the rows of other keys are one range. A null key is a key too."""
    bounds = crowds.limits(df, keys, t)
    named = [F.col(k).alias(f"b_{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    ranged = df.join(bounds.select(*named, F.col("limits").alias("l_")), same, "left")
    ranged = ranged.withColumn("p_", F.when(F.col("l_").isNull(), F.lit(0)).otherwise(crowds.range_of(F.col(t), F.col("l_"))))
    crowd = ranged.filter(F.col("l_").isNotNull())
    # upto_: how many rows a crowded key has up to and with each range, so as many numbers as it has ranges
    sizes = crowd.groupBy(*keys, "p_").agg(F.count(F.lit(1)).alias("n_"), F.first("l_").alias("l_"))
    listed = sizes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("p_", "n_"))).alias("of_"), F.size(F.first("l_")).alias("last_"))
    counts = listed.withColumn("each_", F.expr("transform(sequence(0, last_), p -> coalesce(of_[p], 0L))"))
    upto = counts.select(*named, F.expr("transform(each_, (n, p) -> aggregate(slice(each_, 1, p + 1), 0L, (a, x) -> a + x))").alias("upto_"))
    back = Window.partitionBy(*keys, "p_").orderBy(F.col(t).desc_nulls_first())
    # only the last rows of a range are copied: row b_ from its end is a guest of each later range before which it is among the last `preceding` ones
    numbered = crowd.withColumn("b_", F.row_number().over(back)).filter(F.col("b_") <= preceding)
    last = numbered.drop(*[f"b_{k}" for k in keys]).join(upto, same)
    reach = F.expr(f"filter(sequence(p_ + 1, size(upto_) - 1, 1), q -> upto_[q - 1] - upto_[p_] + b_ <= {preceding})")
    guests = last.filter("p_ < size(upto_) - 1").withColumn("q_", F.explode(reach)).select(*df.columns, F.col("q_").alias("p_"), F.lit(True).alias("guest_"))
    return ranged.select(*df.columns, "p_", F.lit(False).alias("guest_")).unionByName(guests)
