"""Tumbling windows over streams: late rows beyond the watermark are left out, state is dropped behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, keys: list[str], time: str, width: str, lateness: str, *aggs: Column) -> DataFrame:
    """keys, the bucket's beginning (named as time) and aggs. time is a timestamp column; width and lateness are intervals."""
    seen = stream.withWatermark(time, lateness)
    made = seen.groupBy(*keys, F.window(time, width).alias("w_")).agg(*aggs)
    return made.select(*keys, F.col("w_.start").alias(time), *[c for c in made.columns if c not in (*keys, "w_")])
