"""Data frames as tables of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.types import Schema, Type, of_spark


def schema_of(df: DataFrame) -> Schema:
    return Schema((f.name, of_spark(f.dataType)) for f in df.schema)


def positional(df: DataFrame, schema: Schema) -> DataFrame:
    """The schema's columns of df as o0, o1, ...: by name where df has each name once, else by place.

    Timestamps become nanoseconds since the epoch (TS), local ones as if in UTC.
    """
    by_name = len(set(df.columns)) == len(df.columns) and all(f.name in df.columns for f in schema)
    if not by_name and len(df.columns) != len(schema):
        raise ValueError(f"columns {df.columns} don't fit {schema}")
    if not by_name:
        df = df.toDF(*[f"p{i}" for i in range(len(schema))])
    out = []
    for i, f in enumerate(schema):
        name = f.name if by_name else f"p{i}"
        kind, c = df.schema[name].dataType, df[f"`{name}`"]
        if of_spark(kind) is not f.type and (of_spark(kind), f.type) != (Type.I64, Type.TS):  # a TS column as the long that it is
            raise ValueError(f"column {name} is {kind.simpleString()}, not {f.type.name}")
        if isinstance(kind, T.TimestampNTZType):
            # from its fields, so that the session's time zone has no say
            days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
            second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
            c = (((days * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + second) * 1000
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c) * 1000
        out.append(c.cast(f.type.spark).alias(f"o{i}"))
    return df.select(*out)


def load(spark: SparkSession, folder: str, names: list[str] | tuple[str, ...]) -> dict[str, DataFrame]:
    """Parquet tables by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
