"""Compressed tables: a folder of Parquet files whose rows are encoded blocks, in any store that Spark writes to.

A block has n rows and, for each column, a bitmap and a stream (see codec), each in a column of its own, so that reading
some columns reads their streams only. Blocks are encoded and decoded where they lie, without an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.session import wrapping
from tidewake.types import Schema, Type

from . import codec
from .tables import positional, schema_of

ROWS = 1 << 16
ARROW = {Type.I32: pa.int32(), Type.I64: pa.int64(), Type.TS: pa.int64(), Type.F64: pa.float64(), Type.BOOL: pa.bool_()}
BYTES = {Type.I32: 4, Type.I64: 8, Type.TS: 8, Type.F64: 8, Type.BOOL: 1}


def encode(df: DataFrame, schema: Schema | None = None, rows: int = ROWS) -> DataFrame:
    """One row for each block of at most `rows` rows: n, v0, s0, v1, s1, ..."""
    schema = schema or schema_of(df)
    if any(f.type is Type.STR for f in schema):
        raise ValueError("STR columns are not compressed")
    kinds = [f.type for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            out: list[pa.Array] = [pa.array([table.num_rows], pa.int64())]
            for c, kind in zip(table.columns, kinds, strict=True):
                c = c.combine_chunks()
                valid = np.asarray(c.is_valid())
                values = c.drop_null().to_numpy(zero_copy_only=False)
                out += [pa.array([codec.bitmap(valid)], pa.binary()), pa.array([codec.encode(values, kind)], pa.binary())]
            return pa.RecordBatch.from_arrays(out, names)

        names = ["n", *(f"{p}{i}" for i in range(len(kinds)) for p in "vs")]
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    with wrapping(df.sparkSession):
        columns = positional(df, schema)
    return columns.mapInArrow(run, "n bigint, " + ", ".join(f"v{i} binary, s{i} binary" for i in range(len(kinds))))


def decode(blocks: DataFrame, schema: Schema, columns: list[str] | None = None) -> DataFrame:
    """The rows of blocks; columns: only these, in this order."""
    at = [schema.index(c) for c in columns] if columns is not None else list(range(len(schema)))
    kinds = [schema[i].type for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in enumerate(batch.column("n").to_pylist()):
                out = []
                for i, kind in zip(at, kinds, strict=True):
                    valid = codec.unbitmap(batch.column(f"v{i}")[k].as_py(), n)
                    full = np.zeros(n, ARROW[kind].to_pandas_dtype())
                    full[valid] = codec.decode(batch.column(f"s{i}")[k].as_py(), int(valid.sum()), kind)
                    out.append(pa.array(full, ARROW[kind], mask=~valid))
                yield pa.RecordBatch.from_arrays(out, [f"o{j}" for j in range(len(at))])

    need = ["n", *(f"{p}{i}" for i in at for p in "vs")]
    made = blocks.select(*need).mapInArrow(run, ", ".join(f"o{j} {kind.spark}" for j, kind in enumerate(kinds)))
    return made.toDF(*[schema[i].name for i in at])


def write(df: DataFrame, folder: str, schema: Schema | None = None, rows: int = ROWS) -> None:
    encode(df, schema, rows).write.parquet(folder)


def read(spark: SparkSession, folder: str, schema: Schema, columns: list[str] | None = None) -> DataFrame:
    return decode(spark.read.parquet(folder), schema, columns)


def sizes(blocks: DataFrame, schema: Schema) -> DataFrame:
    """Bytes encoded and not, in all and by column, in one row."""
    total = " + ".join(f"s{i}_bytes" for i in range(len(schema)))
    one = blocks.agg(F.sum("n").alias("rows"), *[F.sum(F.octet_length(f"v{i}") + F.octet_length(f"s{i}")).alias(f"s{i}_bytes") for i in range(len(schema))])
    return one.select("rows", F.expr(total).alias("compressed_bytes"), F.expr(f"rows * {sum(BYTES[f.type] for f in schema)}").alias("uncompressed_bytes"), *[F.col(f"s{i}_bytes").alias(f"{f.name}_bytes") for i, f in enumerate(schema)])
