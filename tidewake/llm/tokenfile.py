"""Token ids in files of fixed-width blocks.

A data set is a Parquet folder, so any store that Spark writes to can hold it. Each row is a block of whole documents:

    part, block   place in the order; parts follow one another, blocks follow one another in a part
    start         ids in the same part before the block
    width         bits an id: the least that holds the vocabulary's largest id
    least, most   the block's least and largest doc_id, by which a reader skips row groups
    doc_ids       the block's documents in order
    offsets       ids in the block before each document, and after the last
    payload       the ids, most significant bit first, `width` bits each, padded with zeros to a whole byte

Document k of a block lies in bits offsets[k] * width to offsets[k + 1] * width, so that it can be read alone; numpy
unpacks a block at once. A block has at least `block_ids` ids or ends its part.

Documents are dealt to ranges of doc_id whose limits come from a quantile sketch over all ids, after encoding, as two
or four bytes an id; the texts are not exchanged. Order: doc_id, null first; rows that share a doc_id by the hash of
their text. Null text counts as empty (the end id alone); an empty table gives an empty data set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, partitions, scratch
from .tokens import encoder, groups, ordered_parts, small, vocabulary

END = 1
BLOCK = "part int, block int, start bigint, width int, n_ids bigint, least bigint, most bigint, doc_ids array<bigint>, offsets array<bigint>, payload binary"


#: Ids whose bits are laid out at once; a multiple of 8, so that each run but the last ends with a whole byte.
RUN = 1 << 15


def packed(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    runs = (ids[a : a + RUN].astype(">u4").view(np.uint8).reshape(-1, 4) for a in range(0, len(ids), RUN))
    return b"".join(np.packbits(np.unpackbits(run, axis=1)[:, 32 - width :]).tobytes() for run in runs)


def unpacked(payload: bytes, width: int, first: int, last: int) -> np.ndarray:
    """Ids first to last of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f">u{width // 8}", last - first, first * width // 8).astype("<u4")
    out, data = np.empty(last - first, "<u4"), np.frombuffer(payload, np.uint8)
    for k in range(first, last, RUN):
        n, a = min(RUN, last - k), k * width
        bits = np.unpackbits(data[a // 8 : -(-(k + n) * width // 8)])[a % 8 : a % 8 + n * width]
        full = np.zeros((n, 32), np.uint8)
        full[:, 32 - width :] = bits.reshape(-1, width)
        out[k - first : k - first + n] = np.packbits(full, axis=1).view(">u4")[:, 0]
    return out


def write(docs: DataFrame, folder: str, path: str, block_ids: int = 1 << 16) -> None:
    """The data set of docs' texts in folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    largest = max(END, Tokenizer.from_file(path).get_vocab_size() - 1)
    width, code = max(1, largest.bit_length()), "<u2" if largest < 1 << 16 else "<u4"
    limits = np.array(ordered_parts(docs, partitions(spark)), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_to_ids = encoder(path)
        for batch in small(batches):
            made = [np.append(ids, np.uint32(END)).astype(code).tobytes() for _, texts in groups(batch) for ids in texts_to_ids(texts)]
            ids = batch.column("doc_id")
            part = np.searchsorted(limits, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, batch.column("hash"), pa.array(made, pa.binary())], ["part", "doc_id", "hash", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, docs_in, ids_in, n = None, 0, 0, [], [], 0

        def block_of() -> pa.RecordBatch:
            offsets, named = np.cumsum([0, *map(len, ids_in)]).tolist(), [d for d in docs_in if d is not None]
            row = {"part": part, "block": block, "start": start, "width": width, "n_ids": n, "least": min(named, default=None), "most": max(named, default=None), "doc_ids": docs_in, "offsets": offsets, "payload": packed(np.concatenate(ids_in), width)}
            return pa.RecordBatch.from_pylist([row], LAYOUT)

        for batch in batches:
            for p, d, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if n and (p != part or n >= block_ids):
                    yield block_of()
                    block, start, docs_in, ids_in, n = block + 1, start + n, [], [], 0
                if p != part:
                    part, block, start = p, 0, 0
                docs_in.append(d)
                ids_in.append(np.frombuffer(ids.as_buffer(), code))
                n += len(ids_in[-1])
        if n:
            yield block_of()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = rows.mapInArrow(encode, "part int, doc_id bigint, hash bigint, ids binary")
    rows = rows.repartitionById(len(limits) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "hash")
    with bounded(spark):
        rows.mapInArrow(blocks, BLOCK).write.parquet(folder)


LAYOUT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("width", pa.int32()), ("n_ids", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a data set."""
    blocks = spark.read.parquet(folder)
    # one row for each part: no more than there were shuffle partitions
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, width, ids, offsets = (batch.column(c)[k].as_py() for c in ("part", "start", "width", "doc_ids", "offsets"))
                whole = unpacked(batch.column("payload")[k].as_py(), width, 0, offsets[-1])
                crc = [zlib.crc32(whole[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
                at = np.array(offsets, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at[:-1] + (before[part] + start)), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "start", "width", "doc_ids", "offsets", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def documents(spark: SparkSession, folder: str, doc_ids: Sequence[int], first: int = 0, last: int | None = None) -> DataFrame:
    """doc_id and ids (from the first-th to before the last-th, the end id included) of the documents named.

    Blocks without them are skipped by their least and largest doc_id; of the others only these documents' bits are unpacked.
    """
    wanted = sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = set(wanted)
        for batch in batches:
            found, out = [], []
            for k in range(batch.num_rows):
                width, names, offsets, payload = (batch.column(c)[k].as_py() for c in ("width", "doc_ids", "offsets", "payload"))
                for d, a, b in zip(names, offsets, offsets[1:], strict=False):
                    if d in asked:
                        b = b if last is None else min(b, a + last)
                        found.append(d)
                        out.append(unpacked(payload, width, min(a + first, b), b))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    blocks = spark.read.parquet(folder)
    if not wanted:
        return spark.createDataFrame([], "doc_id bigint, ids array<bigint>")
    near = blocks.filter((F.col("most") >= wanted[0]) & (F.col("least") <= wanted[-1])).filter(F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted)).cast("array<bigint>")))
    return near.select("width", "doc_ids", "offsets", "payload").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def op10_tokenfile(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = scratch(docs.sparkSession)
    write(docs, folder, path or vocabulary())
    return read(docs.sparkSession, folder)
