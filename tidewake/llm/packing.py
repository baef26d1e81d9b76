"""Best-fit packing with bound-certified repacking.

Documents become pieces of at most `capacity` ids. Pieces are dealt by their row number to partitions of about
`per_part`, and each partition packs its own by best-fit decreasing. Lower bounds by dual feasible functions certify a
partition's number of bins; a certified partition gives up only its emptiest bin, one with a gap every bin that is not
nearly full. What is given up is dealt anew to fewer partitions and packed again, until one partition has the rest,
nothing is left, or packing it again has saved no bin.

Defined cases: null text counts as empty (its end id alone); repeated rows are packed each for itself; an empty table
gives no rows; other columns of the input are ignored, by the stage too, whose result is the packing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokens import encoder, groups, small, vocabulary

CAPACITY = 2048
END = 0


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual feasible functions over the histogram of lengths."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    above, weight = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(count * x)])
    for e in range(1, capacity // 2 + 1):  # over capacity - e: a whole bin; under e: nothing
        total = int(above[capacity - e + 1]) * capacity + int(weight[capacity - e + 1] - weight[e])
        best = max(best, -(-total // capacity))
    for k in range(1, 21):  # rounded to multiples of capacity / k, in units of 1 / k of a bin and exact where x (k + 1) / capacity is whole
        whole = x * (k + 1) % capacity == 0
        scaled = np.where(whole, x * k, x * (k + 1) // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, and the bins' room left."""
    bins, offsets, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    some = 0  # bit r is set where at[r] holds a bin
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i], room[b] = b, capacity - r, r - n
        if r > n:
            if not at[r - n]:
                some |= 1 << (r - n)
            at[r - n].append(b)
    return bins, offsets, room


def released(room: list[int], bound: int, capacity: int = CAPACITY) -> set[int]:
    """Bins to give up: with a gap all with more than a hundredth of room, else the emptiest if it has room."""
    if not room:
        return set()
    if len(room) > bound:
        return {b for b, r in enumerate(room) if r * 100 > capacity}
    emptiest = max(range(len(room)), key=room.__getitem__)
    return {emptiest} if room[emptiest] else set()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([END], "<u4")
        for batch in small(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for first, texts in groups(batch):
                for k, ids in enumerate(encode(texts), first):
                    ids = np.concatenate([ids, end])
                    for n, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a : a + capacity]
                        row.append(k), piece.append(n), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(v, t) for v, t in zip((piece, start, length, crc), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *made], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _packer(turn: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, room = best_fit(lengths, capacity)
        free = released(room, lower_bound(lengths, capacity), capacity)
        # 16 bits of turn, 23 of partition, 24 of bin: a partition holds about per_part pieces and no more bins
        ids = (turn << 47) + (table.column("part_")[0].as_py() << 24) + bins
        out = table.drop_columns(["part_", "row_"])
        for name, values in (("sequence_id", ids), ("offset", offsets), ("again_", np.isin(bins, list(free)))):
            out = out.append_column(name, pa.array(values))
        return out.append_column("row_", table.column("row_"))

    return run


def pack(items: DataFrame, per_part: int = 50_000, capacity: int = CAPACITY) -> DataFrame:
    """items (with a column length of 1 to capacity) with sequence_id and offset."""
    left = written(items.withColumn("row_", F.monotonically_increasing_id()))  # written: the row numbers are fixed from here on
    names = [*items.columns, "sequence_id", "offset"]
    out, schema = None, left.drop("row_").schema.add("sequence_id", "long").add("offset", "long").add("again_", "boolean").add("row_", "long")
    rows, given, turn = left.count(), None, 0
    while True:
        parts = max(1, -(-rows // per_part))
        dealt = left.withColumn("part_", F.pmod(F.xxhash64("row_", F.lit(turn)), F.lit(parts)).cast("long"))
        done = written(dealt.groupBy("part_").applyInArrow(_packer(turn, capacity), schema))
        # a bin has one piece at offset 0
        first = F.col("offset") == 0
        state = done.agg(F.count_if(first).alias("bins"), F.count_if("again_").alias("rows"), F.count_if(first & F.col("again_")).alias("given")).first()
        last = parts == 1 or not state["rows"] or given is not None and state["bins"] >= given
        kept = done.select(*names) if last else done.filter(~F.col("again_")).select(*names)
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out
        left, rows, given, turn = done.filter("again_").select(*items.columns, "row_"), state["rows"], state["given"], turn + 1


def op4_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(pieces(docs, path or vocabulary())).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
