"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of each window of w consecutive hashes the least is kept, the rightmost
one among equals, with its place. Any two texts that share a run of at least k + w - 1 code points so share a kept
hash, and its places tell where. Texts shorter than a window keep the least hash of what they have, texts shorter than
k the hash of themselves.

A fingerprint string is the base64 of 64-bit big-endian words in text order: a hash of 40 bits, then the lowest 24 bits
of its place. Neighbours lie less than w apart, so places() counts on beyond 2^24. Long texts are hashed in stretches
that overlap by k + w - 2 code points, so that each window lies in one. The likeness of two fingerprints is the Jaccard
index of their sets of hashes, 1 where both are empty.

Order: doc_id, null first; rows that share a doc_id by the hash of their text. Null text counts as empty; a table of
one row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions
from .tokens import ordered_parts, small

GRAM, WINDOW = 12, 32
STRETCH = 1 << 22
PLACE = np.uint64((1 << 24) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


_known = {b: _powers(b, 1) for b in (BASE, INVERSE)}


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The 40-bit hash of every k-gram: a polynomial modulo 2^64 from running sums, then mixed."""
    n = len(codes)
    for b in _known:
        if len(_known[b]) < n:
            _known[b] = _powers(b, max(n, 1 << 17))
    sums = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _known[BASE][:n])
    grams = sums[k - 1 :].copy()
    grams[1:] -= sums[: n - k]
    grams *= _known[INVERSE][: n - k + 1]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0x94D049BB133111EB)
    return grams >> np.uint64(24)


def _stretch(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes and their places."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    k = min(k, n)
    h = hashes(codes, k)
    m = len(h)
    # of equal hashes the larger place makes the lesser key
    key = (h << np.uint64(24)) | (PLACE - np.arange(m, dtype=np.uint64))
    w = min(w, m)
    least, span = key, 1
    while span * 2 <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: m - w + 1], least[w - span :])
    kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return kept >> np.uint64(24), PLACE - (kept & PLACE)


def fingerprint(codes: np.ndarray, k: int = GRAM, w: int = WINDOW) -> np.ndarray:
    """The kept (hash, place) words of a text's code points, in order."""
    step, all_hashes, all_places = STRETCH - (k + w - 2), [], []
    for a in range(0, max(1, len(codes) - (k + w - 2)), step):
        h, at = _stretch(codes[a : a + STRETCH], k, w)
        all_hashes.append(h)
        all_places.append(at + np.uint64(a))
    h, at = np.concatenate(all_hashes), np.concatenate(all_places)
    once = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]  # a border's two windows may keep the same place
    return (h[once] << np.uint64(24)) | (at[once] & PLACE)


def places(words: np.ndarray) -> np.ndarray:
    """The whole places of a fingerprint's words."""
    low = (words & PLACE).astype(np.int64)
    return low + (np.cumsum(np.diff(low, prepend=0) < 0) << 24)


def text_form(words: np.ndarray) -> str:
    return base64.b64encode(words.astype(">u8").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a >> np.uint64(24)), np.unique(b >> np.uint64(24))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def op8_winnow(docs: DataFrame) -> DataFrame:
    """The digest of every document against its edited text and the next document.

    Rows are dealt to ranges of doc_id that begin at ids in the table; the first row of a range goes to the range before
    it too (that of the whole table to the last), so that each range knows the document that follows it.
    """
    starts = ordered_parts(docs, partitions(docs.sparkSession))
    least = docs.agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    starts = [x for x in starts if x != least["least"]]
    first = None if least["nulls"] else least["least"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begins = np.array(starts, np.int64), set(starts)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            part = [0 if d is None else int(np.searchsorted(at, d, "right")) for d in ids]
            row, to, guest = list(range(len(ids))), list(part), [False] * len(ids)
            for k, d in enumerate(ids):
                if d in begins:
                    row.append(k), to.append(part[k] - 1), guest.append(True)
                if d == first:
                    row.append(k), to.append(len(at)), guest.append(True)
            out = batch.take(pa.array(row, pa.int64()))
            # the guest from the table's beginning comes last wherever its id stands
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(guest, pa.bool_()), *out.columns], ["part", "guest", *out.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, opened = None, None, None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

        def row(one: tuple, after: tuple) -> tuple:
            half = len(one[1]) // 2
            edited = np.concatenate([one[1][: len(one[1]) - half], after[1][:half]])
            prints = fingerprint(edited)
            text = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            return one[0], len(one[1]), hashlib.sha256(text).hexdigest(), text_form(one[2]), text_form(prints), likeness(one[2], prints), likeness(one[2], after[2])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in small(batches):
            out = []
            for p, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id")), batch.column("text"), strict=True):
                codes = points(text.as_py() or "")
                one = (doc, codes, fingerprint(codes))
                if p != part and held is not None:  # a table in one range: its last row is followed by its first
                    out.append(row(held, opened))
                    held = None
                if p != part:
                    part, opened = p, one
                if held is not None:
                    out.append(row(held, one))
                held = None if guest else one
            if out:
                yield made(out)
        if held is not None:
            yield made([row(held, opened)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(deal, "part int, guest boolean, doc_id bigint, text string")
    rows = rows.repartitionById(len(starts) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
