"""Substring dedup by collinear chaining: passages of 50 words or more that stand in an earlier document too.

1. Seeds: of the runs of 8 consecutive words those are kept whose least pair of neighbours stands at their beginning or
   end (closed syncmers: 2 of 7 in text without repeats). What is kept depends on the 8 words alone, so that changed
   words beside them take no seed away, and any 13 equal words share one. A seed that comes again within PERIOD words (a repeated word or line) is told apart by its number
   in the stretch, counted round so that any LEAST words of such a stretch hold every number.
2. Links: for each seed the first document that has it (least doc_id) is found by partial aggregation and joined back.
   Every other occurrence links to that one alone, so a passage in d documents makes d - 1 links, not d^2. The joined
   tables are plain exchanges, so that a seed with very many occurrences is split over tasks.
3. Chains: the links of a document to one source are chained in order, with a cost linear in the gaps, through a
   Fenwick tree of prefix maxima. A chain may be one link. A document's links are bounded by its text.
4. Alignment: for chained regions only, word hashes of both texts are fetched. Gaps between seeds are aligned by longest
   common subsequence, ends extended while matches outweigh mismatches. Aligned stretches of a document that touch are
   joined, also from different sources; those of 50 words or more are passages.

Words are what ASCII white space separates, A-Z lower-cased. Defined cases: null text counts as empty; rows with a null
doc_id are left alone; rows that share a doc_id are one document whose texts are not compared with each other;
repeated rows get the same passages; an empty table gives no rows; `stage` returns all columns as they came.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, partitions, recorded, written
from .simhash import words
from .tokens import small

GRAM, PAIR, LEAST = 8, 2, 50
GAP_COST, GAP, MARGIN, JOIN = 0.1, 32, LEAST, 2
#: The longest distance at which equal seeds are one periodic stretch: at least two of them lie in LEAST words then.
PERIOD = (LEAST - GRAM + 1) // 2
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(text: bytes | None) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words(text)), np.uint64)


def runs(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    n = len(codes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def seeds(codes: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the kept k-grams of words."""
    if len(codes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    pairs, last = runs(codes, PAIR), k - PAIR
    n = len(pairs) - last
    least = pairs[:n]
    for j in range(1, last + 1):
        least = np.minimum(least, pairs[j : j + n])
    at = np.flatnonzero((pairs[:n] == least) | (pairs[last:] == least))
    return numbered(runs(codes, k))[at], at


def numbered(grams: np.ndarray) -> np.ndarray:
    """Hashes of k-grams and, where the same one came within PERIOD words before, of their number in that stretch.

    Numbers start again after as many as any LEAST words of the stretch hold, so that a stretch which is longer than
    its source's links all along, over and over to the source's beginning.
    """
    order = np.argsort(grams, kind="stable")
    apart = np.diff(order)
    again = np.concatenate([[False], (grams[order][1:] == grams[order][:-1]) & (apart <= PERIOD)])
    if not again.any():
        return grams
    step = np.arange(len(order))
    number = step - np.maximum.accumulate(np.where(again, 0, step))
    number[1:] %= (LEAST - GRAM + 1) // np.where(again[1:], apart, 1)
    out = grams.copy()
    out[order] ^= number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def chains(pos: np.ndarray, source: np.ndarray) -> list[list[int]]:
    """Chains of anchors that rise in both coordinates, best first; each anchor is in one."""
    order = np.lexsort((-source, pos))
    rank = np.unique(source, return_inverse=True)[1] + 1
    size = int(rank.max())
    best, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(pos), [-1] * len(pos)
    for i in order.tolist():
        r, along = int(rank[i]), GAP_COST * float(pos[i] + source[i])
        top, j, q = -1e18, -1, r - 1
        while q:
            if best[q] > top:
                top, j = best[q], who[q]
            q &= q - 1
        gain = top - along
        score[i] = GRAM + max(gain, 0.0)
        before[i] = j if gain > 0 else -1
        value = score[i] + along
        while r <= size:
            if value > best[r]:
                best[r], who[r] = value, i
            r += r & -r
    out, used = [], [False] * len(pos)
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (pos[chain[-1]] - pos[i] > GAP + GRAM or source[chain[-1]] - source[i] > GAP + GRAM):
                out.append(chain[::-1])
                chain = []
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def extended(a: list[int], b: list[int]) -> int:
    """Words by which a match goes on: up to where matches less twice the mismatches are most, given up 6 below."""
    score = most = reach = 0
    for n, (x, y) in enumerate(zip(a, b, strict=False), 1):
        score += 1 if x == y else -2
        if score > most:
            most, reach = score, n
        if score < most - 6:
            break
    return reach


def aligned(own: list[int], other: list[int], pos: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """Stretches (start, end, start in the other) that a chain's anchors and what lies between and beside them align."""
    good = [(p, s) for p, s in zip(pos, source, strict=True) if p >= 0 and s >= 0 and own[p : p + GRAM] == other[s : s + GRAM] and len(own) >= p + GRAM]
    out = []
    for p, s in good:
        if out:
            a, e, c, f = out[-1]
            between, there = own[e:p], other[f:s]
            size = max(len(between), len(there))
            if p < e or s < f or between == there or 2 * common(between, there) >= size:
                out[-1] = (a, max(e, p + GRAM), c, max(f, s + GRAM))
                continue
        out.append((p, p + GRAM, s, s + GRAM))
    wide = []
    for a, e, c, f in out:
        left = extended(own[max(0, a - MARGIN) : a][::-1], other[max(0, c - MARGIN) : c][::-1])
        right = extended(own[e : e + MARGIN], other[f : f + MARGIN])
        wide.append((a - left, e + right, c - left))
    return wide


def joined(stretches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Passages from stretches (start, end, source, start in the source): the source is the longest stretch's."""
    out: list[list] = []
    for a, e, src, c in sorted(stretches):
        if out and a <= out[-1][1] + JOIN:
            last = out[-1]
            last[1] = max(last[1], e)
            if e - a > last[4]:
                last[2:] = [src, c, e - a]
        else:
            out.append([a, e, src, c, e - a])
    return [tuple(x[:4]) for x in out if x[1] - x[0] >= LEAST]


def _links(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                codes = word_hashes(text.as_py())
                if len(codes) >= LEAST:
                    h, at = seeds(codes)
                    lead = np.zeros(len(h), bool)
                    lead[np.unique(h, return_index=True)[1]] = True
                    parts.append((h.view(np.int64), np.full(len(h), doc), at.astype(np.int32), lead))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["h", "doc", "pos", "lead"])

    found = written(docs.mapInArrow(run, "h bigint, doc bigint, pos int, lead boolean"))
    first = found.filter("lead").groupBy("h").agg(F.min("doc").alias("src"), F.max("doc").alias("last"), F.expr("min_by(pos, doc)").alias("spos")).filter("src <> last")
    first = written(first.select("h", "src", "spos"))
    return found.join(first, "h").filter("doc <> src").select("doc", "pos", "src", "spos")


def _chained(links: DataFrame) -> DataFrame:
    """doc, src, a (number of the chain in the document), pos and spos (arrays) of chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, number = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if key is not None:
                pos, source = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
                made = [(sorted(pos[c].tolist()), sorted(source[c].tolist())) for c in chains(pos, source)]
                if made:
                    n = len(made)
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array(range(number, number + n), pa.int32()), pa.array([p for p, _ in made], pa.list_(pa.int32())), pa.array([s for _, s in made], pa.list_(pa.int32()))], ["doc", "src", "a", "pos", "spos"])
                    number += n

        for batch in batches:
            doc, src, pos, spos = (batch.column(c).to_numpy() for c in ("doc", "src", "pos", "spos"))
            cuts = [0, *(np.flatnonzero((doc[1:] != doc[:-1]) | (src[1:] != src[:-1])) + 1).tolist(), len(doc)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if (doc[x], src[x]) != key:
                    yield from flush()
                    number = 0 if key is None or key[0] != doc[x] else number
                    key, held = (doc[x], src[x]), []
                held.append((pos[x:y], spos[x:y]))
        yield from flush()

    dealt = links.repartition(partitions(links.sparkSession), "doc").sortWithinPartitions("doc", "src")
    return dealt.mapInArrow(run, "doc bigint, src bigint, a int, pos array<int>, spos array<int>")


def _fetched(docs: DataFrame, chained: DataFrame) -> DataFrame:
    """doc, a, src, side, hash, low, codes (32-bit word hashes of the region and its margins) of both sides of each chain."""
    edge = lambda c: [F.greatest(F.lit(0), F.element_at(c, 1) - MARGIN).alias("low"), (F.element_at(c, -1) + GRAM + MARGIN).alias("high")]
    own = chained.select(F.col("doc").alias("id"), "doc", "a", "src", F.lit(0).alias("side"), *edge("pos"))
    other = chained.select(F.col("src").alias("id"), "doc", "a", "src", F.lit(1).alias("side"), *edge("spos"))
    # a source's requests stay apart by document, so that no list grows with the number of copies
    asked = own.unionByName(other).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(4096)))
    asked = written(asked.groupBy("id", "salt").agg(F.collect_list(F.struct("doc", "a", "src", "side", "low", "high")).alias("asks")))
    # a merge join at every size, as its right side grows with the input
    text = docs.select(F.col("doc").alias("id"), "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes = None, np.empty(0, np.uint32)
        for batch in small(batches):
            rows = []
            for n, (i, h, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "asks")), strict=True)):
                if (i, h) != last:
                    codes = (word_hashes(batch.column("text").cast(pa.binary())[n].as_py()) >> np.uint64(32)).astype(np.uint32)
                    last = (i, h)
                rows += [{"doc": q["doc"], "a": q["a"], "src": q["src"], "side": q["side"], "hash": h, "low": q["low"], "codes": codes[q["low"] : q["high"]].tobytes()} for q in asks]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SLICES)

    return text.join(asked.select("id", "asks").hint("merge"), "id").mapInArrow(run, "doc bigint, a int, src bigint, side int, hash bigint, low int, codes binary")


SLICES = pa.schema([("doc", pa.int64()), ("a", pa.int32()), ("src", pa.int64()), ("side", pa.int32()), ("hash", pa.int64()), ("low", pa.int32()), ("codes", pa.binary())])


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), start_word, end_word (exclusive), source_id, source_word of every passage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text").filter("doc IS NOT NULL")
    chained = written(_chained(_links(rows)))
    slices = _fetched(rows, chained)
    # chains come with their slices: one exchange by document
    anchors = chained.select("doc", "a", "src", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("low"), F.lit(b"").alias("codes"), "pos", "spos")
    empty = F.lit(None).cast("array<int>")
    both = slices.withColumns({"pos": empty, "spos": empty}).unionByName(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, found, chain, own, names = None, {}, None, [], ["doc_id", "hash", "start_word", "end_word", "source_id", "source_word"]

        def flush() -> Iterator[pa.RecordBatch]:
            out = [(doc, h, *p) for h, stretches in found.items() for p in joined(stretches)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [(d, h, a, e, s, c) for d, h, a, e, s, c in out]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*columns, strict=True), kinds, strict=True)], names)

        for batch in small(batches, 1024):
            columns = {c: batch.column(c).to_pylist() for c in ("doc", "a", "src", "side", "hash", "low", "codes", "pos", "spos")}
            for d, a, src, side, h, low, codes, pos, spos in zip(*columns.values(), strict=True):
                if d != doc:
                    yield from flush()
                    doc, found = d, {}
                if side < 0:
                    chain, own = (a, pos, spos), []
                    continue
                words_ = np.frombuffer(codes, np.uint32).tolist()
                if side == 0:
                    own.append((h, low, words_))
                    continue
                for h0, low0, mine in own:
                    for x, e, c in aligned(mine, words_, [p - low0 for p in chain[1]], [s - low for s in chain[2]]):
                        found.setdefault(h0, set()).add((x + low0, e + low0, src, c + low))
        yield from flush()

    dealt = both.repartition(partitions(docs.sparkSession), "doc").sortWithinPartitions("doc", "a", "side", "hash")
    return dealt.mapInArrow(run, "doc_id bigint, hash bigint, start_word bigint, end_word bigint, source_id bigint, source_word bigint")


def op2_passages(docs: DataFrame) -> DataFrame:
    return passages(docs).select("doc_id", "start_word", "end_word", F.expr("end_word - start_word").alias("n_words"), "source_id", "source_word")


def cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """text without the words in ranges (start, end), from the first one's beginning to the last one's end."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, e in sorted(ranges):
        out.append(text[at : spans[a][0]])
        at = spans[e - 1][1]
    return b"".join([*out, text[at:]])


def stage(docs: DataFrame) -> DataFrame:
    """docs without their repeated passages, n_chars (where there is one) made to fit; rows with no word left go."""
    with recorded() as made:
        found = written(passages(docs).groupBy(F.col("doc_id").alias("d_"), F.col("hash").alias("h_")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("ranges_")))
    drop(docs.sparkSession, made[:-1])
    rows = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("k_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("x_"))
    both = rows.join(found.hint("merge"), (rows["k_"] == found["d_"]) & (rows["x_"] == found["h_"]), "left").select("row_", "ranges_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            row = batch.column("row_")
            fields = {f.name: row.field(k) for k, f in enumerate(row.type)}
            texts, keep, left = [], [], []
            for text, ranges in zip(fields["text"].cast(pa.binary()), batch.column("ranges_").to_pylist(), strict=True):
                t = text.as_py()
                if ranges:
                    t = cut(t, [(r["start_word"], r["end_word"]) for r in ranges])
                texts.append(t)
                left.append(len((t or b"").decode(errors="replace")) if ranges else None)
                keep.append(not ranges or bool(words(t)))
            fields["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in fields:
                kind = fields["n_chars"].type
                fields["n_chars"] = pa.array([old if new is None else new for old, new in zip(fields["n_chars"].to_pylist(), left, strict=True)]).cast(kind)
            yield pa.RecordBatch.from_arrays(list(fields.values()), list(fields)).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, docs.schema)
