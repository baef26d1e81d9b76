"""Near-duplicates by SimHash with pigeonring filtering.

A sketch is a ring of m segments. Two sketches that differ in at most n places have, by the pigeonring principle, a
segment from which every chain of l consecutive segments holds at most l * n / m differences. For 64-bit fingerprints
with n = 3 and m = 8 the budgets of such a chain are 0, 0, 1, 1, 1, 2, 2, 3: its first two segments are equal, and of the
next three at most one bit differs, so two of those three are equal as well. Each fingerprint therefore goes to 24 keys
of 32 bits (8 starts x 3 pairs), and only fingerprints under one key are compared: chains first, then the whole.

Equal fingerprints are one row from the start. Under a key, members are linked by growing groups: each member met is
compared, vectorised, with those not yet reached, so a key of g near copies costs about g comparisons and g - 1 links,
not g^2. Keys with one member are dropped before anything is compared; those with more than CROWD are refined by one
segment more, and what is still larger is dealt to blocks by hash, and each pair of blocks is a key of its own, so a task holds two blocks at most and no pair of
members is lost. Components of the links are found by star steps over written tables.

`near_groups`, for the pipeline, links whole documents at a Jaccard index of 0.8 or more of their five-word shingles. At
that similarity 64-bit SimHash fingerprints differ in up to 14 bits (README), beyond any selective index, so its sketch
is a ring of 256 minima of shingle hashes (one-permutation hashing), its segments are runs of minima, and the same
chains, budgets and group growing apply to bytes instead of bits. Its links are candidates only: within each of their
components the Jaccard index of the whole shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import drop, partitions, recorded, written
from .tokens import small

SEED = 42
BLOCK = 4096
#: Members of one key that a task holds at most twice of.
CROWD = 50_000


def words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes methods touch ASCII only."""
    return (text or b"").lower().split()


def shingle_hashes(found: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, or of all words where they are fewer."""
    if not found:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(found[k:] for k in range(size)), strict=False)) if len(found) >= size else [b" ".join(found)]
    one = xxhash.xxh64_intdigest
    return np.array([one(r, SEED) for r in runs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[a : a + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = [fingerprint(shingle_hashes(words(t.as_py()), shingle)) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def ring_keys(differences: int = 3) -> list[tuple[int, ...]]:
    """The sets of segments (of 8, a byte each) of which two fingerprints within `differences` bits share one."""
    if differences != 3:
        raise ValueError("keys are laid out for 3 differences")
    return [(i, (i + 1) % 8, *((i + 2 + j) % 8 for j in range(3) if j != out)) for i in range(8) for out in range(3)]


def bits_apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Differing bits by segment: rows of 8."""
    return np.bitwise_count((one ^ many).view(np.uint8).reshape(-1, 8))


def within(apart: np.ndarray, budget: int) -> np.ndarray:
    """Rows of segment differences that have a viable chain, and of those the ones within the budget in all.

    A chain is viable at a start if each of its prefixes of l segments holds at most l * budget / m differences.
    """
    m = apart.shape[1]
    alive = np.arange(len(apart))
    start = np.ones((len(apart), m), bool)
    total = np.zeros((len(apart), m), np.int32)
    for length in range(1, 4):
        total += np.roll(apart, 1 - length, axis=1)
        start &= total * m <= length * budget
    alive = alive[start.any(axis=1)]
    return alive[apart[alive].sum(axis=1, dtype=np.int32) <= budget]


def grown(sketches: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all members which near() joins: each member met is compared with those not yet reached."""
    links, left = [], np.arange(len(sketches))
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            hit = near(sketches[at : at + 1], sketches[left])
            if len(hit):
                links += [(root, int(k)) for k in left[hit]]
                front += left[hit].tolist()
                left = np.delete(left, hit)
    return links


def grown_in_blocks(sketches: np.ndarray, near: Callable, block: int = BLOCK) -> list[tuple[int, int]]:
    """grown() for any number of members: within blocks first, then between blocks for those of different groups."""
    if len(sketches) <= block:
        return grown(sketches, near)
    parent = np.arange(len(sketches))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    links = []
    for a in range(0, len(sketches), block):
        for i, j in grown(sketches[a : a + block], near):
            parent[top(a + j)] = top(a + i)
            links.append((a + i, a + j))
    for a in range(0, len(sketches), block):
        own = np.array([top(i) for i in range(a, min(a + block, len(sketches)))])
        for b in range(a + block, len(sketches), block):
            other = np.array([top(i) for i in range(b, min(b + block, len(sketches)))])
            for k in range(len(own)):
                mine = top(a + k)
                far = np.flatnonzero(other != mine)
                if not len(far):
                    continue
                for j in far[near(sketches[a + k : a + k + 1], sketches[b + far])]:
                    if top(b + int(j)) != top(a + k):
                        links.append((a + k, b + int(j)))
                        parent[top(b + int(j))] = top(a + k)
                        other[other == other[j]] = top(a + k)
    return links


def near_bits(differences: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda one, many: within(bits_apart(one, many), differences)


def crowded(keyed: DataFrame, member: str, crowd: int = CROWD, finer: Column | None = None) -> DataFrame:
    """key and member of keys that have two members or more; keys of more than `crowd` as pairs of blocks.

    finer: an array of keys that are tried first for members of such keys: any two that are to meet share one of them.
    The counts are a table, so that the join's sides are plain exchanges and a large key is split over tasks.
    """
    counts = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    both = keyed.join(counts, "key")
    if finer is not None:
        few = both.filter(F.col("n") <= crowd).select(member, "key")
        many = both.filter(F.col("n") > crowd).select(member, F.explode(finer).alias("key"))
        # where no key is that large, the second pass reads and writes nothing
        return few.unionByName(crowded(many, member, crowd)) if counts.filter(F.col("n") > crowd).limit(1).count() else few
    both = both.withColumn("blocks", F.ceil(F.col("n") / crowd).cast("int"))
    own = F.pmod(F.xxhash64(F.lit("block"), member), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("key", F.least("own", k), F.greatest("own", k)))
    spread = F.when(F.col("blocks") == 1, F.array("key")).otherwise(pairs)
    return both.withColumn("own", own).select(member, F.explode(spread).alias("key"))


def links_by_key(keyed: DataFrame, columns: list[str], member: str, decode: Callable, near: Callable) -> DataFrame:
    """Links (a, b) between members under one key (see crowded).

    Rows are sorted by key within partitions and read as a stream; what a task holds is one key's sketches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(map(len, ids)) > 1:
                names, where = np.unique(np.concatenate(ids), return_index=True)
                if len(names) > 1:
                    found = grown_in_blocks(np.concatenate(held)[where], near)
                    if found:
                        pairs = names[np.array(found)]
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            names, sketches = batch.column(member).to_numpy(), decode(batch)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != key:
                    yield from flush()
                    key, ids, held = keys[a], [], []
                ids.append(names[a:b])
                held.append(sketches[a:b])
        yield from flush()

    dealt = keyed.select("key", member, *columns).repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def segment(k: int) -> Column:
    return F.shiftrightunsigned("fp", 56 - 8 * k).bitwiseAND(F.lit(255))


def near_fingerprints(fps: DataFrame, differences: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join all fingerprints (column fp, each once) which differ in at most `differences` bits.

    The four segments beside a key's four hold at most three differences, so one of them is equal too: a key of more
    than `crowd` members is dealt to four times as many of 40 bits before it is cut into blocks.
    """
    sets = ring_keys(differences)
    # a key's segments and its number, hashed to 64 bits: where two keys meet by chance the comparison tells them apart
    keys = [F.xxhash64(F.lit(n), *(segment(k) for k in at)) for n, at in enumerate(sets)]
    others = F.array(*[F.array(*[F.lit(k) for k in range(8) if k not in at]) for at in sets])
    finer = F.expr("transform(get(others, number), k -> xxhash64(key, k, shiftrightunsigned(fp, 56 - 8 * k) & 255L))")
    rows = fps.select("fp", F.posexplode(F.array(*keys)).alias("number", "key")).withColumn("others", others)
    keyed = crowded(rows, "fp", crowd, finer)
    return links_by_key(keyed, [], "fp", lambda batch: batch.column("fp").to_numpy().view(np.uint64), near_bits(differences))


def op6_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null text has no words; a null doc_id counts in no minimum."""
    all_docs = written(fingerprints(docs))
    fps = written(all_docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(near_fingerprints(fps.select("fp")))
    # tables, so that a component with most of the fingerprints is split over tasks
    rooted = written(fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(first, "root").select("fp", "component_id")
    return all_docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BINS = 256
#: Minima in a document, and how many bins make a segment then: three to seven minima each.
WIDTHS = ((160, 8), (80, 10), (40, 16), (20, 26), (10, 43), (1, 64))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation minima of shingle hashes: which bins have one, and the whole hashes."""
    ordered = np.sort(hashes)
    bins, first = np.unique(ordered >> np.uint64(56), return_index=True)
    return bins.astype(np.int64), ordered[first]


def segment_keys(bins: np.ndarray, least: np.ndarray) -> list[int]:
    """A key for each segment of the ring that has minima: of the width for their number, and of the next where the
    number is within a quarter of its limit. Each width is laid out twice, half a segment apart."""
    full = np.zeros(BINS, np.uint64)
    full[bins] = least
    n, keys = len(bins), []
    for k, (limit, width) in enumerate(WIDTHS):
        upper = WIDTHS[k - 1][0] if k else 10**9
        if limit * 0.8 <= n < upper * 1.25:
            for shift in (0, width // 2):
                ring = np.roll(full, -shift)
                for a in range(0, BINS, width):
                    part = ring[a : a + width]
                    if part.any():
                        keys.append(xxhash.xxh64_intdigest(part.tobytes(), width * 1000 + shift + a))
    return keys


def near_minima(similarity: float, segments: int = 8) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Members whose share of equal minima is at least `similarity`: viable chains over the ring first, then the whole."""

    def near(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        either = (one | many) != 0
        apart = ((one != many) & either).reshape(len(many), segments, -1).sum(axis=2, dtype=np.int32)
        budget = np.floor((1 - similarity) * either.sum(axis=1)).astype(np.int32)
        total, start = np.zeros_like(apart), np.ones(apart.shape, bool)
        for length in range(1, 4):
            total += np.roll(apart, 1 - length, axis=1)
            start &= total * segments <= length * budget[:, None]
        alive = np.flatnonzero(start.any(axis=1))
        return alive[apart[alive].sum(axis=1) <= budget[alive]]

    return near


def near_shingles(similarity: float, slack: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Members (sketch, then distinct shingle hashes in order, as bytes) with a Jaccard index of at least `similarity`.

    Only those whose sketches come within `slack` of it are compared in full.
    """
    close = near_minima(similarity - slack)

    def near(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        rings = [np.frombuffer(b"".join(x[:BINS] for x in side), np.uint8).reshape(-1, BINS) for side in (one, many)]
        mine = np.frombuffer(one[0], np.uint64, offset=BINS)
        hits = []
        for k in close(*rings).tolist():
            other = np.frombuffer(many[k], np.uint64, offset=BINS)
            fewer, more = sorted((mine, other), key=len)
            if len(fewer) >= similarity * len(more):
                both = int((more[np.minimum(np.searchsorted(more, fewer), len(more) - 1)] == fewer).sum())
                if both >= similarity * (len(mine) + len(other) - both) - 1e-9:
                    hits.append(k)
        return np.array(hits, np.int64)

    return near


#: Members of one component of candidates that a task holds at most twice of, as each has its whole shingle set.
CROWD_OF_SETS = 10_000


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, slack: float = 0.1) -> DataFrame:
    """doc_id, hash (of the text) and root of every document; documents of one root are near-duplicates.

    The share of equal minima estimates the Jaccard index of the shingle sets with a deviation of about 0.025, so
    candidates link from similarity - slack. Their shingle sets then come together by component of candidates, and
    those with an index of `similarity` or more are linked. Texts with equal shingle sets are one node from the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            nodes, sketches, keys = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = np.unique(shingle_hashes(words(text.as_py()), shingle))
                bins, least = sketch(hashes)
                codes = np.zeros(BINS, np.uint8)
                codes[bins] = least % np.uint64(255) + np.uint64(1)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sketches.append(codes.tobytes())
                keys.append(np.array(segment_keys(bins, least), np.uint64).view(np.int64))
            made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *made], ["doc_id", "hash", "node", "sketch", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for ring, text in zip(batch.column("sketch").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                out.append(ring + np.unique(shingle_hashes(words(text.as_py()), shingle)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("key"), pa.array(out, pa.binary())], ["node", "key", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    made = written(rows.mapInArrow(run, f"doc_id {kind}, hash bigint, node bigint, sketch binary, keys array<bigint>"))
    nodes = written(made.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.min(F.struct("doc_id", "hash")).alias("at")))
    members = crowded(nodes.select("node", F.explode("keys").alias("key")), "node").join(nodes.select("node", "sketch"), "node")
    decode = lambda batch: np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
    loose = written(components(links_by_key(members, ["sketch"], "node", decode, near_minima(similarity - slack))).select("node", F.col("root").alias("key")))
    # one document's text for each candidate node, whatever the number of its copies
    asked = loose.join(nodes.select("node", "sketch", F.col("at.doc_id").alias("d_"), F.col("at.hash").alias("h_")), "node")
    texts = rows.join(asked.hint("merge"), rows["doc_id"].eqNullSafe(asked["d_"]) & (rows["hash"] == asked["h_"]))
    shingled = written(texts.select("node", "key", "sketch", "text").mapInArrow(sets, "node bigint, key bigint, shingles binary"))
    shingled = shingled.dropDuplicates(["node"])
    dealt = crowded(shingled.select("node", "key"), "node", CROWD_OF_SETS).join(shingled.select("node", "shingles"), "node")

    def whole(batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty(batch.num_rows, object)
        out[:] = batch.column("shingles").to_pylist()
        return out

    found = components(links_by_key(dealt, ["shingles"], "node", whole, near_shingles(similarity, slack)))
    return made.select("doc_id", "hash", F.col("node").alias("own")).join(found, F.col("own") == F.col("node"), "left").select("doc_id", "hash", F.coalesce("root", "own").alias("root"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the least by (doc_id, hash of the text); all columns as they are."""
    with recorded() as made:
        groups = near_groups(docs)
        kept = written(groups.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select(F.col("k.doc_id").alias("d_"), F.col("k.hash").alias("h_")))
    drop(docs.sparkSession, made[:-1])
    rows = docs.select(F.struct("*").alias("row_"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    both = rows.join(kept, rows["doc_id"].eqNullSafe(kept["d_"]) & (rows["hash"] == kept["h_"]), "left_semi")
    once = Window.partitionBy("doc_id", "hash").orderBy("hash")
    return both.withColumn("n_", F.row_number().over(once)).filter("n_ = 1").select("row_.*")
