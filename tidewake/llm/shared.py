"""What the operators of this subpackage share: tables written to the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words here, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir; it goes when the session's file system closes.

    Only where that is unset and Spark runs in one process, as in local tests, a temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewake.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewake-")
        spark.conf.set("tidewake.scratch", base)
    path = f"{base.rstrip('/')}/tidewake-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    for folders in _recorders.get():
        folders.append(path)
    return path


#: The lists to which scratch() adds each folder, in this thread or task: see recorded().
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


@contextmanager
def recorded() -> Iterator[list[str]]:
    """While it holds, the folders that scratch() makes are added to the list that it gives."""
    folders: list[str] = []
    token = _recorders.set((*_recorders.get(), folders))
    try:
        yield folders
    finally:
        _recorders.reset(token)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in folders:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes after which a batch of rows for a Python worker ends. A task holds a batch several times over, outside the JVM's
#: heap: vectors that grow by doubling, the message, the worker's copy. Spark's own limit is 64 MB.
BATCH = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_bounding = threading.Lock()
#: By session: how many plans run under BATCH just now, and what the caller had set.
_bounded: dict[str, tuple[int, str | None]] = {}


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """While it holds, batches of the session's plans end at BATCH bytes; then the caller's limit holds again."""
    session = spark._jsparkSession.sessionUUID()
    with _bounding:
        plans, theirs = _bounded.get(session, (0, spark.conf.get(_BYTES, None)))
        _bounded[session] = plans + 1, theirs
        spark.conf.set(_BYTES, str(BATCH))
    try:
        yield
    finally:
        with _bounding:
            plans, theirs = _bounded.pop(session)
            if plans > 1:
                _bounded[session] = plans - 1, theirs
            elif theirs is None:
                spark.conf.unset(_BYTES)
            else:
                spark.conf.set(_BYTES, theirs)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of executors, is computed once."""
    path = scratch(df.sparkSession)
    with bounded(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: str, name: str, body: str) -> str:
    """SQL for body in which name stands for value, evaluated once for each row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPANS = "array<struct<s:int,o:int,e:int>>"
#: Elements that are folded at once, and how many levels of such chunks there are: 64 ^ 3 elements cost about 64 steps
#: each, and beyond that the number of chunks of the highest level counts squared.
CHUNK, LEVELS = 64, 3


def before(values: str, fold: str = "s + y", level: int = LEVELS) -> str:
    """SQL: for each element of an array of ints the fold, from 0, of those before it.

    aggregate() copies its accumulator at each step, so arrays never are in one: chunks are folded apart, then their totals.
    """
    n = f"_{level}"
    direct = f"transform(a{n}, (x, i) -> aggregate(slice(a{n}, 1, i), 0, (s, y) -> {fold}))"
    if level == 1:
        return let(values, f"a{n}", direct)
    totals = before(f"transform(c{n}, c -> aggregate(c, 0, (s, y) -> {fold}))", fold, level - 1)
    inner = f"transform(c{n}, (c, k) -> transform(c, (x, i) -> aggregate(slice(c, 1, i), get(t{n}, k), (s, y) -> {fold})))"
    chunked = let(f"transform(sequence(0, (size(a{n}) - 1) DIV {CHUNK}), k -> slice(a{n}, {CHUNK} * k + 1, {CHUNK}))", f"c{n}", let(totals, f"t{n}", f"flatten({inner})"))
    return let(values, f"a{n}", f"CASE WHEN size(a{n}) <= {CHUNK} THEN {direct} ELSE {chunked} END")


def matched(text: str, pattern: str, keep: str, order: int, note: str = "", unit: str = "length") -> str:
    """SQL: array of struct(s, o, e) of the leftmost non-overlapping matches m of a Java pattern that hold keep.

    o is order. note: SQL of an int, a fourth field v; in it and in keep, g is the text since the match before. Places
    are in code points, or in bytes where unit is octet_length. regexp_extract_all() gives the matches, split() the pieces
    between them; sums of the lengths before give places, so the cost is in proportion to the text and its matches.
    """
    none = f"CAST(array() AS {SPANS.replace('>>', ',v:int>>') if note else SPANS})"
    span = f"struct(get(p_, i) + {unit}(g) AS s, {order} AS o, get(p_, i) + get(w_, i) AS e{f', {note} AS v' * bool(note)})"
    one = let("get(g_, i)", "g", f"CASE WHEN {keep} THEN {span} END")
    found = let(before("w_"), "p_", f"filter(transform(m_, (m, i) -> {one}), x -> x IS NOT NULL)")
    sizes = f"zip_with(m_, slice(g_, 1, size(m_)), (m, g) -> {unit}(g) + {unit}(m))"
    found = let(f"split({text}, {quoted(pattern)})", "g_", let(sizes, "w_", found))
    return let(f"regexp_extract_all({text}, {quoted(pattern)}, 0)", "m_", f"CASE WHEN size(m_) = 0 THEN {none} ELSE {found} END")


def listed(spans: str, kinds: tuple[str, ...]) -> str:
    """SQL: kind:start:end of each span by start, then order, comma-joined; o counts from 0 in kinds."""
    names = f"array({', '.join(map(quoted, kinds))})"
    return f"array_join(transform(array_sort({spans}), x -> concat({names}[x.o], ':', x.s, ':', x.e)), ',')"
