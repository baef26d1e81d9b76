"""Sessions in which plans mean what they say."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ANSI = "spark.sql.ansi.enabled"


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """While data frames are built: integer arithmetic wraps and x / 0 is null.

    Expressions keep the mode in which they were built, so the caller's setting is put back afterwards.
    """
    was = spark.conf.get(ANSI)
    spark.conf.set(ANSI, "false")
    try:
        yield
    finally:
        spark.conf.set(ANSI, was)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process, as in local tests, a temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewake-")
    path = f"{base.rstrip('/')}/tidewake-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
