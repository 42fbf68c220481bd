"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application that the driver and all executors see; it goes when the application ends.

    The cluster names the folder above it in ``spark.checkpoint.dir``; only a local
    session without that setting (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vigilore-")
        context.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/vigilore-{context.applicationId}"
    if path not in _made:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _made.add(path)
    return path


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with the end of the write, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    Cuts lineage and keeps an expensive result from being computed twice; the
    files outlive any single executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _without_old_shuffles(spark):
        df.select("*").write.parquet(path)  # a frame of its own, planned under this setting
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` returned, when all that reads them has been written in turn."""
    for df in tables:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
