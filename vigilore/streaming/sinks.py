"""Sinks that a replayed batch leaves as they are: every batch owns a folder named by its number."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_dir

Operator = Callable[[DataFrame], DataFrame]


def put_batch(batch: DataFrame, number: int, path: str) -> None:
    """Writes the rows of a batch over what an earlier run of the same batch left."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def keyed_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A writer whose rows go into the folder of their batch."""
    return stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: put_batch(batch, number, path)).option("checkpointLocation", checkpoint)


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the sink holds, with the number of the batch; no rows before the first batch."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except Exception as e:  # the folder comes with the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


def newest_rows(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key of a sink in update mode, without keys that have expired."""
    order = Window.partitionBy(key).orderBy(F.desc("batch"), F.desc("last_seen"))
    return rows.withColumn("_r", F.row_number().over(order)).where((F.col("_r") == 1) & ~F.col("expired")).drop("_r", "batch", "expired")


def last_batch(rows: DataFrame) -> DataFrame:
    """The rows of the newest batch that left any."""
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def _drop_folders(spark: SparkSession, path: str, batches: list[int]) -> None:
    context = spark.sparkContext
    for n in batches:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def emit_triggers(alerts: DataFrame, path: str, operator: Operator, checkpoint: str, window: timedelta = timedelta(days=1), settled: int = 2):
    """Runs a batch operator over the trailing window of the stream with every batch, and keeps what it finds.

    The rows of the window lie beside the triggers, in folders by batch; the window ends with the newest row seen
    so far.  A batch that runs again writes the same two folders again from the same rows, so triggers are neither
    lost nor doubled.  Folders all of whose rows are behind the window go once ``settled`` later batches stand.
    """
    rows_path, found_path = f"{path}/window", f"{path}/triggers"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put_batch(batch, number, rows_path)
        kept = written(spark, rows_path, schema).where(F.col("batch") <= number)
        # One row a batch that is still kept.
        ends = {r.batch: r.end for r in kept.groupBy("batch").agg(F.max("ts").alias("end")).collect() if r.end is not None}
        if not ends:
            return
        since = max(ends.values()) - window
        put_batch(operator(kept.where(F.col("ts") > F.lit(since)).drop("batch")), number, found_path)
        _drop_folders(spark, rows_path, [n for n, end in ends.items() if end <= since and n <= number - settled])

    return alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def drain(stream: DataFrame, name: str, mode: str = "append", timeout: int = 600) -> DataFrame:
    """Runs a stream over all that its source holds now and reads its sink, in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    job = keyed_sink(stream, f"{path}/rows", f"{path}/checkpoint", mode).trigger(availableNow=True).start()
    finish(job, timeout)
    return written(spark, f"{path}/rows", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))


def finish(job, timeout: int = 600) -> None:
    """Waits for the end of a job over what is there now; its failure is raised."""
    if not job.awaitTermination(timeout):
        job.stop()
        raise TimeoutError(f"the stream has not ended after {timeout} seconds")
