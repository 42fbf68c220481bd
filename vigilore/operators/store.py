"""An indicator store that grows by deltas: appends cost their own rows, reads the state and what came since.

Under one folder lie ``base`` (states in key buckets, a version for each merge), ``delta`` (one folder an
append, already aggregated by key) and ``manifest`` (which version each bucket has, and up to which append
it holds all).  A merge rewrites only buckets that have deltas, under a new version that nobody reads yet,
and then renames a new manifest into place: readers see the state before or after it, whatever fails
between.  Manifests are numbered and the highest is in force; two merges at once cannot both take its number.
"""

from __future__ import annotations

import json
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lifecycle import evicted, ioc_key

BUCKETS = 64
BATCHES = 10
STATE = "ioc string, kind string, n long, first_seen timestamp, last_seen timestamp, source string, batches array<string>"


class Manifest(NamedTuple):
    number: int
    applied: int
    versions: dict[int, int]


class Folder(NamedTuple):
    """A folder of the cluster's file system, whatever that is."""

    spark: SparkSession
    path: str

    def _at(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def names(self, name: str = "") -> list[str]:
        files, p = self._at(name)
        return [s.getPath().getName() for s in files.listStatus(p)] if files.exists(p) else []

    def text(self, name: str) -> str:
        files, p = self._at(name)
        stream = files.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file under another name and renames it; False if the name is taken."""
        files, p = self._at(name)
        _, draft = self._at(f"{name}.draft")
        out = files.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return not files.exists(p) and files.rename(draft, p)

    def drop(self, name: str) -> None:
        files, p = self._at(name)
        files.delete(p, True)


def manifest(folder: Folder) -> Manifest:
    numbers = [int(n) for n in folder.names("manifest") if n.isdigit()]
    if not numbers:
        return Manifest(0, 0, {})
    held = json.loads(folder.text(f"manifest/{max(numbers)}"))
    return Manifest(max(numbers), held["applied"], {int(b): v for b, v in held["versions"].items()})


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _joined(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state a key; every part of it merges in any order."""
    batches = F.array_sort(F.array_distinct(F.flatten(F.collect_list("batches"))))
    by_first = lambda c: F.min_by(c, F.struct("first_seen", c)).alias(c)
    merged = states.groupBy(*keys).agg(by_first("kind"), F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), by_first("source"), batches.alias("batches"))
    last = F.slice("batches", F.greatest(F.size("batches") - (BATCHES - 1), F.lit(1)), F.lit(BATCHES))
    return merged.withColumn("batches", F.when(F.size("batches") > 0, last).otherwise(F.col("batches")))


def aggregated(observations: DataFrame) -> DataFrame:
    """States of observations (ioc, kind, source, batch, ts), by batch first, so that a key holds few of them."""
    o = observations.withColumn("ioc", ioc_key(F.col("ioc"))).where("ioc is not null")
    one = o.groupBy("ioc", "batch").agg(F.min_by("kind", F.struct("ts", "kind")).alias("kind"), F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("source", F.struct("ts", "source")).alias("source"))
    one = one.withColumn("batches", F.when(F.col("batch").isNotNull(), F.array("batch")).otherwise(F.array().cast("array<string>"))).drop("batch")
    return _joined(one, ["ioc"])


def append(observations: DataFrame, path: str, number: int, buckets: int = BUCKETS) -> None:
    """Append ``number`` (from 1, each one more); the same number again replaces what it wrote before."""
    rows = aggregated(observations).withColumn("bucket", bucket_of(F.col("ioc"), buckets))
    rows.write.mode("overwrite").parquet(f"{path}/delta/{number}")


def _base(folder: Folder, held: Manifest, buckets: list[int] | None = None) -> DataFrame:
    wanted = {b: v for b, v in held.versions.items() if buckets is None or b in buckets}
    paths = [f"{folder.path}/base/{v}/bucket={b}" for b, v in wanted.items()]
    return folder.spark.read.schema(STATE).parquet(*paths) if paths else folder.spark.createDataFrame([], STATE)


def _deltas(folder: Folder, after: int, gapless: bool = False) -> tuple[DataFrame, list[int]]:
    """Finished appends behind ``after``; ``gapless`` stops where one is not finished yet."""
    numbers = sorted(int(n) for n in folder.names("delta") if n.isdigit() and int(n) > after)
    numbers = [n for n in numbers if "_SUCCESS" in folder.names(f"delta/{n}")]
    if gapless:
        numbers = [n for i, n in enumerate(numbers) if n == after + 1 + i]
    rows = folder.spark.read.schema(f"{STATE}, bucket int").parquet(*[f"{folder.path}/delta/{n}" for n in numbers]) if numbers else folder.spark.createDataFrame([], f"{STATE}, bucket int")
    return rows, numbers


def state(spark: SparkSession, path: str) -> DataFrame:
    """All indicators: the base and the deltas that it does not hold yet."""
    folder = Folder(spark, path)
    held = manifest(folder)
    fresh, numbers = _deltas(folder, held.applied)
    base = _base(folder, held)
    return _joined(base.unionByName(fresh.drop("bucket")), ["ioc"]) if numbers else base


def merge(spark: SparkSession, path: str, as_of: datetime | None = None, ttl_days: int = 90, floor: float = 0.01, buckets: int = BUCKETS) -> int:
    """Brings the deltas into the buckets that they touch, and returns the number of rewritten buckets.

    With ``as_of``, indicators of these buckets that are older than their lifetime and faded go.  Deltas are deleted
    only when a manifest that no longer needs them is in force.
    """
    folder = Folder(spark, path)
    held = manifest(folder)
    fresh, numbers = _deltas(folder, held.applied, gapless=True)
    if not numbers:
        return 0
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    version = held.number + 1
    folder.drop(f"base/{version}")  # what a failed merge left
    old = _base(folder, held, touched)
    rows = _joined(old.unionByName(fresh.drop("bucket")), ["ioc"])
    if as_of is not None:
        rows = evicted(rows, as_of, ttl_days, floor).drop("decay")
    rows = rows.withColumn("bucket", bucket_of(F.col("ioc"), buckets)).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/{version}")
    written = {int(n.split("=")[1]) for n in folder.names(f"base/{version}") if n.startswith("bucket=")}
    versions = {b: v for b, v in held.versions.items() if b not in touched} | {b: version for b in touched if b in written}
    if not folder.put(f"manifest/{version}", json.dumps({"applied": numbers[-1], "versions": versions})):
        raise RuntimeError(f"another merge has taken number {version}")
    _clean(folder, Manifest(version, numbers[-1], versions), held)
    return len(touched)


def _clean(folder: Folder, now: Manifest, before: Manifest) -> None:
    """Drops what neither this manifest nor the one before reads."""
    for n in folder.names("delta"):
        if n.isdigit() and int(n) <= before.applied:
            folder.drop(f"delta/{n}")
    needed = set(now.versions.items()) | set(before.versions.items())
    for v in folder.names("base"):
        own = [b for b in folder.names(f"base/{v}") if b.startswith("bucket=")]
        for b in own:
            if (int(b.split("=")[1]), int(v)) not in needed and int(v) <= now.number:
                folder.drop(f"base/{v}/{b}")
    for n in folder.names("manifest"):
        if n.isdigit() and int(n) < before.number:
            folder.drop(f"manifest/{n}")
