"""Zero-filled series, anomaly scores, beacons, velocity, heat maps and decay."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bucket, epoch, in_window, r4, severity_counts, top_k_per, zero_filled
from ..functions.ordered import ORDER, previous

FLAT = 1e-4


def histogram(alerts: DataFrame, seconds: int, keys: list[str] | None = None) -> DataFrame:
    return alerts.groupBy(*(keys or []), bucket("ts", seconds).alias("bucket")).agg(F.count("*").alias("n"))


def filled_histogram(alerts: DataFrame, seconds: int, since: datetime, until: datetime) -> DataFrame:
    return zero_filled(histogram(alerts.where(in_window("ts", since, until)), seconds), "bucket", seconds, since, until, ["n"])


def _arrivals(alerts: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """(key, ts, gap): seconds since the alert before of the same key, null at its first."""
    rows = previous(alerts.select(key, *order, epoch(order[0]).alias("_at")), key, "_at", order)
    return rows.select(key, order[0], (F.col("_at") - F.col("before")).alias("gap"))


def gaps(alerts: DataFrame, key: str = "srcip", order: tuple[str, ...] = ORDER) -> DataFrame:
    """(key, ts, gap): seconds since the alert before of the same key."""
    return _arrivals(alerts, key, order).where("gap is not null")


def beacons(alerts: DataFrame, key: str = "srcip", min_events: int = 5, cv_threshold: float = 0.3) -> DataFrame:
    """Regularity of every key's arrivals: score 1 for a clock, 0 from a variation of 0.5 on.

    ``period`` is the upper median of the gaps in whole seconds, found among the
    distinct whole seconds, which are few however many gaps there are.
    """
    g = _arrivals(alerts, key, ORDER)
    stats = g.groupBy(key).agg(F.count("*").alias("n_events"), F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    seconds = g.where("gap is not null").groupBy(F.col(key).alias("_key"), F.bround("gap").alias("s")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("_key")
    middle = seconds.withColumn("upto", F.sum("n").over(whole.orderBy("s"))).withColumn("size", F.sum("n").over(whole)).where(F.col("upto") > F.floor(F.col("size") / 2)).groupBy("_key").agg(F.min("s").alias("period"))
    out = stats.join(middle, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")))
    score = F.when(F.col("n_events") < min_events, F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("cv", F.lit(float("inf"))) / 0.5)))
    out = out.withColumn("score", score)
    label = F.when(F.col("n_events") < min_events, "insufficient_data").when(F.col("score") >= 0.8, "strong").when(F.col("score") >= 0.5, "likely").when(F.col("score") >= 0.25, "possible").otherwise("none")
    return out.select(key, "n_events", r4("mean").alias("mean_gap"), r4("sd").alias("sd_gap"), r4("cv").alias("cv"), r4("score").alias("score"), "period", label.alias("verdict"), (F.col("cv") < cv_threshold).alias("is_regular"))


def period_candidates(alerts: DataFrame, key: str = "srcip", k: int = 3) -> DataFrame:
    """The most frequent gaps in whole seconds of every key."""
    return top_k_per(gaps(alerts, key).withColumn("seconds", F.bround("gap").cast("long")), [key], "seconds", k)


def z_scores(series: DataFrame, value: str, by: list[str], robust: bool = False) -> DataFrame:
    """Adds ``z`` against the whole series of each ``by`` group; a flat series has z 0."""
    w = Window.partitionBy(*by)
    if robust:
        middle = F.percentile(value, F.lit(0.5)).over(w)
        df = series.withColumn("_m", middle).withColumn("_s", 1.4826 * F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).over(w))
    else:
        df = series.withColumn("_m", F.avg(value).over(w)).withColumn("_s", F.stddev_pop(value).over(w))
    return df.withColumn("z", F.when(F.col("_s") > FLAT, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def co_spikes(series: DataFrame, threshold: float = 2.5, shoulder: float = 0.6, floor: int = 10, robust: bool = False) -> DataFrame:
    """Buckets in which three aligned sources spike together.

    ``series`` has bucket, n_a, n_b, n_c.  A source with fewer than ``floor`` events
    never spikes; a spike needs a neighbouring bucket at ``shoulder`` of the threshold
    unless ``shoulder`` is 0.  The windows run over buckets, never over raw alerts.
    """
    whole = Window.partitionBy(F.lit(0))
    df = series.withColumn("_buckets", F.count("*").over(whole))
    for s in "abc":
        df = df.withColumn("_g", F.lit(0))
        df = z_scores(df, f"n_{s}", ["_g"], robust).withColumnRenamed("z", f"z_{s}")
        df = df.withColumn(f"z_{s}", F.when((F.sum(f"n_{s}").over(whole) < floor) | (F.col("_buckets") < 2), 0.0).otherwise(F.col(f"z_{s}")))
    low = F.least("z_a", "z_b", "z_c")
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    df = df.withColumn("_low", low)
    side = lambda c: F.coalesce(c >= threshold * shoulder, F.lit(False))
    confirmed = F.lit(True) if not shoulder else side(F.lag("_low").over(order)) | side(F.lead("_low").over(order))
    df = df.withColumn("_ok", confirmed)
    return df.where((F.col("_low") >= threshold) & F.col("_ok")).select("bucket", "n_a", "n_b", "n_c", *[F.round(f"z_{s}", 2).alias(f"z_{s}") for s in "abc"])


def three_source_series(alerts: DataFrame, sources: dict[str, Column], seconds: int, since: datetime, until: datetime) -> DataFrame:
    """Three counts per bucket from one scan; ``sources`` maps a, b, c to conditions."""
    counted = alerts.where(in_window("ts", since, until)).groupBy(bucket("ts", seconds).alias("bucket")).agg(*[F.count_if(c).alias(f"n_{s}") for s, c in sources.items()])
    return zero_filled(counted, "bucket", seconds, since, until, [f"n_{s}" for s in sources])


def baseline_profile(alerts: DataFrame, seconds: int, since: datetime, until: datetime, metric: str = "alert_volume") -> DataFrame:
    """One row: the last bucket of the half-open window against all of them."""
    value = {"alert_volume": F.count("*"), "unique_ips": F.count_distinct("srcip"), "high_severity": F.count_if(F.col("rule_level") >= 10)}[metric]
    counted = alerts.where(in_window("ts", since, until)).groupBy(bucket("ts", seconds).alias("bucket")).agg(value.alias("n"))
    series = zero_filled(counted, "bucket", seconds, since, until - timedelta(microseconds=1), ["n"])  # none starts at its end
    one = series.agg(F.count("*").alias("buckets"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.max_by("n", "bucket").alias("current"), F.min_by("bucket", F.struct(-F.col("n"), F.col("bucket"))).alias("peak_at"), F.max("n").alias("peak"))
    z = F.when(F.col("sd") > FLAT, (F.col("current") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    verdict = F.when(F.col("buckets") < 2, "insufficient").when(F.abs("z") >= 3, "critical").when(F.abs("z") >= 2, "anomalous").when(F.abs("z") >= 1, "elevated").otherwise("normal")
    return one.withColumn("z", z).select("buckets", r4("mean").alias("mean"), r4("sd").alias("sd"), "current", r4("z").alias("z"), verdict.alias("verdict"), "peak", "peak_at")


def baseline_drift(alerts: DataFrame, seconds: int, base: tuple[datetime, datetime], current: tuple[datetime, datetime], threshold: float = 2.5) -> DataFrame:
    """Each current bucket against mean and deviation of the baseline window."""
    old = filled_histogram(alerts, seconds, *base).where(F.col("bucket") < F.lit(base[1]))
    stats = old.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.sum("n").alias("events")).withColumn("_", F.lit(1))
    new = filled_histogram(alerts, seconds, *current).withColumn("_", F.lit(1)).withColumn("buckets", F.count("*").over(Window.partitionBy("_")))
    z = F.when(F.col("sd") > FLAT, (F.col("n") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    out = new.join(F.broadcast(stats), "_").where("events > 0 and buckets >= 2").withColumn("z", z)
    return out.select("bucket", "n", r4("z").alias("z"), (F.abs("z") >= threshold).alias("drifted"))


def heat_map(alerts: DataFrame, threshold: float = 2.5) -> DataFrame:
    """168 cells of weekday (Monday 0) and hour, with z over the cells."""
    cells = alerts.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    counted = alerts.groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    full = cells.join(F.broadcast(counted), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy(F.lit(0))
    sd = F.stddev_pop("n").over(w)
    z = F.when(sd > 1e-3, (F.col("n") - F.avg("n").over(w)) / sd).otherwise(0.0)
    out = full.withColumn("z", z).withColumn("periodic", F.col("z") >= threshold)
    found = F.count_if("periodic").over(w)
    return out.select("weekday", "hour", "n", r4("z").alias("z"), "periodic", F.when(found >= 3, "strong").when(found >= 1, "possible").otherwise("none").alias("periodicity"))


def velocity(alerts: DataFrame, as_of: datetime, minutes: int, keys: list[str] | None = None) -> DataFrame:
    """Counts of the window before ``as_of`` and of the one before that, from one scan."""
    mid, start = as_of - timedelta(minutes=minutes), as_of - timedelta(minutes=2 * minutes)
    rows = alerts.where(in_window("ts", start, as_of))
    now = F.col("ts") >= F.lit(mid)
    out = (rows.groupBy(*keys) if keys else rows).agg(F.count_if(now).alias("current"), F.count_if(~now).alias("previous"))
    cur, prev = F.col("current"), F.col("previous")
    delta = F.when(prev > 0, (cur - prev) * 100.0 / prev).when(cur > 0, 100.0).otherwise(0.0)
    label = F.when((prev == 0) & (cur > 0), "new_activity").when(cur + prev == 0, "inactive").when(F.col("delta") > 25, "accelerating").when(F.col("delta") < -25, "decelerating").otherwise("stable")
    return out.withColumn("delta", r4(delta)).withColumn("trend", label)


def timeline(alerts: DataFrame, seconds: int, since: datetime, until: datetime) -> DataFrame:
    """Total, bands and the leading rule, address and agent of every bucket."""
    rows = alerts.where(in_window("ts", since, until)).withColumn("bucket", bucket("ts", seconds))
    counted = rows.groupBy("bucket").agg(F.count("*").alias("total"), *severity_counts())
    names = ("rule_id", "srcip", "agent_name")
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).cast("string").alias("value")) for x in names]))
    each = rows.select("bucket", pairs.alias("p")).select("bucket", "p.*").groupBy("bucket", "dimension", "value").agg(F.count("*").alias("n"))
    first = F.struct(-F.col("n"), F.col("value"))
    lead = each.groupBy("bucket").agg(*[F.min_by("value", F.when(F.col("dimension") == x, first)).alias(f"top_{x}") for x in names])
    counted = counted.join(lead, "bucket", "left")
    values = ["total", "low", "medium", "high"]
    full = zero_filled(counted.select("bucket", *values), "bucket", seconds, since, until, values)
    return full.join(counted.drop(*values), "bucket", "left")


def timeline_summary(series: DataFrame) -> DataFrame:
    """Peak, quietest bucket and shares of the bands."""
    one = series.agg(F.sum("total").alias("total"), *[F.sum(b).alias(b) for b in ("low", "medium", "high")], F.min_by("bucket", F.struct(-F.col("total"), F.col("bucket"))).alias("peak_at"), F.min_by("bucket", F.struct("total", "bucket")).alias("quietest_at"))
    return one.select("total", "peak_at", "quietest_at", *[r4(F.col(b) * 100.0 / F.greatest("total", F.lit(1))).alias(f"{b}_pct") for b in ("low", "medium", "high")])


def decay(last_seen: Column, as_of: datetime, half_life_hours: float = 168.0) -> Column:
    """Halves every ``half_life_hours``; 1 for the future and for unknown times."""
    age = (epoch(F.lit(as_of)) - epoch(last_seen)) / 3600.0
    return F.when(age <= 0, 1.0).otherwise(F.coalesce(F.pow(F.lit(2.0), -age / half_life_hours), F.lit(1.0)))


def recency_weight(ts: Column, as_of: datetime, window_minutes: float) -> Column:
    """0.5 at one scale (a quarter of the window, a minute at least), falling as a bell."""
    scale = max(60.0, window_minutes * 15.0)
    return F.pow(F.lit(0.5), F.pow((epoch(F.lit(as_of)) - epoch(ts)) / scale, F.lit(2.0)))
