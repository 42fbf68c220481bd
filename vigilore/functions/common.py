"""Column and frame helpers used by all operators."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
DEFAULT_LOOK_BACK = timedelta(days=365)


def parse_time(text: str | datetime | None, as_of: datetime) -> datetime | None:
    """``15m``, ``24h``, ``7d``, ``4w`` before ``as_of``, an ISO time, or None if it cannot be read."""
    if isinstance(text, datetime) or text is None:
        return text
    if m := re.fullmatch(r"(\d+)([smhdw])", text.strip()):
        return as_of - timedelta(**{_UNITS[m[2]]: int(m[1])})
    try:
        return datetime.fromisoformat(text.strip().replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None


def window_of(since: str | datetime | None, until: str | datetime | None, as_of: datetime) -> tuple[datetime, datetime]:
    """Half-open window; 365 days back where ``since`` is missing or cannot be read."""
    end = parse_time(until, as_of) or as_of
    return parse_time(since, as_of) or end - DEFAULT_LOOK_BACK, end


def in_window(ts: Column | str, since: datetime, until: datetime) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts >= F.lit(since)) & (ts < F.lit(until))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def epoch(ts: Column | str) -> Column:
    """Seconds with fractions."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts) / 1e6


def bucket(ts: Column | str, seconds: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def auto_bucket_seconds(minutes: float) -> int:
    """Bucket of a report over ``minutes``: about a hundredth of it."""
    share = minutes / 100
    for limit, seconds in ((1, 60), (5, 300), (15, 900), (60, 3600), (360, 21600)):
        if share <= limit:
            return seconds
    return 86400


def correlation_bucket_seconds(minutes: float) -> int:
    for limit, seconds in ((60, 60), (360, 300), (1440, 900)):
        if minutes <= limit:
            return seconds
    return 3600


def count(name: str = "n") -> Column:
    return F.count("*").alias(name)


def top_n(df: DataFrame, keys: list[str], n: int, by: str = "n") -> DataFrame:
    """``n`` groups with the most rows; ties by key."""
    return df.groupBy(*keys).agg(count(by)).orderBy(F.desc(by), *keys).limit(n)


def top_k_per(df: DataFrame, outer: list[str], key: str, k: int, by: str = "n") -> DataFrame:
    """The ``k`` most frequent ``key`` inside each ``outer`` group, with ``rank``."""
    counted = df.groupBy(*outer, key).agg(count(by))
    order = Window.partitionBy(*outer).orderBy(F.desc(by), F.asc(key))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def severity_counts(level: str = "rule_level") -> list[Column]:
    """Bands: low below 5, medium 5 to 9, high from 10; empty bands are 0."""
    c = F.col(level)
    return [F.count_if(c < 5).alias("low"), F.count_if((c >= 5) & (c < 10)).alias("medium"), F.count_if(c >= 10).alias("high")]


def zero_filled(counts: DataFrame, time_col: str, seconds: int, since: datetime, until: datetime, values: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Every bucket from ``since`` to the one that holds ``until``; missing counts are 0.

    ``keys`` (distinct) asks for the full series of each key.
    """
    spark = counts.sparkSession
    lo, hi = (F.floor(F.unix_seconds(F.lit(t)) / seconds) for t in (since, until))
    grid = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("b")).select(F.timestamp_seconds(F.col("b") * seconds).alias(time_col))
    on = [time_col]
    if keys is not None:
        series = F.transform(F.sequence(lo, hi), lambda b: F.timestamp_seconds(b * seconds))
        grid, on = keys.withColumn(time_col, F.explode(series)), [*keys.columns, time_col]
    return grid.join(counts, on, "left").select(*on, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def r4(column: Column | str) -> Column:
    return F.round(column, 4)
