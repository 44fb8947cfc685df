"""Resampling, diel profiles, gaps, fills and other operators along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airweave.functions.nulls import half_even, sum0
from airweave.functions.scalars import season, wind_sector, wind_speed_class


def hour_of(ts: Column | str, unit: str = "hour") -> Column:
    """Start of the hour (or other unit), without a zone like its input."""
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def bucket(ts: Column | str, minutes: int) -> Column:
    """Start of the bucket of so many minutes, counted from the epoch."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    return F.timestamp_seconds(F.floor(F.unix_seconds(c) / (60 * minutes)) * 60 * minutes).cast("timestamp_ntz")


def resample(df: DataFrame, keys: list[str], aggs: dict[str, str], minutes: int = 60, ts: str = "ts") -> DataFrame:
    """Mean, sum (0 for nothing), std (of a sample), std_pop, first, min, max or count by bucket; empty buckets don't appear."""
    how = {
        "mean": F.avg, "sum": lambda c: sum0(F.col(c)), "std": F.stddev_samp, "std_pop": F.stddev_pop, "min": F.min, "max": F.max, "count": F.count,
        "first": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))),
    }
    return df.groupBy(*keys, bucket(ts, minutes).alias("bucket")).agg(*[how[f](c).alias(c) for c, f in aggs.items()]).withColumnRenamed("bucket", ts)


def rounded_then_hourly(df: DataFrame, keys: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    """Mean by exact time rounded to 2 digits, then the hour's mean of those: two levels, as readings repeat."""
    once = df.groupBy(*keys, ts).agg(*[half_even(F.avg(v), 2).alias(v) for v in values])
    return resample(once, keys, dict.fromkeys(values, "mean"), 60, ts)


def diel(df: DataFrame, value: str, by: list[str] = (), agg: str = "mean", ts: str = "ts") -> DataFrame:
    """Aggregate by hour of day; hour 0 is repeated as hour 24."""
    fn = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "sum": lambda c: sum0(F.col(c)), "min": F.min, "max": F.max, "count": F.count}[agg]
    by = list(by)
    out = df.groupBy(*by, F.hour(ts).alias("hour")).agg(fn(value).alias(value))
    return out.unionByName(out.where("hour = 0").withColumn("hour", F.lit(24)))


def normalized_diel(df: DataFrame, value: str, by: list[str] = (), agg: str = "mean", ts: str = "ts", strict_last_day: bool = True) -> DataFrame:
    """Diel profile of values over their day's mean.

    ``strict_last_day``: as where daily means are carried forward from midnight, on
    the last day of a series only midnight has a mean.
    """
    by = list(by)
    day = F.to_date(ts)
    mean = F.avg(value).over(Window.partitionBy(*by, day))
    if strict_last_day:
        last = F.max(day).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
        if not by:
            top = df.agg(F.max(day).alias("_last"))
            df, last = df.join(F.broadcast(top)), F.col("_last")  # one row
        mean = F.when((day < last) | (F.hour(ts) == 0), mean)
    return diel(df.withColumn(value, F.try_divide(F.col(value), mean)), value, by, agg, ts)


def with_season(df: DataFrame, ts: str = "ts", name: bool = True) -> DataFrame:
    return df.withColumn("season", season(F.col(ts), name))


def wind_rose(df: DataFrame, speed: str = "spd10", direction: str = "wd10") -> DataFrame:
    """Share of all rows in each class of speed and sector."""
    binned = df.select(wind_speed_class(F.col(speed)).alias("speed_class"), wind_sector(F.col(direction)).alias("sector")).where("speed_class IS NOT NULL AND sector IS NOT NULL")
    counts = binned.groupBy("speed_class", "sector").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("speed_class", "sector", (F.col("n") / F.col("total")).alias("frequency"))


def phases(spark, starts: list, ends: list) -> DataFrame:
    """(phase, start, end), numbered from 1: the table for :func:`label_phases`."""
    rows = [(i, str(a), str(b)) for i, (a, b) in enumerate(zip(starts, ends, strict=True), 1)]
    return spark.createDataFrame(rows, "phase int, start string, end string").select("phase", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"))


def phase_hours(table: DataFrame) -> DataFrame:
    """Every hour of each phase, both ends included."""
    return table.select("phase", F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 HOUR"))).alias("ts"))


def label_phases(df: DataFrame, table: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows within a phase and its number; phases are a handful of literal rows."""
    return df.join(F.broadcast(table), F.col(ts).between(F.col("start"), F.col("end"))).drop("start", "end")


def islands(df: DataFrame, columns: list[str], keys: list[str], ts: str = "ts", gap_length: int = 0) -> DataFrame:
    """``island`` of each row: runs of rows with and without any of ``columns``; NULL where all are missing.

    ``gap_length``: gaps of at most so many rows between others don't end an island.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumn("_empty", F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull())
    if gap_length:
        df = df.withColumn("_run", _runs(F.col("_empty"), w))
        run = Window.partitionBy(*keys, "_run")
        lasts = F.max("_run").over(Window.partitionBy(*keys))
        short = F.col("_empty") & (F.count("*").over(run) <= gap_length) & (F.col("_run") > 1) & (F.col("_run") < lasts)
        df = df.withColumn("_bridge", short).withColumn("_gap", F.col("_empty") & ~F.col("_bridge")).drop("_run", "_bridge")
    else:
        df = df.withColumn("_gap", F.col("_empty"))
    return df.withColumn("island", F.when(~F.col("_gap"), _runs(F.col("_gap"), w))).drop("_empty", "_gap")


def _runs(flag: Column, w) -> Column:
    """Number of the run of equal flags that a row is in, from 1."""
    return F.sum(F.when(flag.eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def island_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where("island IS NOT NULL").groupBy(*keys, "island").agg(F.count("*").alias("n"))


def ffill(value: str, keys: list[str], ts: str = "ts") -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))


def bfill(value: str, keys: list[str], ts: str = "ts") -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(0, Window.unboundedFollowing))


def diff(value: str, keys: list[str], ts: str = "ts", n: int = 1) -> Column:
    return F.col(value) - F.lag(value, n).over(Window.partitionBy(*keys).orderBy(ts))


def gaps(df: DataFrame, value: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """First and last time and length of each run of missing values."""
    w = Window.partitionBy(*keys).orderBy(ts)
    marked = df.withColumn("_run", _runs(F.col(value).isNull(), w)).where(F.col(value).isNull())
    return marked.groupBy(*keys, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")).drop("_run")


def interpolate_short(df: DataFrame, value: str, keys: list[str], ts: str = "ts", longest: int = 3) -> DataFrame:
    """Straight lines across gaps of at most ``longest`` rows that have values on both sides."""
    w = Window.partitionBy(*keys).orderBy(ts)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.col("_i"))
    df = df.withColumns({
        "_i0": F.last(known, ignorenulls=True).over(back), "_i1": F.first(known, ignorenulls=True).over(ahead),
        "_v0": F.last(value, ignorenulls=True).over(back), "_v1": F.first(value, ignorenulls=True).over(ahead),
    })
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    filled = F.when(F.col(value).isNull() & (F.col("_i1") - F.col("_i0") - 1 <= longest), line).otherwise(F.col(value))
    return df.withColumn(value, filled).drop("_i", "_i0", "_i1", "_v0", "_v1")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, ts: str = "ts", within: str | None = None) -> DataFrame:
    """The latest ``value`` at or before each row's time, by one union and window and no range join."""
    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_at": F.lit(None).cast("timestamp_ntz"), "_left": F.lit(1)}).unionByName(
        right.select(*keys, ts, F.col(value).alias("_v"), F.col(ts).alias("_at"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({value: F.last(F.when(F.col("_left") == 0, F.col("_v")), ignorenulls=True).over(w), "_at": F.last("_at", ignorenulls=True).over(w)}).where("_left = 1")
    if within:
        out = out.withColumn(value, F.when(F.col("_at") >= F.col(ts) - F.expr(f"INTERVAL {within}"), F.col(value)))
    return out.drop("_v", "_at", "_left")
