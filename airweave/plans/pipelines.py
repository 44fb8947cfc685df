"""Merged products: reference, phases, collocation, deployment, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.functions.nulls import sum0
from airweave.functions.scalars import season
from airweave.operators.filters import drop_all_null, not_equal
from airweave.operators.merge import merge_all, merge_rasters, override_merge, point_merge
from airweave.operators.temporal import hour_of, label_phases, phases

FLAGS = ("a_flag", "b_flag", "rh_flag")


def merge_reference(points: list[DataFrame], rasters: list[DataFrame]) -> DataFrame:
    """Flagged point feeds (keys site, ts) merged where they agree, then rasters at each site's nearest cell."""
    return merge_rasters(merge_all(points, ["site", "ts"]), rasters)


def merge_phases(readings: DataFrame, starts: list, ends: list, site: str = "IITD") -> DataFrame:
    """One site's rows within numbered phases, with seasons; rows without any value are dropped."""
    at = drop_all_null(readings.where(F.col("site") == site), ["a", "b", "rh"])
    return label_phases(at, phases(readings.sparkSession, starts, ends)).withColumn("season", season(F.col("ts")))


def collocation(readings: DataFrame, settlement: str = "Delhi") -> DataFrame:
    """(site, ts): mean of both channels of all sensors, their coefficient of variation, humidity, disagreement, season.

    Channels are stacked within the aggregation's input, so each row is read and shuffled once.
    """
    at = readings.where(F.col("settlement") == settlement)
    stacked = at.withColumn("_v", F.explode(F.array("a", "b")))
    values = stacked.groupBy("site", "ts").agg(F.avg("_v").alias("pa_raw"), F.try_divide(F.stddev_samp("_v"), F.avg("_v")).alias("cv"), F.avg("rh").alias("rh"), F.avg("disagreement").alias("disagreement"))
    return drop_all_null(values, ["pa_raw", "cv", "rh", "disagreement"]).withColumn("season", season(F.col("ts")))


def merge_collocation(readings: DataFrame, reference: DataFrame, rasters: list[DataFrame] = (), legacy: DataFrame | None = None, settlement: str = "Delhi", tolerance: float = 0.005) -> DataFrame:
    """Hourly means (flags summed), collocation, the reference within tolerance, an optional earlier feed, rasters."""
    have = [f for f in FLAGS if f in readings.columns]
    keys = [c for c in ("site", "position", "settlement", "latitude", "longitude") if c in readings.columns]
    hourly = readings.groupBy(*keys, hour_of("ts").alias("ts")).agg(*[F.avg(c).alias(c) for c in ("a", "b", "rh", "disagreement")], *[sum0(F.col(f)).alias(f) for f in have])
    where = readings.groupBy("site").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    out = point_merge(collocation(hourly, settlement).join(where, "site"), reference, tolerance)
    if legacy is not None:
        out = override_merge(out, legacy, ["site", "ts"])
    return merge_rasters(out, list(rasters))


def deployment(readings: DataFrame, without: str = "IITD") -> DataFrame:
    """(site, ts): hourly mean and population std of the channels' mean, humidity, disagreement; of several positions
    at a site each value is the first one's that has it; coordinates of the first position."""
    at = readings.where(not_equal("site", without)).withColumn("pa_raw_mean", (F.col("a") + F.col("b")) / 2)
    hourly = at.groupBy("site", "position", hour_of("ts").alias("ts")).agg(F.avg("pa_raw_mean").alias("pa_raw_mean"), F.stddev_pop("pa_raw_mean").alias("pa_raw_std"), F.avg("rh").alias("rh"), F.avg("disagreement").alias("disagreement"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    out = hourly.groupBy("site", "ts").agg(*[first(c) for c in ("pa_raw_mean", "pa_raw_std", "rh", "disagreement")]).withColumn("season", season(F.col("ts")))
    dims = [c for c in ("latitude", "longitude", "settlement", "state", "district") if c in readings.columns]
    if dims:
        place = at.groupBy("site").agg(F.min_by(F.struct(*dims), "position").alias("d")).select("site", "d.*")
        out = out.join(place, "site")
    return out


def merge_deployment(readings: DataFrame, rasters: list[DataFrame], without: str = "IITD") -> DataFrame:
    return merge_rasters(deployment(readings, without), rasters)


def history(readings: DataFrame) -> DataFrame:
    """(sensor, ts): largest value across positions; times without any value are dropped."""
    top = readings.groupBy("sensor", "ts").agg(*[F.max(c).alias(c) for c in ("a", "b", "rh", "disagreement")])
    return drop_all_null(top, ["a", "b", "rh", "disagreement"]).withColumns({"pa_raw_mean": (F.col("a") + F.col("b")) / 2, "season": season(F.col("ts"))})


def merge_history(readings: DataFrame, path: str) -> DataFrame:
    """:func:`history`, written to ``path`` and read back."""
    made = history(readings)
    made.write.mode("overwrite").parquet(path)
    return readings.sparkSession.read.schema(made.schema).parquet(path)
