"""Earlier forms of flags and reports, kept with their own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.functions.nulls import half_even
from airweave.functions.scalars import disagreement_share
from airweave.operators.temporal import hour_of


def qa_bam(df: DataFrame, start=None, ts: str = "ts", value: str = "conc", status: str = "Status") -> DataFrame:
    """Flag 1 for a status, then 2 for values *inside* 3..1000, which overrides; from ``start``, hourly means of all
    columns, flags too; 3 where the mean is missing."""
    flag = F.when((F.col(value) > 3) & (F.col(value) < 1000), 2.0).when(F.col(status) != 0, 1.0).otherwise(0.0)
    out = df.withColumn("flag", flag)
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    hourly = out.groupBy(hour_of(ts).alias(ts)).agg(F.avg(value).alias(value), F.avg(status).alias(status), F.avg("flag").alias("flag"))
    return hourly.withColumn("flag", F.when(F.col(value).isNull(), 3.0).otherwise(F.col("flag")))


def hourly_sensor(df: DataFrame, keys: list[str] = ("sensor",), values: list[str] = ("a", "b", "rh"), ts: str = "ts") -> DataFrame:
    """Each sensor's hourly means."""
    return df.groupBy(*keys, hour_of(ts).alias(ts)).agg(*[F.avg(v).alias(v) for v in values])


def flag_sensor(df: DataFrame, limit: float = 0.2) -> DataFrame:
    """1 for a missing channel, 2 for disagreement over the limit, which overrides."""
    apart = disagreement_share(F.col("a"), F.col("b"))
    return df.withColumns({"disagreement": apart, "flag": F.when(apart > limit, 2).when(F.col("a").isNull() | F.col("b").isNull(), 1).otherwise(0)})


def uptime_report(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Share of all rows in each flag and hour of day."""
    counts = df.groupBy(F.hour(ts).alias("hour"), "flag").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("hour", "flag", "n", (F.col("n") / F.col("total")).alias("share"))


def clean_sensor(df: DataFrame, keys: list[str] = ("sensor",), ts: str = "ts") -> DataFrame:
    """Hourly mean of the channels' mean, rounded to 2 digits, over rows without a flag."""
    good = flag_sensor(df).where("flag = 0").withColumn("pm", half_even((F.col("a") + F.col("b")) / 2, 2))
    return good.groupBy(*keys, hour_of(ts).alias(ts)).agg(F.avg("pm").alias("pm"), F.avg("rh").alias("rh"))


def network(df: DataFrame, value: str, sensors: list, ts: str = "ts", sensor: str = "sensor") -> DataFrame:
    """Wide table of named sensors' values by time."""
    return df.groupBy(ts).pivot(sensor, sensors).agg(F.avg(value))


def diff_network(df: DataFrame, sensors: list, ts: str = "ts") -> DataFrame:
    return network(df.withColumn("d", disagreement_share(F.col("a"), F.col("b"))), "d", sensors, ts)


def clean_network(df: DataFrame, sensors: list, value: str = "pm", ts: str = "ts") -> DataFrame:
    return network(clean_sensor(df, ts=ts), value, sensors, ts)
