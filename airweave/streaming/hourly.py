"""Readings as they arrive: flags, hourly means with late data, islands as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.functions.scalars import disagreement
from airweave.operators.qa import qa_pa


def flagged(stream: DataFrame, dt: float = 40) -> DataFrame:
    """The batch flags, row by row."""
    return qa_pa(stream.withColumn("disagreement", disagreement(F.col("a"), F.col("b"))), dt)


def hourly_means(stream: DataFrame, late: str = "2 hours", keys: tuple[str, ...] = ("site",), ts: str = "ts") -> DataFrame:
    """Hourly mean of the channels of rows without a flag; an hour closes ``late`` after it."""
    good = flagged(stream).where("a_flag = 0 AND b_flag = 0").withColumn("_ts", F.col(ts).cast("timestamp"))
    out = good.withWatermark("_ts", late).groupBy(F.window("_ts", "1 hour"), *keys).agg(F.avg((F.col("a") + F.col("b")) / 2).alias("pm"), F.avg("rh").alias("rh"), F.count("*").alias("n"))
    return out.select(*keys, F.col("window.start").cast("timestamp_ntz").alias(ts), "pm", "rh", "n")


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ("sensor",), ts: str = "ts") -> DataFrame:
    """Stretches of readings that no pause longer than ``gap`` interrupts."""
    seen = stream.where("a IS NOT NULL OR b IS NOT NULL").withColumn("_ts", F.col(ts).cast("timestamp"))
    out = seen.withWatermark("_ts", late).groupBy(F.session_window("_ts", gap), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def to_parquet(result: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append closed windows to Parquet, each exactly once."""
    w = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
