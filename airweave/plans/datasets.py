"""Air-quality shaped views of the synthetic tables, for queries and for SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airweave.functions.nulls import half_even
from airweave.functions.scalars import disagreement


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    """Six digits, halves to even: sums in another order then give the same value."""
    return half_even(c, 6)


def readings(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Two channels and humidity from ``events``; ``dense`` makes few sensors with many rows each."""
    return as_readings(table(spark, sf_dir, "events"), dense)


def as_readings(events: DataFrame, dense: bool = False) -> DataFrame:
    out = events.select(
        "event_id", "ts", (F.col("event_type") if dense else F.col("user_id")).alias("sensor"), F.concat(F.lit("site_"), (F.col("user_id") % 10).cast("string")).alias("site"), F.col("user_id").alias("position"),
        F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("a"), (F.col("value") * (1 + (F.col("event_id") % 21 - 10) / F.lit(17.0))).alias("b"), F.get_json_object("props", "$.k").cast("double").alias("rh"),
    )
    return out.withColumn("disagreement", disagreement(F.col("a"), F.col("b")))


READINGS = """readings AS (SELECT *, CASE WHEN a + b = 0 AND a <> b THEN 'infinity'::DOUBLE WHEN a + b = 0 THEN NULL ELSE abs(a - b) * 2 / abs(a + b) END * 100 AS disagreement FROM (
SELECT event_id, ts, {sensor} AS sensor, 'site_' || (user_id % 10) AS site, user_id AS position, CASE WHEN event_id % 13 <> 0 THEN value END AS a,
value * (1 + (event_id % 21 - 10) / 17.0::DOUBLE) AS b, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS rh FROM events))"""


def readings_sql(dense: bool = False) -> str:
    return READINGS.replace("{sensor}", "event_type" if dense else "user_id")


def pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("site"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("pm25"), (F.col("l_quantity") * (0.5 + F.col("l_linenumber") * 0.3)).alias("pm10"),
        (F.col("l_discount") * 1000).alias("no2"), (F.col("l_extendedprice") / 20).alias("co"), (F.col("l_tax") * 2500).alias("so2"), (F.col("l_extendedprice") / 200).alias("o3"),
    )


POLLUTANTS = "pollutants AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS site, l_shipdate AS ts, l_quantity AS pm25, l_quantity * (0.5::DOUBLE + l_linenumber * 0.3::DOUBLE) AS pm10, l_discount * 1000 AS no2, l_extendedprice / 20 AS co, l_tax * 2500 AS so2, l_extendedprice / 200 AS o3 FROM lineitem)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("station"), (20 + (F.col("s_suppkey") % 37) * F.lit(0.31)).alias("latitude"), (74 + (F.col("s_suppkey") % 41) * F.lit(0.37)).alias("longitude"))


STATIONS = "stations AS (SELECT s_suppkey AS station, 20 + (s_suppkey % 37) * 0.31::DOUBLE AS latitude, 74 + (s_suppkey % 41) * 0.37::DOUBLE AS longitude FROM supplier)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("cell"), (20 + F.floor(F.col("p_partkey") / 50) * F.lit(0.28)).alias("latitude"), (74 + (F.col("p_partkey") % 50) * F.lit(0.31)).alias("longitude"), F.col("p_retailprice").alias("population"))


GRID = "grid AS (SELECT p_partkey AS cell, 20 + (p_partkey // 50) * 0.28::DOUBLE AS latitude, 74 + (p_partkey % 50) * 0.31::DOUBLE AS longitude, p_retailprice AS population FROM part)"


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rh = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", "ts", ((F.col("event_id") % 19 - 9) * F.lit(0.5)).alias("u10"), ((F.col("event_id") % 23 - 11) * F.lit(0.5)).alias("v10"), (283 + rh * F.lit(0.2)).alias("t2m"), (283 + rh * F.lit(0.2) - F.col("event_id") % 17).alias("d2m"))


WEATHER = "weather AS (SELECT event_id, ts, (event_id % 19 - 9) * 0.5::DOUBLE AS u10, (event_id % 23 - 11) * 0.5::DOUBLE AS v10, 283 + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.2::DOUBLE AS t2m, 283 + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.2::DOUBLE - event_id % 17 AS d2m FROM events)"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, month, level): satellite-like means of ten settlements."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 10).alias("s"), F.month("o_orderdate").alias("month")).agg(r6(F.avg("o_totalprice") / 1000).alias("level"))


MONTHLY = "monthly AS (SELECT o_custkey % 10 AS s, month(o_orderdate) AS month, round_even(avg(o_totalprice) / 1000 * 1e6, 0) / 1e6 AS level FROM orders GROUP BY 1, 2)"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, h, month, value): hourly settlement means on a full grid of hours."""
    e = table(spark, sf_dir, "events")
    h = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) - 473352  # hours since 2024-01-01
    values = e.groupBy((F.col("user_id") % 10).alias("s"), h.cast("long").alias("h")).agg(r6(F.avg("value")).alias("value"))
    span = values.agg(F.max("h").alias("hi"))
    cells = span.select(F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("h")).join(spark.range(10).withColumnRenamed("id", "s"))
    month = F.month(F.timestamp_seconds((F.col("h") + 473352) * 3600))
    return cells.join(values, ["s", "h"], "left").select("s", "h", month.alias("month"), "value")


FIELD = """field_values AS (SELECT user_id % 10 AS s, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS h, round_even(avg(value) * 1e6, 0) / 1e6 AS value FROM events GROUP BY 1, 2),
field AS (SELECT y.s, x.h, month(make_timestamp((x.h + 473352) * 3600000000)) AS month, value FROM (SELECT unnest(range(0, (SELECT max(h) + 1 FROM field_values))) AS h) x CROSS JOIN (SELECT unnest(range(0, 10)) AS s) y LEFT JOIN field_values v ON v.s = y.s AND v.h = x.h)"""


def settlements(spark: SparkSession) -> DataFrame:
    """Coordinates of the ten settlements of :func:`field`."""
    return spark.range(10).select(F.col("id").alias("s"), (20 + F.col("id") % 3 * F.lit(0.4)).alias("latitude"), (74 + F.floor(F.col("id") / 3) * F.lit(0.5)).alias("longitude"))


SETTLEMENTS = "settlements AS (SELECT s, 20 + s % 3 * 0.4::DOUBLE AS latitude, 74 + s // 3 * 0.5::DOUBLE AS longitude FROM (SELECT unnest(range(0, 10)) AS s))"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("station", "v")).select("t", "station", F.col("v").cast("double").alias("value"))


MATRIX = "matrix AS (SELECT t, station, v::DOUBLE AS value FROM (SELECT vec_id AS t, unnest(range(0, 64)) AS station, unnest(embedding) AS v FROM embeddings))"
