"""Point feeds: beta-attenuation monitors, low-cost sensors, regulatory stations, optical counters, indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airweave.functions.nulls import half_even, nan_to_null, sum0
from airweave.functions.scalars import atm_to_cf1, disagreement, file_stem, from_epoch, site_sensor
from airweave.operators.spatial import points_to_grid
from airweave.operators.temporal import bucket, hour_of, keep_first, rounded_then_hourly
from airweave.sources.arrow_files import feather, files


def _hour_before(c):
    return c - F.expr("INTERVAL 1 HOUR")


# Beta-attenuation monitors


def bam_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, station, lines) of the CSV files whose first five lines hold ``Data Report``; station is the folder's name."""
    found = files(spark, path).where(F.lower("path").endswith(".csv"))
    lines = F.split(F.decode("content", "UTF-8"), "\r?\n")
    kept = found.select("path", lines.alias("lines")).where(F.exists(F.slice("lines", 1, 5), lambda x: F.trim(x) == "Data Report"))
    return kept.withColumn("station", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def read_bam(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """(station, ts, pm25, status): hourly mean of concentration and sum of status, stamped an hour earlier."""
    rows = bam_files(spark, path).select("station", F.element_at("lines", skip + 1).alias("head"), F.explode(F.slice("lines", skip + 2, 1 << 30)).alias("line")).where(F.trim("line") != "")
    names = F.transform(F.split("head", ","), lambda x: F.trim(x))
    cells = F.split("line", ",")
    get = lambda name: F.trim(F.try_element_at(cells, F.array_position(names, F.lit(name)).cast("int")))
    rows = rows.select("station", F.try_to_timestamp(get("Time")).cast("timestamp_ntz").alias("ts"), get("ConcHR(ug/m3)").try_cast("double").alias("conc"), get("Status").try_cast("long").alias("status"))
    return rows.where("ts IS NOT NULL").groupBy("station", _hour_before(hour_of("ts")).alias("ts")).agg(F.avg("conc").alias("pm25"), sum0(F.col("status")).alias("status"))


def read_bam_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sensor string, site string, latitude double, longitude double").option("header", True).option("enforceSchema", False).csv(path)


def format_bam(readings: DataFrame, meta: DataFrame) -> DataFrame:
    """(site, ts, pm25_bam, status, latitude, longitude): stations by site, mean of values and sum of status."""
    joined = readings.join(meta, readings["station"] == meta["sensor"])
    out = joined.groupBy("site", "ts").agg(F.avg("pm25").alias("pm25_bam"), sum0(F.col("status")).alias("status"))
    return out.join(meta.select("site", "latitude", "longitude").dropDuplicates(["site"]), "site")


# Low-cost sensors, hourly feed


def settlement_code(c):
    return F.when(c == "Large City", 2).when(c == "Small City", 1).otherwise(0)


def deployment_meta(history: DataFrame, keep_periods: bool = False, default_end: str = "2025-01-01") -> DataFrame:
    """Positions: one for each site and sensor, numbered from 0 by their joint name, with coordinates and codes."""
    sensor = next(c for c in history.columns if c.endswith("_identifier"))
    h = history.withColumn("site_sensor", site_sensor(F.col("site_id"), F.col(sensor)))
    if keep_periods:
        h = h.withColumn("discontinue_date", F.coalesce("discontinue_date", F.lit(default_end).cast("timestamp_ntz")))
    else:
        h = h.drop("effective_date", "discontinue_date").dropDuplicates()
    numbered = h.select("site_sensor").distinct().agg(F.array_sort(F.collect_list("site_sensor")).alias("a")).select(F.posexplode("a").alias("position", "site_sensor"))  # a deployment list
    return h.join(F.broadcast(numbered), "site_sensor").withColumn("settlement_code", settlement_code(F.col("settlement_type"))).withColumnsRenamed({
        "site_id": "site", sensor: "sensor", "settlement_name": "settlement", "site_latitude": "latitude", "site_longitude": "longitude",
        "site_district_name": "district", "site_state_name": "state", "all_land_uses": "land_use", "cluster_name": "cluster",
    })


def read_pa(spark: SparkSession, path: str, pattern: str = "*.feather") -> DataFrame:
    """All files of the hourly feed (but ``history.feather``) as (site_sensor, ts, a, b, rh); the sensor's name is in
    the column that ends in ``_identifier``."""
    schema = "observation_hour_start timestamp_ntz, sensor string, site_id string, pm25_atm_ch_a_average double, pm25_atm_ch_b_average double, humidity_average double"
    found = files(spark, path, pattern).where(~F.col("path").endswith("/history.feather"))
    raw = nan_to_null(feather(found, schema, endings={"sensor": "_identifier"}))
    return raw.select(site_sensor(F.col("site_id"), F.col("sensor")).alias("site_sensor"), F.col("observation_hour_start").alias("ts"), F.col("pm25_atm_ch_a_average").alias("a"), F.col("pm25_atm_ch_b_average").alias("b"), F.col("humidity_average").alias("rh"))


def format_pa(readings: DataFrame, meta: DataFrame, spline=None) -> DataFrame:
    """Hourly channels by position in CF1, humidity, disagreement, coordinates. Without a spline the feed must be CF1 already."""
    at = readings.join(F.broadcast(meta.select("site_sensor", "position").distinct()), "site_sensor")
    hourly = rounded_then_hourly(at, ["position"], ["a", "b", "rh"])
    if spline is not None:
        hourly = hourly.withColumns({c: atm_to_cf1(F.col(c), spline) for c in ("a", "b")})
    return hourly.withColumn("disagreement", disagreement(F.col("a"), F.col("b"))).join(meta, "position")


# Low-cost sensors, platform feed


def read_pr(spark: SparkSession, path: str) -> DataFrame:
    """(sensor_index, ts, a, b, rh, temperature): 2-minute means rounded to 2 digits, in local time; of repeated times the first file's."""
    names = ["timestamp", "rh", "temperature", "bscat_a", "bscat_b", "a", "b"]
    raw = nan_to_null(feather(files(spark, path, "sensor_*.feather"), ", ".join(["timestamp double", *(f"{n} double" for n in names[1:])]), names=names))
    at = raw.withColumns({"sensor_index": F.element_at(F.split(file_stem(F.col("path")), "_"), -1).try_cast("long"), "ts": from_epoch(F.col("timestamp"))})
    two = at.groupBy("sensor_index", "path", bucket("ts", 2).alias("ts")).agg(*[half_even(F.avg(c), 2).alias(c) for c in ("a", "b", "rh", "temperature")])
    return keep_first(two, ["sensor_index", "ts"], ["path"]).drop("path")


def format_pr(readings: DataFrame, history: DataFrame, respect_periods: bool = False) -> DataFrame:
    """Each sensor's series at every position that it had (or only in its periods there); later rows of the history win."""
    h = history.withColumn("_seq", F.row_number().over(Window.orderBy("effective_date", "sensor_index", "position")))  # a deployment list
    on = readings["sensor_index"] == h["sensor_index"]
    if respect_periods:
        on = on & (F.col("ts") >= F.col("effective_date")) & (F.col("ts") < F.col("discontinue_date"))
    joined = readings.join(h.select("sensor_index", "position", "effective_date", "discontinue_date", "_seq"), on).drop(h["sensor_index"])
    values = joined.groupBy("position", "ts").agg(*[F.max_by(c, "_seq").alias(c) for c in ("a", "b", "rh")])
    live = values.groupBy("position").agg((F.count("a") + F.count("b") + F.count("rh")).alias("n")).where("n > 0").select("position")
    out = values.join(live, "position", "left_semi").withColumn("disagreement", disagreement(F.col("a"), F.col("b")))
    return out.join(history.drop("effective_date", "discontinue_date", "sensor_index").dropDuplicates(["position"]), "position")


# Regulatory stations

POLLUTANTS = ["CO", "NO2", "SO2", "O3", "PM25", "PM10"]


def read_reg(spark: SparkSession, path: str, pollutants: list[str] = POLLUTANTS) -> DataFrame:
    """(location_name, ts, pollutant, value) of all ``*_<pollutant>_reg.feather``, in one scan."""
    raw = nan_to_null(feather(files(spark, path, "*_reg.feather"), "observation_hour_start timestamp_ntz, location_name string, average_value_in_hour double"))
    name = F.regexp_extract(file_stem(F.col("path")), r"_([A-Z0-9]+)_reg$", 1)
    return raw.select("location_name", F.col("observation_hour_start").alias("ts"), name.alias("pollutant"), F.col("average_value_in_hour").alias("value")).where(F.col("pollutant").isin(pollutants))


def read_reg_meta(spark: SparkSession, path: str) -> DataFrame:
    """Point features of a GeoJSON file: names and coordinates."""
    schema = "features array<struct<properties: struct<location_name: string, state_name: string, district_name: string, city_name: string>, geometry: struct<type: string, coordinates: array<double>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"))


def format_reg(readings: DataFrame, meta: DataFrame, pollutants: list[str] = POLLUTANTS) -> DataFrame:
    """Wide by pollutant: hourly mean, stamped an hour earlier, at the locations that the metadata know."""
    known = readings.join(meta.select("location_name").distinct(), "location_name", "left_semi")
    once = known.groupBy("location_name", "ts", "pollutant").agg(F.avg("value").alias("value"))
    wide = once.groupBy("location_name", _hour_before(hour_of("ts")).alias("ts")).pivot("pollutant", pollutants).agg(F.avg("value"))
    out = wide.join(meta.dropDuplicates(["location_name"]), "location_name")
    return out.withColumnsRenamed({p: p.lower() for p in pollutants} | {"location_name": "site", "state_name": "state", "district_name": "district", "city_name": "city"})


# Optical counters


def read_quantaq(spark: SparkSession, path: str) -> DataFrame:
    """Processed rows and flag rows one below the other, by hour: means, sum of flags, first serial number; hours with all PM."""
    done = nan_to_null(feather(files(spark, path, "*_processed.feather"), "time timestamp_ntz, pm1 double, pm25 double, pm10 double, `met.rh` double, `met.temp` double, sn string"))
    flags = feather(files(spark, path, "*.feather").where(~F.col("path").endswith("_processed.feather") & ~F.col("path").endswith("meta.feather")), "timestamp_local timestamp_ntz, flag long, sn string")
    return combine_quantaq(done.withColumnsRenamed({"time": "ts", "met.rh": "rh", "met.temp": "temp"}).drop("path"), flags.withColumnRenamed("timestamp_local", "ts").drop("path"))


def combine_quantaq(done: DataFrame, flags: DataFrame) -> DataFrame:
    both = done.unionByName(flags, allowMissingColumns=True)
    hourly = both.groupBy("sn", hour_of("ts").alias("ts")).agg(*[F.avg(c).alias(f"{c}_qaq") for c in ("pm1", "pm25", "pm10", "rh", "temp")], sum0(F.col("flag")).alias("flag_qaq"))
    return hourly.na.drop(subset=["pm1_qaq", "pm25_qaq", "pm10_qaq"]).withColumnRenamed("sn", "sensor")


def read_quantaq_meta(spark: SparkSession, path: str) -> DataFrame:
    """Sensor, site and coordinates of a ``meta.feather``."""
    return feather(files(spark, path, "meta.feather"), "sensor string, site string, latitude double, longitude double").drop("path")


def format_quantaq(readings: DataFrame, meta: DataFrame) -> DataFrame:
    return readings.join(meta, "sensor").drop("sensor")


# Indices on points


def read_rwi(spark: SparkSession, path: str) -> DataFrame:
    """(iy, ix, rwi) on a grid of 0.1 degree; of several points in a cell the last of the file counts."""
    raw = spark.read.schema("latitude double, longitude double, rwi double").option("header", True).csv(path)
    return points_to_grid(raw.withColumn("row_id", F.monotonically_increasing_id()), "rwi", 0.1)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
