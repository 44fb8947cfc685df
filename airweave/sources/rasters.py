"""Raster feeds as cell tables (ts, latitude, longitude, values); canonical form on disk is Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airweave.functions.nulls import half_even, nan_to_null
from airweave.functions.scalars import celsius, local_time, name_suffix, relative_humidity, tile_date, tile_hour, wind_direction, wind_speed
from airweave.operators.filters import clip_raster
from airweave.operators.temporal import hour_of
from airweave.sources.arrow_files import files, geotiff, netcdf

#: Default boxes (west, south, east, north) and target step in degrees.
PLAIN, SUBCONTINENT, STEP = (73.29, 19.77, 91.05, 33.29), (64.28, 1.30, 97.24, 37.63), 0.01


def merge_expver(cells: DataFrame, values: list[str]) -> DataFrame:
    """One row for each time and place: version 1 where it has a value, else version 0 (or any other)."""
    if "expver" not in cells.columns:
        return cells
    keys = [c for c in cells.columns if c not in (*values, "expver", "number")]
    pick = lambda c: F.coalesce(F.max(F.when(F.col("expver") == 1, F.col(c))), F.max(F.when(F.col("expver") != 1, F.col(c)))).alias(c)
    return cells.groupBy(*keys).agg(*[pick(v) for v in values])


def format_era(cells: DataFrame, ts: str = "valid_time") -> DataFrame:
    """Reanalysis in local time: degrees C, humidity, wind speed and direction, then hourly means (a half hour is floored)."""
    c = merge_expver(nan_to_null(cells), ["t2m", "d2m", "u10", "v10"])
    c = c.withColumns({"ts": local_time(F.col(ts)), "t2m": celsius(F.col("t2m")), "d2m": celsius(F.col("d2m"))})
    c = c.withColumns({"rh2m": relative_humidity(F.col("t2m"), F.col("d2m")), "spd10": wind_speed(F.col("u10"), F.col("v10")), "wd10": wind_direction(F.col("u10"), F.col("v10"))})
    return c.groupBy(hour_of("ts").alias("ts"), "latitude", "longitude").agg(*[F.avg(v).alias(v) for v in ("t2m", "d2m", "u10", "v10", "rh2m", "spd10", "wd10")])


def read_era(spark: SparkSession, path: str) -> DataFrame:
    """``*_ERA5.nc`` files; valid_time in them is seconds since 1970."""
    raw = netcdf(files(spark, path, "*_ERA5.nc"), ["t2m", "d2m", "u10", "v10"], {"valid_time": "seconds", "latitude": "latitude", "longitude": "longitude"})
    return format_era(raw.withColumn("valid_time", F.timestamp_seconds("seconds").cast("timestamp_ntz")).drop("seconds", "path"))


def target_grid(spark: SparkSession, box: tuple[float, float, float, float], step: float = STEP) -> DataFrame:
    """All points of a regular grid in a box."""
    west, south, east, north = box
    axis = lambda a, b, n: spark.range(round((b - a) / step) + 1).select(F.round(F.lit(a) + F.col("id") * step, 6).alias(n))
    return axis(south, north, "latitude").join(axis(west, east, "longitude"))  # the grid itself


def regrid(cells: DataFrame, value: str, box=PLAIN, source_step: float = 0.1, step: float = STEP) -> DataFrame:
    """Tiles on a regular grid of ``source_step`` brought to ``step`` by bilinear weights, clipped and rounded to 2 digits.

    The box, widened by half a degree, is a filter on the scan before anything else.
    """
    west, south, east, north = box
    near = cells.where(F.col("latitude").between(south - 0.5, north + 0.5) & F.col("longitude").between(west - 0.5, east + 0.5))
    tiles = near.select("ts").distinct()
    targets = tiles.join(target_grid(cells.sparkSession, box, step))
    origin = near.agg(F.min("latitude").alias("y"), F.min("longitude").alias("x")).collect()[0]
    if origin["y"] is None:
        return near.select("ts", "latitude", "longitude", value)
    return bilinear_by_time(near, targets, value, source_step, origin["y"], origin["x"]).withColumn(value, half_even(F.col(value), 2))


def bilinear_by_time(cells: DataFrame, targets: DataFrame, value: str, step: float, lat0: float, lon0: float) -> DataFrame:
    """``targets`` with ``value`` between the four cells around at the same time; dropped unless all that count are there."""
    fy, fx = (F.col("latitude") - lat0) / step, (F.col("longitude") - lon0) / step
    t = targets.withColumns({"_iy": F.floor(fy + 1e-9), "_ix": F.floor(fx + 1e-9)}).withColumns({"_wy": F.greatest(fy - F.col("_iy"), F.lit(0.0)), "_wx": F.greatest(fx - F.col("_ix"), F.lit(0.0))})
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = t.withColumn("_c", F.explode(corner)).withColumns({
        "_w": F.when(F.col("_c.i") == 1, F.col("_wy")).otherwise(1 - F.col("_wy")) * F.when(F.col("_c.j") == 1, F.col("_wx")).otherwise(1 - F.col("_wx")),
        "_iy": F.col("_iy") + F.col("_c.i"), "_ix": F.col("_ix") + F.col("_c.j"),
    }).where("_w > 1e-9")
    grid = cells.select("ts", F.round((F.col("latitude") - lat0) / step).cast("long").alias("_iy"), F.round((F.col("longitude") - lon0) / step).cast("long").alias("_ix"), F.col(value))
    out = spread.join(grid, ["ts", "_iy", "_ix"]).groupBy("ts", "latitude", "longitude").agg(F.sum("_w").alias("_t"), F.sum(F.col("_w") * F.col(value)).alias(value))
    return out.where("_t > 1 - 1e-6").drop("_t")


def read_gee(spark: SparkSession, path: str, box=PLAIN, source_step: float = 0.1) -> DataFrame:
    """``gee_<product>`` folders of tiles: a column for each product, full join on time and place."""
    cells = nan_to_null(geotiff(files(spark, path, "*.tif")))
    product = name_suffix(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "gee_")
    cells = cells.select(tile_date(F.col("path")).cast("timestamp_ntz").alias("ts"), half_even(F.col("y"), 3).alias("latitude"), half_even(F.col("x"), 3).alias("longitude"), product.alias("product"), "value")
    names = sorted(r[0] for r in cells.select("product").distinct().collect())  # folder names
    return wide_products({n: regrid(cells.where(F.col("product") == n).drop("product"), "value", box, source_step) for n in names})


def wide_products(products: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in products.items():
        df = df.withColumnRenamed("value", name)
        out = df if out is None else out.join(df, ["ts", "latitude", "longitude"], "full")
    return out


def read_tropomi(spark: SparkSession, path: str, box=PLAIN, source_step: float = 0.05) -> DataFrame:
    """NO2 column tiles by hour."""
    cells = nan_to_null(geotiff(files(spark, path, "*.tif")))
    cells = cells.select(tile_hour(F.col("path")).alias("ts"), half_even(F.col("y"), 3).alias("latitude"), half_even(F.col("x"), 3).alias("longitude"), F.col("value").alias("no2_column"))
    return regrid(cells, "no2_column", box, source_step)


def read_martin(spark: SparkSession, path: str, box=SUBCONTINENT, source_step: float = 0.1) -> DataFrame:
    """Monthly PM2.5 tiles, stamped 01:00 on the first of the month that ``TIMECOVERAGE`` names."""
    raw = nan_to_null(netcdf(files(spark, path, "*.nc"), ["PM25"], {"lat": "latitude", "lon": "longitude"}, ("TIMECOVERAGE",)))
    when = F.make_timestamp_ntz(F.substring("TIMECOVERAGE", 1, 4).try_cast("int"), F.substring("TIMECOVERAGE", 5, 2).try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0))
    return regrid(raw.select(when.alias("ts"), "latitude", "longitude", F.col("PM25").alias("pm25_cnn")), "pm25_cnn", box, source_step)


def read_ghsl(spark: SparkSession, path: str, rings) -> DataFrame:
    """Population cells (in degrees) within a country's outline."""
    cells = nan_to_null(geotiff(files(spark, path, "*.tif"))).select(F.col("y").alias("latitude"), F.col("x").alias("longitude"), F.col("value").alias("population"))
    return clip_raster(cells, rings)


def read_cells(spark: SparkSession, path: str, box=None) -> DataFrame:
    """A Parquet cell table; the box is pushed to the scan."""
    cells = spark.read.parquet(path)
    if box is None:
        return cells
    west, south, east, north = box
    return cells.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells by month, so that a period prunes files."""
    cells.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("month").sortWithinPartitions("latitude", "longitude").write.mode("overwrite").partitionBy("month").parquet(path)


__all__ = ["format_era", "merge_expver", "read_cells", "read_era", "read_gee", "read_ghsl", "read_martin", "read_tropomi", "regrid", "target_grid", "wide_products", "write_cells"]
