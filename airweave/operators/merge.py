"""Merging datasets on shared keys: agree-or-fail, left-first, nearest and fixed-point merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.operators.spatial import nearest_cell, tolerance_match


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join; a column that both have takes the value that is there and fails the query where two values differ."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    r = right.withColumnsRenamed({c: f"_{c}" for c in shared})
    out = left.join(r, keys, "full")
    for c in shared:
        a, b = F.col(c), F.col(f"_{c}")
        clash = F.raise_error(F.concat(F.lit(f"conflicting values of {c}: "), a.cast("string"), F.lit(" and "), b.cast("string"))).cast(left.schema[c].dataType)
        out = out.withColumn(c, F.when(a.isNotNull() & b.isNotNull() & (a != b), clash).otherwise(F.coalesce(a, b))).drop(f"_{c}")
    return out


def merge_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: outer_merge(a, b, keys), frames)


def override_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join; a column that both have keeps the left one's values, missing ones too."""
    new = [c for c in right.columns if c not in left.columns or c in keys]
    return left.join(right.select(*new), keys, "full")


def raster_merge(points: DataFrame, raster: DataFrame, keys: str = "site", ts: str | None = "ts", xy=None) -> DataFrame:
    """Raster values at each key's nearest cell (and at each time, if the raster has any): (key[, ts], values)."""
    lat, lon = "latitude", "longitude"
    where = points.select(keys, lat, lon).distinct()
    cells = raster.select(lat, lon).distinct()
    at = nearest_cell(where, cells, xy=xy).select(keys, F.col("cell_lat").alias(lat), F.col("cell_lon").alias(lon))
    return at.join(raster, [lat, lon]).drop(lat, lon)


def merge_rasters(points: DataFrame, rasters: list[DataFrame], keys: str = "site", ts: str = "ts", xy=None) -> DataFrame:
    """Left-first merge of each raster's values at the keys, one after the other."""
    out = points
    for r in rasters:
        on = [keys, ts] if ts in r.columns else [keys]
        found = raster_merge(points, r, keys, ts, xy)
        new = [c for c in found.columns if c not in out.columns or c in on]
        out = out.join(found.select(*new), on, "full" if ts in r.columns else "left")
    return out


def point_merge(points: DataFrame, other: DataFrame, tolerance: float = 0.005, key: str = "site", other_key: str | None = None, ts: str = "ts", xy: str | None = None) -> DataFrame:
    """Each time of ``other``'s matched point beside the same time of a point; points without a match are dropped.

    ``xy`` names the one ``other`` point that all points take.
    """
    other_key = other_key or key
    right = other.withColumnsRenamed({c: f"{c}_merge" for c in other.columns if c != ts and c in points.columns})
    rk = f"{other_key}_merge" if other_key in points.columns else other_key
    lat, lon = ("latitude_merge", "longitude_merge") if "latitude" in points.columns else ("latitude", "longitude")
    sites = points.select(key, "latitude", "longitude").distinct()
    if xy is None:
        others = right.select(F.col(rk).alias("_other"), F.col(lat).alias("latitude"), F.col(lon).alias("longitude")).distinct()
        match = tolerance_match(sites, others, key, "_other", tolerance).select(key, "_other")
    else:
        match = sites.select(key, F.lit(xy).alias("_other"))
    return points.join(match, key).join(right.withColumnRenamed(rk, "_other"), ["_other", ts], "left").withColumnRenamed("_other", rk)


def semi_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_semi")


def with_dimension(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Lookup join; Spark broadcasts the dimension if its size allows."""
    return df.join(dim, key, "left")


def column_concat(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames side by side on their index."""
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def chunks(df: DataFrame, keys: list[str], rows: int = 1000, total: int | None = None) -> DataFrame:
    """A hint only: repartition by keys to about ``rows`` rows each where the total is known."""
    return df if total is None else df.repartition(max(1, -(-total // rows)), *keys)
