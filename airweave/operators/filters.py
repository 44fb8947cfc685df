"""Trimming in time, clipping in space, and other row and column choices."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def trim(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; None is open."""
    for bound, keep in ((start, F.col(ts).__ge__), (end, F.col(ts).__le__)):
        if bound is not None:
            df = df.where(keep(F.lit(bound).cast("timestamp_ntz")))
    return df


def _edges(rings: list[Ring]):
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            yield float(x1), float(y1), float(x2), float(y2)


def in_polygon(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Even-odd test against constant rings (outer ones and holes alike), behind a bounding box that reaches the scan."""
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    edges = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in _edges(rings) if e[1] != e[3]])
    crossings = F.size(F.filter(edges, lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)))
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def in_polygon_column(x: Column, y: Column, rings: Column) -> Column:
    """The same with ``array<array<struct<x, y>>>`` rings from a column."""
    closed = F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))
    pairs = F.flatten(F.transform(closed, lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda p, q: F.struct(p.x.alias("x1"), p.y.alias("y1"), q.x.alias("x2"), q.y.alias("y2")))))
    return F.size(F.filter(pairs, lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1))) % 2 == 1


def clip_points(df: DataFrame, rings: list[Ring], key: str = "sensor", lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows of the keys that have a point inside; the polygon is tested once for each distinct point."""
    points = df.select(key, lon, lat).distinct()
    return df.join(points.where(in_polygon(F.col(lon), F.col(lat), rings)).select(key).distinct(), key, "left_semi")


def clip_raster(df: DataFrame, rings: list[Ring], lon: str = "longitude", lat: str = "latitude", all_touched: bool = False, half: float = 0.005) -> DataFrame:
    """Cells whose centre is inside; with ``all_touched`` also those that the outline crosses (``half`` a cell wide)."""
    x, y = F.col(lon), F.col(lat)
    inside = in_polygon(x, y, rings)
    if all_touched:
        inside = inside | reduce(lambda a, b: a | b, [_touches(x, y, half, e) for e in _edges(rings)])
    return df.where(inside)


def _touches(x: Column, y: Column, half: float, edge) -> Column:
    """Segment and cell overlap: in both boxes, and not all corners on one side of the line."""
    x1, y1, x2, y2 = edge
    side = lambda dx, dy: (x2 - x1) * (y + dy - y1) - (y2 - y1) * (x + dx - x1)
    corners = [side(dx, dy) for dx in (-half, half) for dy in (-half, half)]
    return x.between(min(x1, x2) - half, max(x1, x2) + half) & y.between(min(y1, y2) - half, max(y1, y2) + half) & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def trim_clip(df: DataFrame, start, end, rings: list[Ring]) -> DataFrame:
    """Trim, then clip by the entity that the table has: sensor, site, position, or raster cells."""
    df = trim(df, start, end) if "ts" in df.columns else df
    key = next((k for k in ("sensor", "site", "position") if k in df.columns), None)
    return clip_points(df, rings, key) if key else clip_raster(df, rings)


def fill_holes(rings: Column, least: float = 1000) -> Column:
    """Rings (outline first) without the holes of an area under ``least``."""
    def area(r):
        nxt = F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, 1, 1))
        return F.abs(F.aggregate(F.zip_with(r, nxt, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda a, v: a + v)) / 2

    return F.filter(rings, lambda r, i: (i == 0) | (area(r) >= least))


def not_equal(column: str, value) -> Column:
    """True for other values and for missing ones."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def drop_all_null(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(how="all", subset=subset)


def drop_empty_entities(df: DataFrame, key: str, value: str) -> DataFrame:
    """Without the keys that have no value at all."""
    return df.join(df.where(F.col(value).isNotNull()).select(key).distinct(), key, "left_semi")


def columns_with_prefix(df: DataFrame, prefix: str = "pa_raw_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def columns_matching(df: DataFrame, pattern: str = r"^(historical|fitted)_") -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def drop_nan(values: Column) -> Column:
    """An array without its missing and NaN items."""
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
