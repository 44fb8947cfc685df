"""Joins in space: nearest raster cell, tolerance match, bilinear resampling, sampling weights, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airweave.functions.scalars import DEG_PER_KM, gaussian_weight

#: Most values of a raster axis that are broadcast: 1/1000 degree around the globe, 3 MB.
AXIS = 360_000
#: Buckets that a longer axis is sorted in.
BUCKETS = 16_384


def _axis(raster: DataFrame, column: str) -> DataFrame:
    return raster.select(F.col(column).cast("double").alias("v")).distinct()


def nearest_on_axis(points: DataFrame, axis: DataFrame, value: str, out: str, larger: bool = True) -> DataFrame:
    """``points`` with ``out``: the axis value nearest to ``value``; ties go to the larger (or else the smaller).

    The sorted axis is one row with an array, found by bisection. It is broadcast
    after its size has been checked; beyond ``AXIS`` values, points and axis are
    sorted together in buckets of equal width. Both give the same. A missing value
    has no nearest one.
    """
    n = axis.limit(AXIS + 1).count()
    if n <= AXIS:
        one = axis.agg(F.array_sort(F.collect_list("v")).alias("_axis"))
        near = F.when(F.col(value).isNotNull(), _bisect(F.col("_axis"), F.col(value), larger))
        return points.join(F.broadcast(one)).withColumn(out, near).drop("_axis")
    best = _between(points.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").distinct(), axis)
    low, high, v = F.col("low"), F.col("high"), F.col("v")
    closer = (v - low < high - v) | ((v - low == high - v) & F.lit(not larger))
    best = best.select("v", F.when(low.isNull(), high).when(high.isNull() | closer, low).otherwise(high).alias(out))
    return points.join(best, points[value] == best["v"], "left").drop("v")


def _buckets(axis: DataFrame):
    """Number of the bucket of a value, of ``BUCKETS`` equally wide ones from the smallest to the largest of ``axis``."""
    low, high = axis.agg(F.min("v"), F.max("v")).collect()[0]
    width = ((high - low) or 1.0) / BUCKETS
    return lambda v: F.least(F.greatest(F.floor((v - low) / width), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def _between(values: DataFrame, axis: DataFrame) -> DataFrame:
    """(v, low, high): for each distinct value the last axis value up to it and the first one from it on."""
    at = _buckets(axis)
    both = values.select("v", F.lit(None).cast("double").alias("a")).unionByName(axis.select("v", F.col("v").alias("a"))).withColumn("b", at(F.col("v")))
    own = Window.partitionBy("b").orderBy("v")
    upto = F.last("a", True).over(own.rangeBetween(Window.unboundedPreceding, 0))
    beyond = F.first("a", True).over(own.rangeBetween(0, Window.unboundedFollowing))
    inside = both.select("v", "a", "b", upto.alias("l"), beyond.alias("h")).where("a IS NULL")
    # at most BUCKETS rows: what lies before and after each bucket
    ends = axis.groupBy(at(F.col("v")).alias("b")).agg(F.min("v").alias("first"), F.max("v").alias("last"))
    every = axis.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(ends, "b", "left")
    order = Window.orderBy("b")
    ends = every.select("b", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    return inside.join(F.broadcast(ends), "b").select("v", F.coalesce("l", "before").alias("low"), F.coalesce("h", "after").alias("high"))


def _ranked(axis: DataFrame, name: str, number: str) -> DataFrame:
    """(name, number, number_n): the place of each value of an axis (v) of any length, from 0, and how many there are."""
    if axis.isEmpty():
        return axis.select(F.col("v").alias(name), F.lit(0).alias(number), F.lit(0).alias(f"{number}_n"))
    own = axis.withColumn("b", _buckets(axis)(F.col("v")))
    order = Window.orderBy("b")  # at most BUCKETS rows
    sizes = own.groupBy("b").agg(F.count("*").alias("n"))
    sizes = sizes.select("b", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("v")) - 1 + F.col("before")
    return own.join(F.broadcast(sizes), "b").select(F.col("v").alias(name), place.alias(number), F.col("all").alias(f"{number}_n"))


def _bisect(axis: Column, x: Column, larger: bool) -> Column:
    """Nearest item of a sorted array, in about 20 steps of a fold over halving strides."""
    n = F.size(axis)
    at = F.aggregate(F.array(*[F.lit(1 << k) for k in range(19, -1, -1)]), F.lit(0), lambda p, s: F.when((p + s <= n) & (F.try_element_at(axis, F.least(p + s, n)) <= x), p + s).otherwise(p))
    low, high = F.try_element_at(axis, F.greatest(at, F.lit(1))), F.try_element_at(axis, F.least(at + 1, n))
    closer = (x - low < high - x) | ((x - low == high - x) & F.lit(not larger))
    return F.when(at == 0, high).when(closer | (at >= n), low).otherwise(high)


def nearest_cell(points: DataFrame, raster: DataFrame, lat: str = "latitude", lon: str = "longitude", larger: bool = True, xy: tuple[float, float] | None = None) -> DataFrame:
    """``points`` with the raster's columns at the nearest latitude and, apart from it, the nearest longitude.

    ``xy`` (longitude, latitude) gives all points one cell.
    """
    if xy is not None:
        points = points.withColumns({"_x": F.lit(float(xy[0])), "_y": F.lit(float(xy[1]))})
    else:
        points = points.withColumns({"_x": F.col(lon).cast("double"), "_y": F.col(lat).cast("double")})
    points = nearest_on_axis(points, _axis(raster, lat), "_y", "cell_lat", larger)
    points = nearest_on_axis(points, _axis(raster, lon), "_x", "cell_lon", larger).drop("_x", "_y")
    cells = raster.withColumnsRenamed({lat: "cell_lat", lon: "cell_lon"})
    return points.join(cells, ["cell_lat", "cell_lon"], "left")


def snap(x: Column, origin: float, step: float) -> Column:
    """Nearest value of a regular axis, by arithmetic; ties go up."""
    return F.floor((x - origin) / step + 0.5) * step + origin


def tolerance_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tolerance: float = 0.005, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(left_key, right_key, distance): the nearest right point closer than ``tolerance`` degrees; ties go to the smaller key.

    Both sides fall into square buckets as wide as the tolerance; the left looks in
    its own and the eight around, so the join is on equal buckets.
    """
    b = lambda c: F.floor(F.col(c) / tolerance)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.select(F.col(left_key).alias("_l"), F.col(lat).alias("_y"), F.col(lon).alias("_x"), b(lat).alias("by"), b(lon).alias("bx")).withColumn("o", F.explode(around))
    a = a.select("_l", "_y", "_x", (F.col("by") + F.col("o.i")).alias("by"), (F.col("bx") + F.col("o.j")).alias("bx"))
    c = right.select(F.col(right_key).alias("_r"), F.col(lat).alias("_v"), F.col(lon).alias("_u"), b(lat).alias("by"), b(lon).alias("bx"))
    d = F.sqrt(F.pow(F.col("_y") - F.col("_v"), F.lit(2.0)) + F.pow(F.col("_x") - F.col("_u"), F.lit(2.0)))
    near = a.join(c, ["by", "bx"]).withColumn("distance", d).where(F.col("distance") < tolerance)
    best = near.groupBy("_l").agg(F.min(F.struct("distance", "_r")).alias("m"))
    return best.select(F.col("_l").alias(left_key), F.col("m._r").alias(right_key if right_key != left_key else f"{right_key}_right"), F.col("m.distance").alias("distance"))


def bilinear(cells: DataFrame, targets: DataFrame, value: str, step: float | list[float], lat: str = "latitude", lon: str = "longitude", lat0: float = 0.0, lon0: float = 0.0) -> DataFrame:
    """``targets`` with ``value`` between the four cells around; missing unless all four that count are there.

    ``step``: cell size, or sizes in latitude and longitude.
    """
    dy, dx = step if isinstance(step, list) else (step, step)
    fy, fx = (F.col(lat) - lat0) / dy, (F.col(lon) - lon0) / dx
    t = targets.withColumns({"_iy": F.floor(fy), "_ix": F.floor(fx), "_wy": fy - F.floor(fy), "_wx": fx - F.floor(fx)})
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = t.withColumn("_c", F.explode(corner)).withColumns({
        "_w": F.when(F.col("_c.i") == 1, F.col("_wy")).otherwise(1 - F.col("_wy")) * F.when(F.col("_c.j") == 1, F.col("_wx")).otherwise(1 - F.col("_wx")),
        "_iy": F.col("_iy") + F.col("_c.i"), "_ix": F.col("_ix") + F.col("_c.j"),
    }).where("_w > 0")
    grid = cells.select(F.round((F.col(lat) - lat0) / dy).cast("long").alias("_iy"), F.round((F.col(lon) - lon0) / dx).cast("long").alias("_ix"), F.col(value))
    joined = spread.join(grid, ["_iy", "_ix"], "left")
    return joined.groupBy(*targets.columns).agg(F.when(F.count(value) == F.count("*"), F.sum(F.col("_w") * F.col(value))).alias(value))


def points_to_grid(df: DataFrame, value: str, resolution: float = 0.1, order: str = "row_id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(iy, ix, value) of a regular grid from the smallest coordinates; in a cell the last row by ``order`` counts."""
    low = df.agg(F.min(lat).alias("_y0"), F.min(lon).alias("_x0"))
    at = df.join(F.broadcast(low)).select(F.floor((F.col(lat) - F.col("_y0")) / resolution).alias("iy"), F.floor((F.col(lon) - F.col("_x0")) / resolution).alias("ix"), value, order)
    return at.groupBy("iy", "ix").agg(F.max_by(value, order).alias(value))


def sampling_matrix(stations: DataFrame, grid: DataFrame, key: str = "station", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(flat_idx, station): the cell that each station reads; ties go to the smaller index."""
    near = stations.select(key, F.col(lat).cast("double").alias("_y"), F.col(lon).cast("double").alias("_x"))
    near = nearest_on_axis(near, _axis(grid, lat), "_y", "_cy", larger=False)
    near = nearest_on_axis(near, _axis(grid, lon), "_x", "_cx", larger=False)
    near = near.join(_ranked(_axis(grid, lat), "_cy", "_iy"), "_cy").join(_ranked(_axis(grid, lon), "_cx", "_ix"), "_cx")
    return near.select((F.col("_iy") * F.col("_ix_n") + F.col("_ix")).cast("long").alias("flat_idx"), key, F.lit(1.0).alias("weight"))


def weighted_sampling(stations: DataFrame, grid: DataFrame, key: str = "station", cell: str = "cell", radius_km: float = 2, sigma_km: float = 5, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(cell, station, weight): Gaussian weights of cells within the radius, 1 in total for each station that has any."""
    reach = radius_km * DEG_PER_KM
    b = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = stations.select(key, F.col(lat).alias("_y"), F.col(lon).alias("_x"), b(lat).alias("by"), b(lon).alias("bx")).withColumn("o", F.explode(around))
    s = s.select(key, "_y", "_x", (F.col("by") + F.col("o.i")).alias("by"), (F.col("bx") + F.col("o.j")).alias("bx"))
    g = grid.select(cell, F.col(lat).alias("_v"), F.col(lon).alias("_u"), b(lat).alias("by"), b(lon).alias("bx"))
    km = F.sqrt(F.pow(F.col("_y") - F.col("_v"), F.lit(2.0)) + F.pow(F.col("_x") - F.col("_u"), F.lit(2.0))) / DEG_PER_KM
    near = s.join(g, ["by", "bx"]).withColumn("km", km).where(F.col("km") <= radius_km).withColumn("w", gaussian_weight(F.col("km"), sigma_km))
    return near.select(cell, key, (F.col("w") / F.sum("w").over(Window.partitionBy(key))).alias("weight"))


def knn(points: DataFrame, key: str, k: int = 3, lat: str = "latitude", lon: str = "longitude", cell: float = 1.0) -> DataFrame:
    """(src, dst, distance) of the ``k`` nearest other points, ties to the smaller key.

    Rings of grid cells are searched outwards until no nearer point can be outside:
    each round joins on equal cells only the points that are not done.
    """
    p = points.select(F.col(key).alias("dst"), F.col(lat).alias("_v"), F.col(lon).alias("_u"), F.floor(F.col(lat) / cell).alias("by"), F.floor(F.col(lon) / cell).alias("bx"))
    todo = points.select(F.col(key).alias("src"), F.col(lat).alias("_y"), F.col(lon).alias("_x"))
    total = points.count()
    done, ring = None, 1
    while True:
        off = F.sequence(F.lit(-ring), F.lit(ring))
        s = todo.withColumn("by", F.explode(F.transform(off, lambda o: F.floor(F.col("_y") / cell) + o))).withColumn("bx", F.explode(F.transform(off, lambda o: F.floor(F.col("_x") / cell) + o)))
        d = F.sqrt(F.pow(F.col("_y") - F.col("_v"), F.lit(2.0)) + F.pow(F.col("_x") - F.col("_u"), F.lit(2.0)))
        near = s.join(p, ["by", "bx"]).where("src <> dst").select("src", "dst", d.alias("distance"))
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("rank") <= k)
        full = near.groupBy("src").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") >= min(k, total - 1)) & ((F.col("far") <= ring * cell) | F.lit(ring * cell > 720)))
        got = near.join(full.select("src"), "src", "left_semi")
        done = got if done is None else done.unionByName(got)
        todo = todo.join(full.select("src"), "src", "left_anti")
        if ring * cell > 720 or todo.isEmpty():
            return done
        ring *= 4
