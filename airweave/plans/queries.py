"""The query catalogue: each operator over the synthetic tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airweave.functions import scalars
from airweave.functions.nulls import half_even, sum0
from airweave.operators import baseline, blocks, bootstrap, calibration, car, filters, gpr, legacy, memd, merge, metrics, pod, qa, spatial, temporal
from airweave.plans import datasets as d
from airweave.plans import pipelines
from airweave.plans.datasets import r6
from airweave.session import shared_path
from airweave.sources import rasters
from airweave.streaming import hourly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def R(x: str) -> str:  # noqa: N802
    """SQL of :func:`airweave.plans.datasets.r6`."""
    return f"round_even(({x}) * 1e6, 0) / 1e6"


READ, DENSE = d.readings_sql(), d.readings_sql(True)
FLAG = "CASE WHEN {x} IS NULL THEN 1 WHEN {x} < {lo} OR {x} > {hi} THEN 2 {extra} ELSE 0 END"


def flag_sql(x: str, lo, hi, extra: str = "") -> str:
    return FLAG.format(x=x, lo=lo, hi=hi, extra=extra and f"WHEN {extra} THEN 3")


FLAGGED = f"flagged AS (SELECT *, {flag_sql('a', 5, 500, 'disagreement > 40')} AS a_flag, {flag_sql('b', 5, 500, 'disagreement > 40')} AS b_flag, {flag_sql('rh', 0, 100)} AS rh_flag FROM readings)"


# Flags


@query(f"WITH {READ}, {FLAGGED} SELECT event_id, a_flag, b_flag, rh_flag FROM flagged")
def qa_channel_flags(spark, sf):
    return qa.qa_pa(d.readings(spark, sf)).select("event_id", "a_flag", "b_flag", "rh_flag")


@query(
    f"WITH {d.POLLUTANTS} SELECT k, n, "
    + ", ".join((f"CASE WHEN pm25 > pm10 THEN 3 ELSE {flag_sql(p, lo, hi)} END" if p in ("pm25", "pm10") else flag_sql(p, lo, hi)) + f" AS {p}_flag" for p, (lo, hi) in qa.LIMITS.items())
    + " FROM pollutants"
)
def qa_pollutant_flags(spark, sf):
    return qa.qa_reg(d.pollutants(spark, sf)).select("k", "n", *[f"{p}_flag" for p in qa.LIMITS])


@query(f"WITH {READ} SELECT event_id, {flag_sql('a', 3, 1000, 'event_id % 7 > 5')} AS a_flag FROM readings")
def qa_monitor_flags(spark, sf):
    return qa.qa_bam(d.readings(spark, sf).withColumn("status", F.greatest(F.col("event_id") % 7 - 5, F.lit(0))), "a").select("event_id", "a_flag")


@query(f"WITH {d.GRID} SELECT cell, CASE WHEN p IS NULL THEN 1 WHEN p = 0 THEN 2 ELSE 0 END AS p_flag, CASE WHEN q IS NULL THEN 1 WHEN q <= 0 THEN 2 ELSE 0 END AS q_flag, CASE WHEN cell % 5 > 3 THEN 2 ELSE 0 END AS qaq_flag FROM (SELECT cell, CASE WHEN cell % 11 > 0 THEN population * (cell % 3) END AS p, CASE WHEN cell % 11 > 0 THEN population * (cell % 3 - 1) END AS q FROM grid)")
def qa_cell_flags(spark, sf):
    g = d.grid(spark, sf)
    some = F.col("cell") % 11 > 0
    g = g.select("cell", F.when(some, F.col("population") * (F.col("cell") % 3)).alias("p"), F.when(some, F.col("population") * (F.col("cell") % 3 - 1)).alias("q"), F.greatest(F.col("cell") % 5 - 3, F.lit(0)).alias("flag_qaq"))
    return qa.qa_quantaq(qa.qa_tropomi(qa.qa_ghsl(g, "p"), "q")).select("cell", "p_flag", "q_flag", "qaq_flag")


# Resampling and profiles


@query(f"WITH {READ}, {FLAGGED} SELECT site, date_trunc('hour', ts) AS ts, {R('avg((a + b) / 2)')} AS pm_mean, {R('stddev_pop((a + b) / 2)')} AS pm_std, {R('avg(rh)')} AS rh_mean, count(*) AS n FROM flagged WHERE a_flag = 0 AND b_flag = 0 GROUP BY 1, 2")
def hourly_site_mean(spark, sf):
    good = qa.qa_pa(d.readings(spark, sf)).where("a_flag = 0 AND b_flag = 0")
    pm = (F.col("a") + F.col("b")) / 2
    return good.groupBy("site", temporal.hour_of("ts").alias("ts")).agg(r6(F.avg(pm)).alias("pm_mean"), r6(F.stddev_pop(pm)).alias("pm_std"), r6(F.avg("rh")).alias("rh_mean"), F.count("*").alias("n"))


@query(f"WITH {READ} SELECT sensor, time_bucket(INTERVAL 2 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, round_even(avg(b) * 100, 0) / 100 AS b FROM readings GROUP BY 1, 2")
def resample_2min(spark, sf):
    out = temporal.resample(d.readings(spark, sf), ["sensor"], {"b": "mean"}, 2)
    return out.select("sensor", "ts", half_even(F.col("b"), 2).alias("b"))


@query(f"WITH {READ} SELECT sensor, date_trunc('hour', ts) AS ts, {R('coalesce(sum(a), 0)')} AS total FROM readings GROUP BY 1, 2")
def hourly_sum_zero_fill(spark, sf):
    return d.readings(spark, sf).groupBy("sensor", temporal.hour_of("ts").alias("ts")).agg(r6(sum0(F.col("a"))).alias("total"))


SEASON = "CASE WHEN month({t}) <= 2 THEN {a} WHEN month({t}) <= 5 THEN {b} WHEN month({t}) <= 9 THEN {c} ELSE {e} END"
SEASON_NAME = lambda t: SEASON.format(t=t, a="'Winter'", b="'Pre-Monsoon'", c="'Monsoon'", e="'Post-Monsoon'")


@query(f"WITH {d.POLLUTANTS} SELECT {SEASON_NAME('ts')} AS season, {R('avg(pm25)')} AS pm25, {R('stddev_samp(pm10)')} AS pm10_std, count(*) AS n FROM pollutants GROUP BY 1")
def season_summary(spark, sf):
    return temporal.with_season(d.pollutants(spark, sf)).groupBy("season").agg(r6(F.avg("pm25")).alias("pm25"), r6(F.stddev_samp("pm10")).alias("pm10_std"), F.count("*").alias("n"))


AQI = "CASE WHEN {x} > 250 THEN 5 WHEN {x} > 120 THEN 4 WHEN {x} > 90 THEN 3 WHEN {x} > 60 THEN 2 WHEN {x} > 30 THEN 1 ELSE 0 END"


@query(f"WITH {READ} SELECT {AQI.format(x='a')} AS aqi, count(*) AS n FROM readings GROUP BY 1")
def aqi_histogram(spark, sf):
    return d.readings(spark, sf).groupBy(scalars.aqi_code(F.col("a")).alias("aqi")).agg(F.count("*").alias("n"))


@query(f"WITH {READ}, p AS (SELECT site, hour(ts)::INTEGER AS hour, avg(b) AS b FROM readings GROUP BY 1, 2) SELECT site, hour, {R('b')} AS b FROM (SELECT * FROM p UNION ALL SELECT site, 24, b FROM p WHERE hour = 0)")
def diel_profile(spark, sf):
    return temporal.diel(d.readings(spark, sf), "b", ["site"]).select("site", "hour", r6(F.col("b")).alias("b"))


@query(
    f"WITH {DENSE}, m AS (SELECT sensor, ts, b, ts::DATE AS day, avg(b) OVER (PARTITION BY sensor, ts::DATE) AS mean, max(ts::DATE) OVER (PARTITION BY sensor) AS last FROM readings), "
    f"p AS (SELECT sensor, hour(ts)::INTEGER AS hour, avg(CASE WHEN day < last OR hour(ts) = 0 THEN b / nullif(mean, 0) END) AS b FROM m GROUP BY 1, 2) SELECT sensor, hour, {R('b')} AS b FROM (SELECT * FROM p UNION ALL SELECT sensor, 24, b FROM p WHERE hour = 0)"
)
def normalized_diel(spark, sf):
    return temporal.normalized_diel(d.readings(spark, sf, True), "b", ["sensor"]).select("sensor", "hour", r6(F.col("b")).alias("b"))


@query(f"WITH {READ} SELECT site, date_trunc('hour', ts) AS ts, {R('avg(b)')} AS b FROM (SELECT site, ts, round_even(avg(b) * 100, 0) / 100 AS b FROM readings GROUP BY 1, 2) GROUP BY 1, 2")
def two_level_mean(spark, sf):
    return temporal.rounded_then_hourly(d.readings(spark, sf), ["site"], ["b"]).select("site", "ts", r6(F.col("b")).alias("b"))


# Weather

TURNED = "((wd - 90) - 360 * floor((wd - 90) / 360.0))"
DERIVED = f"""derived AS (SELECT event_id, ts, u10, v10, t2m - 273.15::DOUBLE AS t, d2m - 273.15::DOUBLE AS dew, sqrt(u10 * u10 + v10 * v10) AS spd,
round_even(degrees(atan2(-u10, -v10)) - 360 * floor(degrees(atan2(-u10, -v10)) / 360.0), 0) AS wd FROM weather),
binned AS (SELECT *, CASE WHEN ceil({TURNED} / 11.25) >= 1 THEN CAST((floor(ceil({TURNED} / 11.25) / 2) - 1 + 16) % 16 AS INTEGER) END AS sector, CASE WHEN ceil(spd) BETWEEN 1 AND 5 THEN CAST(ceil(spd) - 1 AS INTEGER) END AS speed_class FROM derived)"""


def _weather(spark, sf):
    w = d.weather(spark, sf)
    return w.withColumns({"spd10": scalars.wind_speed(F.col("u10"), F.col("v10")), "wd10": scalars.wind_direction(F.col("u10"), F.col("v10"))})


@query(f"WITH {d.WEATHER}, {DERIVED} SELECT event_id, wd AS wd10, sector, speed_class FROM binned")
def wind_bins(spark, sf):
    return _weather(spark, sf).select("event_id", "wd10", scalars.wind_sector(F.col("wd10")).alias("sector"), scalars.wind_speed_class(F.col("spd10")).alias("speed_class"))


@query(f"WITH {d.WEATHER}, {DERIVED}, c AS (SELECT speed_class, sector, count(*) AS n FROM binned WHERE speed_class IS NOT NULL AND sector IS NOT NULL GROUP BY 1, 2) SELECT speed_class, sector, {R('n / (SELECT sum(n) FROM c)')} AS frequency FROM c")
def wind_rose_freq(spark, sf):
    return temporal.wind_rose(_weather(spark, sf)).withColumn("frequency", r6(F.col("frequency")))


@query(f"WITH {d.WEATHER}, {DERIVED} SELECT event_id, {R('100 * exp(17.625 * dew / (243.04 + dew)) / exp(17.625 * t / (243.04 + t))')} AS rh2m, {R('spd')} AS spd10 FROM derived")
def rh_magnus(spark, sf):
    w = _weather(spark, sf)
    return w.select("event_id", r6(scalars.relative_humidity(scalars.celsius(F.col("t2m")), scalars.celsius(F.col("d2m")))).alias("rh2m"), r6(F.col("spd10")).alias("spd10"))


@query(
    f"WITH {d.WEATHER} SELECT date_trunc('hour', ts + INTERVAL '330 minutes') AS ts, latitude, longitude, {R('avg(t2m - 273.15)')} AS t2m, {R('avg(sqrt(u10 * u10 + v10 * v10))')} AS spd10, count(*) AS n FROM (SELECT *, (event_id % 3)::DOUBLE AS latitude, (event_id % 2)::DOUBLE AS longitude FROM weather) GROUP BY 1, 2, 3"
)
def reanalysis_hourly(spark, sf):
    w = d.weather(spark, sf).withColumns({"latitude": (F.col("event_id") % 3).cast("double"), "longitude": (F.col("event_id") % 2).cast("double")})
    out = rasters.format_era(w.drop("event_id"), "ts")
    n = w.groupBy(temporal.hour_of(scalars.local_time(F.col("ts"))).alias("ts"), "latitude", "longitude").agg(F.count("*").alias("n"))
    return out.join(n, ["ts", "latitude", "longitude"]).select("ts", "latitude", "longitude", r6(F.col("t2m")).alias("t2m"), r6(F.col("spd10")).alias("spd10"), "n")


# Shape


@query(f"WITH {d.POLLUTANTS} SELECT site, " + ", ".join(f"{R(f'avg(CASE WHEN n = {i} THEN pm25 END)')} AS p{i}" for i in range(1, 5)) + " FROM pollutants GROUP BY 1")
def pivot_pollutants(spark, sf):
    wide = d.pollutants(spark, sf).groupBy("site").pivot("n", [1, 2, 3, 4]).agg(F.avg("pm25"))
    return wide.select("site", *[r6(F.col(str(i))).alias(f"p{i}") for i in range(1, 5)])


@query(f"WITH {READ} SELECT event_id, 'a' AS channel, a AS value FROM readings UNION ALL SELECT event_id, 'b', b FROM readings")
def melt_channels(spark, sf):
    return d.readings(spark, sf).unpivot(["event_id"], ["a", "b"], "channel", "value")


@query(f"WITH {READ} SELECT sensor, count(*) AS n, min(ts) AS first, {R('max_by(b, (ts, event_id))')} AS last_b FROM readings GROUP BY 1")
def last_write_wins(spark, sf):
    return d.readings(spark, sf).groupBy("sensor").agg(F.count("*").alias("n"), F.min("ts").alias("first"), r6(F.max_by("b", F.struct("ts", "event_id"))).alias("last_b"))


@query(f"WITH {READ} SELECT sensor, day, event_id FROM (SELECT sensor, ts::DATE AS day, event_id, row_number() OVER (PARTITION BY sensor, ts::DATE ORDER BY ts, event_id) AS r FROM readings) WHERE r = 1")
def keep_first_of_day(spark, sf):
    return temporal.keep_first(d.readings(spark, sf).withColumn("day", F.to_date("ts")), ["sensor", "day"], ["ts", "event_id"]).select("sensor", "day", "event_id")


# Merges


@query(f"WITH {READ}, l AS (SELECT event_id, b AS pm FROM readings WHERE event_id % 3 <> 0), r AS (SELECT event_id, b AS pm, rh FROM readings WHERE event_id % 3 <> 1) SELECT event_id, coalesce(l.pm, r.pm) AS pm, rh FROM l FULL JOIN r USING (event_id)")
def outer_merge_reference(spark, sf):
    r = d.readings(spark, sf)
    left, right = r.where("event_id % 3 <> 0").select("event_id", F.col("b").alias("pm")), r.where("event_id % 3 <> 1").select("event_id", F.col("b").alias("pm"), "rh")
    return merge.outer_merge(left, right, ["event_id"]).select("event_id", "pm", "rh")


@query(f"WITH {READ}, l AS (SELECT event_id, a AS pm FROM readings WHERE event_id % 3 <> 0), r AS (SELECT event_id, b AS pm, rh FROM readings WHERE event_id % 3 <> 1) SELECT event_id, l.pm, rh FROM l FULL JOIN r USING (event_id)")
def override_merge(spark, sf):
    r = d.readings(spark, sf)
    left, right = r.where("event_id % 3 <> 0").select("event_id", F.col("a").alias("pm")), r.where("event_id % 3 <> 1").select("event_id", F.col("b").alias("pm"), "rh")
    return merge.override_merge(left, right, ["event_id"]).select("event_id", "pm", "rh")


NEAREST = "(SELECT min_by(v, (abs(v - s.{c}), {sign}v)) FROM (SELECT DISTINCT {c} AS v FROM grid))"


@query(f"WITH {d.STATIONS}, {d.GRID}, n AS (SELECT station, {NEAREST.format(c='latitude', sign='-')} AS cell_lat, {NEAREST.format(c='longitude', sign='-')} AS cell_lon FROM stations s) SELECT station, {R('cell_lat')} AS cell_lat, {R('cell_lon')} AS cell_lon, population FROM n LEFT JOIN grid g ON g.latitude = cell_lat AND g.longitude = cell_lon")
def nearest_cell(spark, sf):
    out = spatial.nearest_cell(d.stations(spark, sf), d.grid(spark, sf).drop("cell"))
    return out.select("station", r6(F.col("cell_lat")).alias("cell_lat"), r6(F.col("cell_lon")).alias("cell_lon"), "population")


@query(
    f"WITH {d.STATIONS}, t AS (SELECT station + 100000 AS other, latitude + (station % 3) * 0.002::DOUBLE AS latitude, longitude + (station % 5) * 0.001::DOUBLE AS longitude FROM stations), p AS (SELECT station, other, sqrt(pow(s.latitude - t.latitude, 2) + pow(s.longitude - t.longitude, 2)) AS distance FROM stations s, t) "
    f"SELECT station, other, {R('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY distance, other) AS r FROM p WHERE distance < 0.005) WHERE r = 1"
)
def tolerance_match(spark, sf):
    s = d.stations(spark, sf)
    t = s.select((F.col("station") + 100000).alias("other"), (F.col("latitude") + (F.col("station") % 3) * F.lit(0.002)).alias("latitude"), (F.col("longitude") + (F.col("station") % 5) * F.lit(0.001)).alias("longitude"))
    return spatial.tolerance_match(s, t, "station", "other").withColumn("distance", r6(F.col("distance")))


@query(
    f"WITH {d.STATIONS}, {d.GRID}, p AS (SELECT cell, station, sqrt(pow(s.latitude - g.latitude, 2) + pow(s.longitude - g.longitude, 2)) * 111 AS km FROM stations s, grid g WHERE abs(s.latitude - g.latitude) < 0.5 AND abs(s.longitude - g.longitude) < 0.5) "
    f"SELECT cell, station, {R('exp(-0.5 * pow(km / 20, 2)) / sum(exp(-0.5 * pow(km / 20, 2))) OVER (PARTITION BY station)')} AS weight FROM p WHERE km <= 30"
)
def weighted_sampling(spark, sf):
    return spatial.weighted_sampling(d.stations(spark, sf), d.grid(spark, sf), radius_km=30, sigma_km=20).withColumn("weight", r6(F.col("weight")))


@query(
    f"WITH {d.STATIONS}, {d.GRID}, la AS (SELECT latitude AS v, row_number() OVER (ORDER BY latitude) - 1 AS i FROM (SELECT DISTINCT latitude FROM grid)), lo AS (SELECT longitude AS v, row_number() OVER (ORDER BY longitude) - 1 AS i FROM (SELECT DISTINCT longitude FROM grid)) "
    f"SELECT (SELECT min_by(i, (abs(v - s.latitude), v)) FROM la) * (SELECT count(*) FROM lo) + (SELECT min_by(i, (abs(v - s.longitude), v)) FROM lo) AS flat_idx, station FROM stations s"
)
def sampling_matrix(spark, sf):
    return spatial.sampling_matrix(d.stations(spark, sf), d.grid(spark, sf)).select("flat_idx", "station")


@query(
    f"WITH {d.STATIONS}, {d.GRID}, g AS (SELECT CAST(round((latitude - 20) / 0.28) AS BIGINT) AS iy, CAST(round((longitude - 74) / 0.31) AS BIGINT) AS ix, population FROM grid), "
    f"t AS (SELECT station, (latitude - 20) / 0.28::DOUBLE AS fy, (longitude - 74) / 0.31::DOUBLE AS fx FROM stations), c AS (SELECT station, CAST(floor(fy) AS BIGINT) + i AS iy, CAST(floor(fx) AS BIGINT) + j AS ix, CASE i WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END * CASE j WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END AS w FROM t, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) "
    f"SELECT station, CASE WHEN count(population) = count(*) THEN {R('sum(w * population)')} END AS population FROM c LEFT JOIN g USING (iy, ix) WHERE w > 0 GROUP BY 1"
)
def bilinear_cells(spark, sf):
    s = spatial.bilinear(d.grid(spark, sf).select("latitude", "longitude", "population"), d.stations(spark, sf), "population", [0.28, 0.31], lat0=20, lon0=74)
    return s.select("station", r6(F.col("population")).alias("population"))


@query(f"WITH {d.STATIONS}, c AS (SELECT CAST(floor((latitude - (SELECT min(latitude) FROM stations)) / 0.1) AS BIGINT) AS iy, CAST(floor((longitude - (SELECT min(longitude) FROM stations)) / 0.1) AS BIGINT) AS ix, station FROM stations) SELECT iy, ix, max(station) AS station FROM c GROUP BY 1, 2")
def points_to_grid(spark, sf):
    s = d.stations(spark, sf).withColumn("row_id", F.col("station"))
    return spatial.points_to_grid(s, "station", 0.1).select("iy", "ix", "station")


PHASES = [("2024-01-03 00:00:00", "2024-01-08 12:00:00"), ("2024-01-15 00:00:00", "2024-01-20 00:00:00")]


@query(f"WITH {READ} SELECT event_id, CASE WHEN ts BETWEEN TIMESTAMP '{PHASES[0][0]}' AND TIMESTAMP '{PHASES[0][1]}' THEN 1 ELSE 2 END AS phase FROM readings WHERE ts BETWEEN TIMESTAMP '{PHASES[0][0]}' AND TIMESTAMP '{PHASES[0][1]}' OR ts BETWEEN TIMESTAMP '{PHASES[1][0]}' AND TIMESTAMP '{PHASES[1][1]}'")
def phase_label(spark, sf):
    t = temporal.phases(spark, [p[0] for p in PHASES], [p[1] for p in PHASES])
    return temporal.label_phases(d.readings(spark, sf), t).select("event_id", "phase")


@query(f"SELECT p AS phase, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (VALUES (1, TIMESTAMP '{PHASES[0][0]}', TIMESTAMP '{PHASES[0][1]}'), (2, TIMESTAMP '{PHASES[1][0]}', TIMESTAMP '{PHASES[1][1]}')) v(p, a, b)")
def phase_hours(spark, sf):
    return temporal.phase_hours(temporal.phases(spark, [p[0] for p in PHASES], [p[1] for p in PHASES]))


@query(
    f"WITH {READ}, s AS (SELECT site, ts, v, rh, disagreement FROM (SELECT site, ts, a AS v, rh, disagreement FROM readings UNION ALL SELECT site, ts, b, rh, disagreement FROM readings)) "
    f"SELECT site, ts, {R('avg(v)')} AS pa_raw, {R('stddev_samp(v) / nullif(avg(v), 0)')} AS cv, {R('avg(rh)')} AS rh, {SEASON_NAME('ts')} AS season FROM s GROUP BY site, ts"
)
def collocation_cv(spark, sf):
    out = pipelines.collocation(d.readings(spark, sf).withColumn("settlement", F.lit("Delhi")))
    return out.select("site", "ts", r6(F.col("pa_raw")).alias("pa_raw"), r6(F.col("cv")).alias("cv"), r6(F.col("rh")).alias("rh"), "season")


@query(
    f"WITH {READ}, h AS (SELECT site, position, date_trunc('hour', ts) AS ts, avg((a + b) / 2) AS m, stddev_pop((a + b) / 2) AS sd, avg(rh) AS rh FROM readings WHERE site IS DISTINCT FROM 'site_3' GROUP BY 1, 2, 3) "
    f"SELECT site, ts, {R('min_by(m, position) FILTER (WHERE m IS NOT NULL)')} AS pa_raw_mean, {R('min_by(sd, position) FILTER (WHERE sd IS NOT NULL)')} AS pa_raw_std, {R('min_by(rh, position) FILTER (WHERE rh IS NOT NULL)')} AS rh, {SEASON_NAME('ts')} AS season FROM h GROUP BY site, ts"
)
def deployment_hourly(spark, sf):
    out = pipelines.deployment(d.readings(spark, sf), "site_3")
    return out.select("site", "ts", *[r6(F.col(c)).alias(c) for c in ("pa_raw_mean", "pa_raw_std", "rh")], "season")


@query(f"WITH {READ} SELECT sensor, ts, max(a) AS a, max(b) AS b, (max(a) + max(b)) / 2 AS pa_raw_mean, {SEASON_NAME('ts')} AS season FROM readings GROUP BY sensor, ts HAVING max(a) IS NOT NULL OR max(b) IS NOT NULL OR max(rh) IS NOT NULL OR max(disagreement) IS NOT NULL")
def sensor_history_max(spark, sf):
    return pipelines.history(d.readings(spark, sf)).select("sensor", "ts", "a", "b", "pa_raw_mean", "season")


@query(
    f"WITH {READ}, {d.STATIONS}, {d.GRID}, h AS (SELECT site, date_trunc('hour', ts) AS ts, avg(b) AS b FROM readings GROUP BY 1, 2), st AS (SELECT 'site_' || station AS site, latitude, longitude FROM stations WHERE station < 10), "
    f"n AS (SELECT site, {NEAREST.format(c='latitude', sign='-')} AS la, {NEAREST.format(c='longitude', sign='-')} AS lo FROM st s) SELECT h.site, h.ts, {R('b')} AS b, population FROM h JOIN st USING (site) JOIN n USING (site) LEFT JOIN grid g ON g.latitude = la AND g.longitude = lo"
)
def merge_reference_rasters(spark, sf):
    h = d.readings(spark, sf).groupBy("site", temporal.hour_of("ts").alias("ts")).agg(r6(F.avg("b")).alias("b"))
    st = d.stations(spark, sf).where("station < 10").select(F.concat(F.lit("site_"), F.col("station").cast("string")).alias("site"), "latitude", "longitude")
    return pipelines.merge_reference([h.join(st, "site")], [d.grid(spark, sf).drop("cell")]).select("site", "ts", "b", "population")


# Clips

TRIANGLE = [[(75.0, 20.5), (87.0, 21.5), (80.0, 31.0)], [(79.0, 23.0), (82.0, 23.0), (80.5, 26.0)]]
EDGES = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for x1, y1, x2, y2 in filters._edges(TRIANGLE))
INSIDE = f"(SELECT count(*) FROM (VALUES {EDGES}) e(x1, y1, x2, y2) WHERE (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1"


@query(f"WITH {d.STATIONS} SELECT station FROM stations WHERE {INSIDE}")
def clip_points_polygon(spark, sf):
    return filters.clip_points(d.stations(spark, sf), TRIANGLE, "station").select("station")


@query(f"WITH {d.GRID} SELECT cell, population FROM grid WHERE {INSIDE}")
def clip_raster_polygon(spark, sf):
    return filters.clip_raster(d.grid(spark, sf), TRIANGLE).select("cell", "population")


@query(f"WITH {READ} SELECT event_id FROM readings WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 06:00:00'")
def time_trim(spark, sf):
    return filters.trim(d.readings(spark, sf), "2024-01-05 00:00:00", "2024-01-09 06:00:00").select("event_id")


HALF = 0.14
OUTLINE = f"EXISTS (SELECT 1 FROM (VALUES {EDGES}) e(x1, y1, x2, y2) WHERE longitude BETWEEN least(x1, x2) - {HALF} AND greatest(x1, x2) + {HALF} AND latitude BETWEEN least(y1, y2) - {HALF} AND greatest(y1, y2) + {HALF} AND least({{c}}) <= 0 AND greatest({{c}}) >= 0)"
CORNERS = ", ".join(f"(x2 - x1) * (latitude + ({dy}) - y1) - (y2 - y1) * (longitude + ({dx}) - x1)" for dx in (-HALF, HALF) for dy in (-HALF, HALF))


@query(f"WITH {d.GRID} SELECT cell FROM grid WHERE {INSIDE} OR {OUTLINE.format(c=CORNERS)}")
def clip_raster_touched(spark, sf):
    return filters.clip_raster(d.grid(spark, sf), TRIANGLE, all_touched=True, half=HALF).select("cell")


PLACES = "places AS (SELECT 'site_' || station AS site, latitude, longitude FROM stations WHERE station < 10)"


def _places(spark, sf):
    return d.stations(spark, sf).where("station < 10").select(F.concat(F.lit("site_"), F.col("station").cast("string")).alias("site"), "latitude", "longitude")


@query(f"WITH {READ}, {d.STATIONS}, {PLACES} SELECT event_id FROM readings JOIN places USING (site) WHERE {INSIDE} AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-19 06:00:00'")
def trim_clip_sensors(spark, sf):
    r = d.readings(spark, sf).join(_places(spark, sf), "site")
    return filters.trim_clip(r, "2024-01-05 00:00:00", "2024-01-19 06:00:00", TRIANGLE).select("event_id")


@query(f"WITH {READ} SELECT event_id, site, sensor FROM readings WHERE site <> 'site_3' AND (a IS NOT NULL OR disagreement IS NOT NULL) AND sensor IN (SELECT sensor FROM readings WHERE a IS NOT NULL)")
def row_filters(spark, sf):
    r = filters.drop_all_null(d.readings(spark, sf).where(filters.not_equal("site", "site_3")), ["a", "disagreement"])
    return filters.drop_empty_entities(r, "sensor", "a").select("event_id", "site", "sensor")


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings")
def finite_items(spark, sf):
    e = d.table(spark, sf, "embeddings")
    some = F.transform("embedding", lambda x: F.when(x > 0, x).when(x < -0.1, F.lit(float("nan"))))
    return e.select("vec_id", F.size(filters.drop_nan(some)).alias("n"))


@query(f"WITH {READ} SELECT event_id, x.a, y.b, z.rh FROM (SELECT event_id, a FROM readings WHERE event_id % 2 = 0) x FULL JOIN (SELECT event_id, b FROM readings WHERE event_id % 3 = 0) y USING (event_id) FULL JOIN (SELECT event_id, rh FROM readings WHERE event_id % 5 = 0) z USING (event_id)")
def columns_side_by_side(spark, sf):
    r = d.readings(spark, sf)
    return merge.column_concat([r.where(f"event_id % {n} = 0").select("event_id", c) for n, c in ((2, "a"), (3, "b"), (5, "rh"))], ["event_id"])


@query(f"WITH {READ}, {d.STATIONS}, {PLACES} SELECT event_id, site, {R('latitude')} AS latitude, {R('longitude')} AS longitude FROM readings LEFT JOIN places USING (site) WHERE site IN (SELECT site FROM places WHERE latitude > 21)")
def known_with_places(spark, sf):
    places = _places(spark, sf)
    r = merge.semi_known(d.readings(spark, sf), places.where("latitude > 21"), "site")
    return merge.with_dimension(r, places, "site").select("event_id", "site", r6(F.col("latitude")).alias("latitude"), r6(F.col("longitude")).alias("longitude"))


@query(f"WITH {READ}, {d.STATIONS}, {PLACES}, h AS (SELECT site, date_trunc('hour', ts) AS ts, {R('avg(b)')} AS b, {R('avg(rh)')} AS rh FROM readings GROUP BY 1, 2) SELECT p.site, p.ts, p.b, 'o_' || p.site AS other, o.rh AS pm FROM h p JOIN places USING (site) LEFT JOIN (SELECT * FROM h WHERE hour(ts) % 2 = 0) o ON o.site = p.site AND o.ts = p.ts")
def point_merge_nearby(spark, sf):
    """Hours of each place beside those of a point a thousandth of a degree away, which reports every other hour."""
    h = d.readings(spark, sf).groupBy("site", temporal.hour_of("ts").alias("ts")).agg(r6(F.avg("b")).alias("b"), r6(F.avg("rh")).alias("rh")).join(_places(spark, sf), "site")
    other = h.where(F.hour("ts") % 2 == 0).select(F.concat(F.lit("o_"), F.col("site")).alias("other"), "ts", F.col("rh").alias("pm"), (F.col("latitude") + F.lit(0.001)).alias("latitude"), "longitude")
    out = merge.point_merge(h.drop("rh"), other, key="site", other_key="other")
    return out.select("site", "ts", "b", "other", "pm")


# Calibration

PRED = {n: f"b * {p}::DOUBLE + rh * ({q}::DOUBLE) + {i}::DOUBLE" for n, (p, q, i) in calibration.HISTORICAL.items()}


def _raw(spark, sf):
    return d.readings(spark, sf).withColumn("pa_raw_b", F.col("b"))


@query(f"WITH {READ} SELECT event_id, {R(PRED['campmier_delhi'])} AS pm, {R('b * 1.2::DOUBLE / (1 + 0.3::DOUBLE * (rh / 100) / (1 - rh / 100))')} AS grown FROM readings")
def calibrate_models(spark, sf):
    r = _raw(spark, sf)
    grown = calibration.Fitted("nonlinear", (1.2, 0.3)).column(F.col("pa_raw_b"), F.col("rh"))
    return r.select("event_id", r6(calibration.apply_historical(r, "campmier_delhi")).alias("pm"), r6(grown).alias("grown"))


@query(f"WITH {READ}, p AS (SELECT event_id, unnest([{', '.join(PRED.values())}]) AS v FROM readings) SELECT event_id, round_even(avg(v) * 1e9, 0) / 1e9 AS pred_mean, round_even(median(v) * 1e9, 0) / 1e9 AS pred_median, {R('stddev_samp(v)')} AS pred_std FROM p GROUP BY 1")
def calibrate_ensemble(spark, sf):
    digits = {"mean": 9, "median": 9, "std": 6}  # the first two have at most 8 digits, so nothing is halfway
    return calibration.predict_all(_raw(spark, sf)).select("event_id", *[half_even(F.col(f"pred_{k}"), n).alias(f"pred_{k}") for k, n in digits.items()])


MOMENTS = "SELECT site, count(*) AS n, avg(b) AS ma, avg(rh) AS mb, avg(a) AS my, var_pop(b) AS aa, var_pop(rh) AS bb, covar_pop(b, rh) AS ab, covar_pop(b, a) AS ay, covar_pop(rh, a) AS bya FROM readings WHERE a IS NOT NULL AND b IS NOT NULL AND rh IS NOT NULL GROUP BY site"


@query(f"WITH {READ}, m AS ({MOMENTS}), s AS (SELECT *, (ay * bb - bya * ab) / (aa * bb - ab * ab) AS p, (bya * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM m) SELECT site, n, {R('p')} AS b_pa, {R('q')} AS b_rh, {R('my - p * ma - q * mb')} AS b_int FROM s")
def ols_by_site(spark, sf):
    out = calibration.fit_linear(_raw(spark, sf), ["site"], "pa_raw_b", target="a")
    return out.select("site", "n", *[r6(F.col(c)).alias(c) for c in ("b_pa", "b_rh", "b_int")])


@query()
def nonlinear_fit_by_site(spark, sf):
    out = calibration.fit_nonlinear(_raw(spark, sf), ["site"], "pa_raw_b", target="a")
    return out.select("site", "n", r6(F.col("alpha")).alias("alpha"), r6(F.col("beta")).alias("beta"))


# Scores

SCORES = {"n": "count(*)", "r2": "1 - avg((a - b) * (a - b)) / var_pop(a)", "mae": "avg(abs(a - b))", "rmse": "sqrt(avg((a - b) * (a - b)))", "mbe": "avg(a - b)", "nmae": "avg(abs(a - b)) / avg(a) * 100", "nrmse": "sqrt(avg((a - b) * (a - b))) / avg(a) * 100", "nmbe": "avg(a - b) / avg(a) * 100", "adj_r2": "1 - (1 - (1 - avg((a - b) * (a - b)) / var_pop(a))) * (count(*) - 1) / (count(*) - 2)"}


@query(f"WITH {READ} SELECT site, " + ", ".join(f"{x if k == 'n' else R(x)} AS {k}" for k, x in SCORES.items()) + " FROM readings WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY site")
def eval_metrics(spark, sf):
    out = metrics.evaluate(d.readings(spark, sf), "a", "b", ["site"])
    return out.select("site", *[F.col(k) if k == "n" else r6(F.col(k)).alias(k) for k in SCORES])


@query(f"WITH {READ} SELECT sensor % 7 AS g, {R('CASE WHEN count(CASE WHEN b IS NOT NULL THEN a END) < 168 THEN -1 ELSE 1 - avg((a - b) * (a - b)) / var_pop(CASE WHEN b IS NOT NULL THEN a END) END')} AS r2 FROM readings GROUP BY 1")
def r2_by_group(spark, sf):
    return metrics.group_r2(d.readings(spark, sf).withColumn("g", F.col("sensor") % 7), ["g"]).select("g", r6(F.col("r2")).alias("r2"))


@query(f"WITH {DENSE}, v AS (SELECT date_trunc('hour', ts) AS t, sensor, avg(b) AS v FROM readings GROUP BY 1, 2), m AS (SELECT sensor, avg(v) AS m FROM v GROUP BY 1) SELECT x.sensor AS i, y.sensor AS j, {R('avg(x.v - y.v) / any_value(m) * 100')} AS nmbe FROM v x JOIN v y USING (t) JOIN m ON m.sensor = x.sensor GROUP BY 1, 2")
def bias_matrix(spark, sf):
    v = d.readings(spark, sf, True).groupBy(temporal.hour_of("ts").alias("t"), "sensor").agg(F.avg("b").alias("v"))
    return metrics.bias_matrix(v, "t", "sensor", "v").withColumn("nmbe", r6(F.col("nmbe")))


@query(f"SELECT {R('avg(r)')} AS balanced_accuracy FROM (SELECT quality, avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END) AS r FROM labels WHERE quality IS NOT NULL GROUP BY 1)")
def balanced_accuracy(spark, sf):
    return metrics.balanced_accuracy(d.table(spark, sf, "labels").withColumn("h", 1 - F.col("toxic")), "quality", "h").select(r6(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query(f"WITH {READ} SELECT site, count(CASE WHEN n >= 60 THEN 1 END) AS n_sensors FROM (SELECT site, sensor, count(a) AS n FROM readings GROUP BY 1, 2) GROUP BY 1")
def sensors_reporting(spark, sf):
    return metrics.count_sensors(d.readings(spark, sf), "a", ["site"], least=60)


# Gaps


@query(f"WITH {d.FIELD}, f AS (SELECT *, value IS NULL AS e FROM field), r AS (SELECT *, sum(CASE WHEN e = p THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY h) AS island FROM (SELECT *, lag(e) OVER (PARTITION BY s ORDER BY h) AS p FROM f)) SELECT s, island, count(*) AS n FROM r WHERE NOT e GROUP BY 1, 2")
def gap_islands(spark, sf):
    return temporal.island_sizes(temporal.islands(d.field(spark, sf), ["value"], ["s"], "h"), ["s"])


@query(f"WITH {d.FIELD}, r AS (SELECT *, sum(CASE WHEN (value IS NULL) = p THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY h) AS run FROM (SELECT *, lag(value IS NULL) OVER (PARTITION BY s ORDER BY h) AS p FROM field)) SELECT s, min(h) AS start, max(h) AS \"end\", count(*) AS length FROM r WHERE value IS NULL GROUP BY s, run")
def gap_runs(spark, sf):
    return temporal.gaps(d.field(spark, sf), "value", ["s"], "h")


KNOWN = "k AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN h END) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h0, min(CASE WHEN value IS NOT NULL THEN h END) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h1, last_value(value IGNORE NULLS) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0, first_value(value IGNORE NULLS) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM field)"


@query(f"WITH {d.FIELD}, {KNOWN} SELECT s, h, {R('CASE WHEN value IS NULL AND h1 - h0 - 1 <= 3 THEN v0 + (v1 - v0) * (h - h0) / (h1 - h0) ELSE value END')} AS value FROM k")
def short_gap_interp(spark, sf):
    return temporal.interpolate_short(d.field(spark, sf), "value", ["s"], "h").select("s", "h", r6(F.col("value")).alias("value"))


@query(f"WITH {d.FIELD}, {KNOWN} SELECT s, h, v0 AS forward, v1 AS backward, {R('value - lag(value) OVER (PARTITION BY s ORDER BY h)')} AS step FROM k")
def fills(spark, sf):
    f = d.field(spark, sf)
    return f.select("s", "h", temporal.ffill("value", ["s"], "h").alias("forward"), temporal.bfill("value", ["s"], "h").alias("backward"), r6(temporal.diff("value", ["s"], "h")).alias("step"))


@query(f"WITH {READ}, l AS (SELECT sensor, ts FROM readings WHERE event_id % 2 = 0), r AS (SELECT sensor, ts, max(b) AS b FROM readings WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT l.sensor, l.ts, r.b FROM l ASOF LEFT JOIN r ON l.sensor = r.sensor AND l.ts >= r.ts")
def asof_nearest(spark, sf):
    r = d.readings(spark, sf)
    right = r.where("event_id % 2 = 1").groupBy("sensor", "ts").agg(F.max("b").alias("b"))
    return temporal.asof_nearest(r.where("event_id % 2 = 0").select("sensor", "ts"), right, ["sensor"], "b").select("sensor", "ts", "b")


# Blocks and entropies


@query(
    f"WITH {READ}, i AS (SELECT site, b, row_number() OVER (PARTITION BY site ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY site) AS n FROM readings), k AS (SELECT *, greatest(n // 24, 1) AS k FROM i), "
    f"c AS (SELECT *, n // k AS small, n % k AS extra FROM k) SELECT site, CASE WHEN i < extra * (small + 1) THEN i // (small + 1) ELSE extra + (i - extra * (small + 1)) // small END AS block, {R('avg(b)')} AS b FROM c GROUP BY 1, 2"
)
def block_means(spark, sf):
    r = d.readings(spark, sf).withColumn("o", F.struct("ts", "event_id"))
    return blocks.block_means(r, "b", "o", 24, ["site"]).withColumn("b", r6(F.col("b")))


@query(f"WITH {READ}, e AS (SELECT site, floor(min(b) + 0.1) AS lo, greatest(ceil(max(b) + 0.1), floor(min(b) + 0.1) + 2) AS hi FROM readings WHERE b IS NOT NULL GROUP BY 1), c AS (SELECT site, CASE WHEN b = hi THEN hi - 1 ELSE floor(b) END AS bin, count(*) AS n FROM readings JOIN e USING (site) WHERE b BETWEEN lo AND hi GROUP BY 1, 2) SELECT site, {R('-sum(n / t * ln(n / t))')} AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY site) AS t FROM c) GROUP BY 1")
def entropy(spark, sf):
    return blocks.shannon_entropy(d.readings(spark, sf), "b", ["site"]).withColumn("entropy", r6(F.col("entropy")))


@query(
    f"WITH {READ}, p AS (SELECT b AS x FROM readings WHERE event_id % 2 = 0 AND b IS NOT NULL), q AS (SELECT b AS x FROM readings WHERE event_id % 2 = 1 AND b IS NOT NULL), e AS (SELECT floor(min(x) + 0.1) AS lo, greatest(ceil(max(x) + 0.1), floor(min(x) + 0.1) + 2) AS hi FROM q), "
    f"a AS (SELECT CASE WHEN x = hi THEN hi - 1 ELSE floor(x) END AS bin, count(*) AS n FROM p, e WHERE x BETWEEN lo AND hi GROUP BY 1), z AS (SELECT CASE WHEN x = hi THEN hi - 1 ELSE floor(x) END AS bin, count(*) AS n FROM q, e WHERE x BETWEEN lo AND hi GROUP BY 1) "
    f"SELECT {R('sum(p * ln(p / (coalesce(r, 0) + 1e-13)))')} AS relative_entropy FROM (SELECT a.n / (SELECT sum(n) FROM a) AS p, z.n / (SELECT sum(n) FROM z) AS r FROM a LEFT JOIN z USING (bin))"
)
def relative_entropy(spark, sf):
    r = d.readings(spark, sf)
    return blocks.relative_entropy(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), "b").select(r6(F.col("relative_entropy")).alias("relative_entropy"))


# Earlier forms

SHARE = "CASE WHEN a + b = 0 THEN (CASE WHEN a <> b THEN 'infinity'::DOUBLE END) ELSE abs(a - b) / ((a + b) * 0.5) END"
LEGACY = f"legacy AS (SELECT *, CASE WHEN {SHARE} > 0.2 THEN 2 WHEN a IS NULL OR b IS NULL THEN 1 ELSE 0 END AS flag FROM readings)"


@query(f"WITH {READ}, {LEGACY}, c AS (SELECT hour(ts)::INTEGER AS hour, flag, count(*) AS n FROM legacy GROUP BY 1, 2) SELECT hour, flag, n, {R('n / (SELECT sum(n) FROM c)')} AS share FROM c")
def uptime_report(spark, sf):
    return legacy.uptime_report(legacy.flag_sensor(d.readings(spark, sf))).withColumn("share", r6(F.col("share")))


@query(f"WITH {READ}, {LEGACY} SELECT sensor, date_trunc('hour', ts) AS ts, {R('avg(round_even((a + b) / 2 * 100, 0) / 100)')} AS pm, {R('avg(rh)')} AS rh FROM legacy WHERE flag = 0 GROUP BY 1, 2")
def clean_sensor(spark, sf):
    return legacy.clean_sensor(d.readings(spark, sf)).select("sensor", "ts", r6(F.col("pm")).alias("pm"), r6(F.col("rh")).alias("rh"))


@query(f"WITH {READ}, f AS (SELECT date_trunc('hour', ts) AS ts, avg(b) AS conc, avg(CASE WHEN b > 3 AND b < 1000 THEN 2.0 WHEN event_id % 9 <> 0 THEN 1.0 ELSE 0.0 END) AS flag FROM readings GROUP BY 1) SELECT ts, {R('conc')} AS conc, {R('CASE WHEN conc IS NULL THEN 3.0 ELSE flag END')} AS flag FROM f")
def legacy_monitor(spark, sf):
    r = d.readings(spark, sf).select("ts", F.col("b").alias("conc"), (F.col("event_id") % 9).alias("Status"))
    return legacy.qa_bam(r).select("ts", r6(F.col("conc")).alias("conc"), r6(F.col("flag")).alias("flag"))


# Streams


@query(f"WITH {READ}, {FLAGGED}, good AS (SELECT *, date_trunc('hour', ts) AS hour FROM flagged WHERE a_flag = 0 AND b_flag = 0) SELECT site, hour AS ts, {R('avg((a + b) / 2)')} AS pm, count(*) AS n FROM good WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM good) - INTERVAL 2 HOUR GROUP BY 1, 2")
def streaming_hourly_means(spark, sf):
    """Readings as a stream, in one run over what is there; hours that the watermark has closed are appended."""
    schema = d.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    at = shared_path(spark, "stream")
    hourly.to_parquet(hourly.hourly_means(d.as_readings(stream)), f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.schema("site string, ts timestamp_ntz, pm double, rh double, n long").parquet(f"{at}/out").select("site", "ts", r6(F.col("pm")).alias("pm"), "n")


# Graph and gap filling

PAIRS = "pairs AS (SELECT x.s AS src, y.s AS dst, sqrt(pow(x.latitude - y.latitude, 2) + pow(x.longitude - y.longitude, 2)) AS distance FROM settlements x, settlements y WHERE x.s <> y.s), near AS (SELECT src, dst, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM pairs) WHERE r <= 3)"
EDGE = "edges AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, 1 / distance AS w FROM near UNION ALL SELECT dst, src, 1 / distance FROM near) GROUP BY 1, 2)"
PATTERN = "clock AS (SELECT s, h % 24 AS hod, avg(value) AS m FROM field WHERE value IS NOT NULL GROUP BY 1, 2), totals AS (SELECT s, sum(m) / 24 AS mean FROM clock GROUP BY 1), patterns AS (SELECT g.s, g.hod, CASE WHEN mean > 0 THEN coalesce(m, 0) / mean ELSE 1.0 END AS pattern FROM (SELECT s, hod FROM (SELECT DISTINCT s FROM field), (SELECT unnest(range(0, 24)) AS hod)) g LEFT JOIN clock USING (s, hod) LEFT JOIN totals ON totals.s = g.s)"


def _edges(spark):
    return car.inverse_distance_adjacency(spatial.knn(d.settlements(spark), "s"))


@query(f"WITH {d.SETTLEMENTS}, {PAIRS}, {EDGE} SELECT src, dst, {R('w')} AS w FROM edges")
def knn_graph(spark, sf):
    return _edges(spark).withColumn("w", r6(F.col("w")))


@query(f"WITH {d.FIELD}, {PATTERN} SELECT s, hod, {R('pattern')} AS pattern FROM patterns")
def diurnal_pattern(spark, sf):
    return car.diurnal_patterns(d.field(spark, sf)).withColumn("pattern", r6(F.col("pattern")))


@query(f"WITH {d.FIELD}, {d.MONTHLY}, {PATTERN} SELECT s, h, {R('level * pattern')} AS filled FROM field JOIN monthly USING (s, month) JOIN patterns USING (s) WHERE hod = h % 24")
def satellite_anchored_fill(spark, sf):
    f = d.field(spark, sf)
    return car.anchored_fill(f, d.monthly(spark, sf), car.diurnal_patterns(f)).select("s", "h", r6(F.col("filled")).alias("filled"))


@query(f"WITH {d.FIELD}, {d.MONTHLY}, {d.SETTLEMENTS}, {PAIRS}, {EDGE}, seen AS (SELECT s AS dst, h, value AS v FROM field WHERE value IS NOT NULL), nb AS (SELECT src AS s, h, sum(w * v) / sum(w) AS nb FROM edges JOIN seen USING (dst) WHERE w > 0.01 GROUP BY 1, 2), hm AS (SELECT h, avg(v) AS hm FROM seen GROUP BY 1) SELECT f.s, f.h, {R('coalesce(value, nb, hm, level, 50)')} AS mu FROM field f LEFT JOIN nb ON nb.s = f.s AND nb.h = f.h LEFT JOIN hm ON hm.h = f.h LEFT JOIN monthly m ON m.s = f.s AND m.month = f.month")
def sensor_informed_prior(spark, sf):
    return car.sensor_informed_prior(d.field(spark, sf), _edges(spark), d.monthly(spark, sf)).select("s", "h", r6(F.col("mu")).alias("mu"))


@query(f"WITH {d.FIELD}, {d.MONTHLY}, {PATTERN}, p AS (SELECT s, h, level * pattern AS theta, value FROM field JOIN monthly USING (s, month) JOIN patterns USING (s) WHERE hod = h % 24), e AS (SELECT s, count(*) AS n, median(theta - value) AS m FROM p WHERE value IS NOT NULL GROUP BY 1) SELECT s, h, {R('CASE WHEN n > 10 THEN theta - m ELSE theta END')} AS theta FROM p LEFT JOIN e USING (s)")
def bias_correct_median(spark, sf):
    f = d.field(spark, sf)
    p = car.anchored_fill(f, d.monthly(spark, sf), car.diurnal_patterns(f)).select("s", "h", F.col("filled").alias("theta"))
    return car.bias_corrected(p, f).select("s", "h", r6(F.col("theta")).alias("theta"))


@query(f"WITH {READ} SELECT event_id, {R('((1 + rh / 10) * b - 0.5 * a) / (1 + rh / 10 - 0.5)')} AS loo FROM readings WHERE 1 + rh / 10 - 0.5 > 1e-10")
def loo_formula(spark, sf):
    cells = d.readings(spark, sf).select("event_id", F.col("b").alias("theta"), (1 + F.col("rh") / 10).alias("q"), F.lit(0.5).alias("tau"), F.col("a").alias("y"))
    return car.loo_predictions(cells).select("event_id", r6(F.col("loo")).alias("loo"))


@query(
    f"WITH {d.FIELD}, {d.SETTLEMENTS}, {PAIRS}, {EDGE}, x AS (SELECT s, h, coalesce(value, 0) AS x FROM field), t AS (SELECT s, h, x, 0.1 * (coalesce(x - lag(x, 1) OVER w, 0) + coalesce(x - lead(x, 1) OVER w, 0)) + 0.01 * (coalesce(x - lag(x, 24) OVER w, 0) + coalesce(x - lead(x, 24) OVER w, 0)) AS t FROM x WINDOW w AS (PARTITION BY s ORDER BY h)), "
    f"p AS (SELECT src AS s, h, sum(w * x) AS p FROM edges JOIN x ON x.s = dst GROUP BY 1, 2), g AS (SELECT src AS s, sum(w) AS g FROM edges GROUP BY 1) SELECT s, h, {R('t + 2.0 * (coalesce(g, 0) * x - coalesce(p, 0))')} AS y FROM t LEFT JOIN p USING (s, h) LEFT JOIN g USING (s)"
)
def precision_product(spark, sf):
    f = d.field(spark, sf).withColumn("x", F.coalesce("value", F.lit(0.0)))
    return car.prior_product(f, _edges(spark), car.Config()).select("s", "h", r6(F.col("y")).alias("y"))


@query()
def car_map(spark, sf):
    return car.fill_gaps(d.field(spark, sf), _edges(spark), d.monthly(spark, sf)).select("s", "h", F.round("theta", 3).alias("theta"))


# Decompositions


@query(f"WITH {d.MATRIX}, e AS (SELECT station AS mode, sum(value * value) AS energy FROM matrix GROUP BY 1), s AS (SELECT *, energy / sum(energy) OVER () AS share FROM e) SELECT mode, {R('energy')} AS energy, {R('share')} AS share, {R('sum(share) OVER (ORDER BY energy DESC, mode ROWS UNBOUNDED PRECEDING)')} AS cumulative FROM s")
def pod_energy(spark, sf):
    out = pod.mode_energy(d.matrix(spark, sf).withColumnRenamed("station", "mode"))
    return out.select("mode", *[r6(F.col(c)).alias(c) for c in ("energy", "share", "cumulative")])


@query(f"WITH {d.MATRIX}, m AS (SELECT station, avg(value) AS m FROM matrix GROUP BY 1) SELECT t, k AS mode, {R('sum((value - m) * cos(station * (k + 1) / 10.0))')} AS value FROM matrix JOIN m USING (station), (SELECT unnest(range(0, 3)) AS k) GROUP BY 1, 2")
def mode_projection(spark, sf):
    x = d.matrix(spark, sf)
    modes = spark.range(64).select(F.col("id").cast("int").alias("station"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("mode"), F.cos(F.col("id") * (k + 1) / 10.0).alias("value")) for k in range(3)])).alias("x")).select("station", "x.*")
    mean = x.groupBy("station").agg(F.avg("value").alias("value"))
    return pod.project(x, modes, mean).withColumn("value", r6(F.col("value")))


@query()
def spatial_pod(spark, sf):
    return pod.spatial_pod(d.matrix(spark, sf), "t", "station")["energy"].select("mode", r6(F.col("share")).alias("share"), r6(F.col("cumulative")).alias("cumulative"))


def _network(spark, sf):
    f = d.field(spark, sf)
    return f.select(F.lit("all").alias("network"), F.col("h").cast("double").alias("t"), F.col("s").cast("string").alias("station"), "value")


@query()
def gappy_pod(spark, sf):
    out = pod.GappyPOD().fit_frame(_network(spark, sf))["reconstruction"]
    return out.select("t", "station", F.round("value", 4).alias("value"), "is_original")


@query()
def memd_energies(spark, sf):
    imfs = memd.decompose(_network(spark, sf))
    return memd.imf_energies(imfs).select("imf", F.round("energy", 3).alias("energy"), F.round("percent", 3).alias("percent"))


@query()
def imf_pod_modes(spark, sf):
    imfs = _network(spark, sf).withColumn("imf", F.lit(0))
    return pod.imf_pods(imfs).where("kind = 'explained'").select("imf", "mode", F.round("value", 4).alias("value"))


@query()
def sensor_ranking(spark, sf):
    fit = pod.GappyPOD().fit_frame(_network(spark, sf))
    return pod.rank_sensors(fit["spatial"], fit["energy"]).select("rank", "station", F.round("importance", 4).alias("importance"))


@query()
def gpr_temporal(spark, sf):
    """Each settlement's series as a mode of its own."""
    c = d.field(spark, sf).select(F.lit(0).alias("imf"), F.col("s").alias("mode"), F.col("h").alias("t"), "value")
    return gpr.temporal(c, c.select("t")).select("mode", "t", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query(
    f"WITH {d.STATIONS}, p AS (SELECT station AS k, longitude AS x, latitude AS y, (station % 17)::DOUBLE AS v FROM stations), q AS (SELECT b.x - a.x AS dx, b.y - a.y AS dy, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS dist, pow(a.v - b.v, 2) / 2 AS g FROM p a JOIN p b ON a.k < b.k), "
    f"e AS (SELECT *, degrees(atan2(dy, dx)) - 180 * floor(degrees(atan2(dy, dx)) / 180) AS angle FROM q WHERE dist > 0 AND dist <= 2), "
    f"w AS (SELECT *, 'omni' AS direction FROM e UNION ALL SELECT e.*, n FROM e, (VALUES ('az0', 0), ('az45', 45), ('az90', 90), ('az135', 135)) v(n, a) WHERE least(abs(angle - a), 180 - abs(angle - a)) <= 22.5) "
    f"SELECT direction, CAST(least(floor(dist / 0.2), 9) AS INTEGER) AS lag, {R('avg(dist)')} AS distance, {R('avg(g)')} AS gamma, count(*) AS n FROM w GROUP BY 1, 2"
)
def variogram(spark, sf):
    s = d.stations(spark, sf).withColumn("value", (F.col("station") % 17).cast("double"))
    return gpr.variogram(s, longest=2.0).select("direction", "lag", r6(F.col("distance")).alias("distance"), r6(F.col("gamma")).alias("gamma"), "n")


@query(f"SELECT t, station, {R('sum(mean)')} AS value, {R('sqrt(sum(std * std))')} AS std FROM (SELECT event_id % 50 AS t, user_id % 10 AS station, value AS mean, (event_id % 5) / 10.0 AS std FROM events) GROUP BY 1, 2")
def reconstruct_space_time(spark, sf):
    e = d.table(spark, sf, "events").select((F.col("event_id") % 50).alias("t"), (F.col("user_id") % 10).alias("station"), F.col("value").alias("mean"), ((F.col("event_id") % 5) / 10.0).alias("std"))
    return gpr.reconstruct_space_time(e).select("t", "station", r6(F.col("value")).alias("value"), r6(F.col("std")).alias("std"))


# Baselines and samplers


@query()
def daily_baseline(spark, sf):
    out = baseline.daily_baseline(d.readings(spark, sf, True), "b")
    return out.select("sensor", "ts", *[F.round(c, 4).alias(c) for c in ("b", "baseline", "peak")])


@query()
def baseline_sensitivity(spark, sf):
    out = baseline.sensitivity(d.readings(spark, sf, True), "b")
    return out.select("sensor", "quantile", "dof", F.round("baseline", 4).alias("baseline"), F.round("peak", 4).alias("peak"), "n")


def _vector(spark, sf):
    hourly = d.table(spark, sf, "events").groupBy(temporal.hour_of("ts").alias("ts")).agg(F.avg("value").alias("mu"))
    return bootstrap.vector(hourly, "mu", "ts")


@query()
def bootstrap_bounds(spark, sf):
    obs = _vector(spark, sf)
    return bootstrap.noise_bounds(spark, obs, n=len(obs) // 2)


@query()
def bootstrap_aggregation(spark, sf):
    return bootstrap.bounds(bootstrap.run(spark, _vector(spark, sf), bootstrap.aggregate, bootstrap.aggregation_grid()))


@query()
def bootstrap_tradeoff(spark, sf):
    return bootstrap.bounds(bootstrap.run(spark, _vector(spark, sf), bootstrap.tradeoff, bootstrap.tradeoff_grid()))
