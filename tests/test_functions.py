import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from airweave.functions import nulls, scalars, splines
from airweave.operators import qa, temporal


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(expr.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("value,code", [(None, 1), (2.99, 2), (3.0, 0), (1000.0, 0), (1000.01, 2)])
def test_monitor_range(spark, value, code):
    df = spark.createDataFrame([(value, 0)], "pm25_bam double, status long")
    assert qa.qa_bam(df).collect()[0]["pm25_bam_flag"] == code


def test_monitor_status_and_order(spark):
    df = spark.createDataFrame([(5.0, 4), (1.0, 4), (None, 4)], "pm25_bam double, status long")
    assert [r["pm25_bam_flag"] for r in qa.qa_bam(df).collect()] == [3, 2, 1]


def test_pollutant_flags(spark):
    df = spark.createDataFrame([(50.0, 40.0, 3.0), (None, 10.0, 200.0), (5.0, 9.0, 100.5)], "pm25 double, pm10 double, no2 double")
    rows = qa.qa_reg(df).collect()
    assert [(r["pm25_flag"], r["pm10_flag"], r["no2_flag"]) for r in rows] == [(3, 3, 0), (1, 0, 2), (0, 0, 2)]


def test_channel_flags(spark):
    df = spark.createDataFrame([(10.0, 10.0, 50.0, 40.0), (10.0, 4.0, 101.0, 41.0), (None, 600.0, None, None)], "a double, b double, rh double, disagreement double")
    rows = qa.qa_pa(df).collect()
    assert [(r["a_flag"], r["b_flag"], r["rh_flag"]) for r in rows] == [(0, 0, 0), (3, 2, 2), (1, 2, 1)]


@pytest.mark.parametrize("pm,code", [(None, 0), (30.0, 0), (30.01, 1), (60.0, 1), (90.0, 2), (120.0, 3), (250.0, 4), (250.1, 5)])
def test_aqi(spark, pm, code):
    assert one(spark, scalars.aqi_code(F.lit(pm).cast("double"))) == code


def test_seasons(spark):
    df = spark.createDataFrame([(datetime(2024, m, 1),) for m in range(1, 13)], "ts timestamp_ntz")
    got = [r[0] for r in df.select(scalars.season(F.col("ts"), False)).collect()]
    assert got == [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3]


@pytest.mark.parametrize("direction,sector", [(90.0, None), (101.25, 15), (101.26, 0), (90 + 11.26, 0), (90.0 + 360, None), (89.0, 15), (0.0, 11)])
def test_wind_sectors(spark, direction, sector):
    assert one(spark, scalars.wind_sector(F.lit(direction))) == sector


def test_wind(spark):
    assert one(spark, scalars.wind_direction(F.lit(0.0), F.lit(-1.0))) == 0
    assert one(spark, scalars.wind_direction(F.lit(-1.0), F.lit(0.0))) == 90
    assert one(spark, scalars.wind_direction(F.lit(0.0), F.lit(0.0))) == 180
    assert [one(spark, scalars.wind_speed_class(F.lit(v))) for v in (0.0, 0.5, 1.0, 1.01, 5.0, 5.1)] == [None, 0, 0, 1, 4, None]


def test_disagreement(spark):
    assert one(spark, scalars.disagreement(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, scalars.disagreement(F.lit(1.0), F.lit(-1.0))) == math.inf
    assert one(spark, scalars.disagreement(F.lit(3.0), F.lit(1.0))) == 100


def test_nan_and_sums(spark):
    df = nulls.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 1)], "x double, k int"))
    assert df.agg(F.avg("x")).collect()[0][0] == 2.0
    assert df.where("x IS NULL").agg(nulls.sum0(F.col("x"))).collect()[0][0] == 0
    assert [one(spark, nulls.half_even(F.lit(v), 1)) for v in (0.25, 0.35, -0.25)] == [0.2, 0.4, -0.2]


def test_densify(spark):
    df = spark.createDataFrame([("s", datetime(2024, 1, 1, 0), 1.0), ("s", datetime(2024, 1, 1, 3), 2.0)], "s string, ts timestamp_ntz, v double")
    assert [r["v"] for r in nulls.densify(df, ["s"], "ts").orderBy("ts").collect()] == [1.0, None, None, 2.0]


def test_spline_reproduces_cubic():
    x = np.linspace(0, 10, 60)
    y = 1 + x - 0.3 * x**2 + 0.02 * x**3
    t, c = splines.lsq(x, y, np.array([3.0, 6.0]))
    assert np.allclose(splines.basis(x, t) @ c, y, atol=1e-8)
    assert np.allclose(splines.basis(x, t).sum(1), 1)
    with pytest.raises(ValueError):
        splines.lsq(x[:4], y[:4], np.array([1.0, 2.0, 3.0]))


def test_cf1(spark):
    t, c = splines.lsq(np.linspace(20, 80, 30), np.linspace(20, 120, 30), np.array([50.0]))
    df = spark.createDataFrame([(19.9,), (80.0,), (50.0,), (None,)], "x double")
    got = [r[0] for r in df.select(scalars.atm_to_cf1(F.col("x"), splines.spline(t, c))).collect()]
    assert got[0] == 19.9 and got[1] == 120 and abs(got[2] - 70) < 1e-6 and got[3] is None
    with pytest.raises(ValueError):
        scalars.atm_to_cf1(F.col("x"))


def test_names(spark):
    row = spark.createDataFrame([("s3://b/gee_aod/aod_2023-05-06.tif", "x/03May2021_14.tif")], "a string, b string")
    r = row.select(scalars.tile_date(F.col("a")).alias("d"), scalars.tile_hour(F.col("b")).alias("h"), scalars.file_stem(F.col("a")).alias("s"), scalars.tile_date(F.col("b")).alias("n")).collect()[0]
    assert str(r["d"]) == "2023-05-06" and r["h"] == datetime(2021, 5, 3, 14) and r["s"] == "aod_2023-05-06" and r["n"] is None


def test_time_zone(spark):
    assert one(spark, scalars.from_epoch(F.lit(0))) == datetime(1970, 1, 1, 5, 30)
    assert one(spark, scalars.julian_date(F.lit(datetime(2000, 1, 1, 12)).cast("timestamp_ntz"))) == 2451545.0


def test_islands_and_gaps(spark):
    v = [1.0, None, 2.0, 3.0, None, None, 4.0]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "s string, h long, value double")
    sizes = sorted(r["n"] for r in temporal.island_sizes(temporal.islands(df, ["value"], ["s"], "h"), ["s"]).collect())
    assert sizes == [1, 1, 2]
    bridged = temporal.island_sizes(temporal.islands(df, ["value"], ["s"], "h", gap_length=1), ["s"]).collect()
    assert sorted(r["n"] for r in bridged) == [1, 4]
    assert sorted((r["start"], r["end"], r["length"]) for r in temporal.gaps(df, "value", ["s"], "h").collect()) == [(1, 1, 1), (4, 5, 2)]
    filled = [r["value"] for r in temporal.interpolate_short(df, "value", ["s"], "h", 1).orderBy("h").collect()]
    assert filled == [1.0, 1.5, 2.0, 3.0, None, None, 4.0]


def test_resample_and_diel(spark):
    rows = [("s", datetime(2024, 1, 1, h, m), float(h)) for h in range(24) for m in (0, 1, 30)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double")
    assert temporal.resample(df, ["s"], {"v": "count"}, 2).count() == 48
    d = {r["hour"]: r["v"] for r in temporal.diel(df, "v", ["s"]).collect()}
    assert d[24] == d[0] == 0 and d[23] == 23 and len(d) == 25


def test_asof(spark):
    left = spark.createDataFrame([("s", datetime(2024, 1, 1, h)) for h in (0, 2, 5)], "s string, ts timestamp_ntz")
    right = spark.createDataFrame([("s", datetime(2024, 1, 1, 1), 1.0), ("s", datetime(2024, 1, 1, 2), 2.0)], "s string, ts timestamp_ntz, v double")
    got = [r["v"] for r in temporal.asof_nearest(left, right, ["s"], "v").orderBy("ts").collect()]
    assert got == [None, 2.0, 2.0]
    got = [r["v"] for r in temporal.asof_nearest(left, right, ["s"], "v", within="1 hour").orderBy("ts").collect()]
    assert got == [None, 2.0, None]
