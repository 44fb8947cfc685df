import io
import json
import struct
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow.feather
from pyspark.sql import functions as F

from airweave.operators.filters import trim_clip
from airweave.sources import arrow_files, points, rasters
from airweave.streaming import hourly


def test_bam(spark, tmp_path):
    d = tmp_path / "st1"
    d.mkdir()
    head = "x\nData Report\ny\nz\nTime,ConcHR(ug/m3),Status\n"
    (d / "a.csv").write_text(head + "2024-01-01 01:00,10,0\n2024-01-01 01:30,20,4\n2024-01-01 02:00,,1\n")
    (d / "b.csv").write_text("no report\n1,2\n")
    meta = tmp_path / "bam_meta.csv"
    meta.write_text("sensor,site,latitude,longitude\nst1,S,20.5,75.5\n")
    rows = points.read_bam(spark, str(d)).orderBy("ts").collect()
    assert [(r["ts"], r["pm25"], r["status"]) for r in rows] == [(datetime(2024, 1, 1, 0), 15.0, 4), (datetime(2024, 1, 1, 1), None, 1)]
    out = points.format_bam(points.read_bam(spark, str(d)), points.read_bam_meta(spark, str(meta))).collect()
    assert {r["site"] for r in out} == {"S"} and out[0]["latitude"] == 20.5


def _feather(path, **cols):
    pyarrow.feather.write_feather(pd.DataFrame(cols), str(path))


def test_hourly_feed(spark, tmp_path):
    t = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:30", "2024-01-01 01:00"])
    _feather(tmp_path / "x_feed.feather", observation_hour_start=t, unit_identifier=["i"] * 3, site_id=["s"] * 3, pm25_atm_ch_a_average=[1.0, 3.0, np.nan], pm25_atm_ch_b_average=[1.0, 5.0, 2.0], humidity_average=[50.0] * 3)
    history = spark.createDataFrame([("s", "i", datetime(2023, 1, 1), None, "Delhi", "Large City", 20.0, 75.0, "d", "st", "u", "c")], "site_id string, unit_identifier string, effective_date timestamp_ntz, discontinue_date timestamp_ntz, settlement_name string, settlement_type string, site_latitude double, site_longitude double, site_district_name string, site_state_name string, all_land_uses string, cluster_name string")
    meta = points.deployment_meta(history)
    rows = points.format_pa(points.read_pa(spark, str(tmp_path)), meta).orderBy("ts").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(2.0, 3.0), (None, 2.0)] and rows[0]["settlement_code"] == 2
    assert abs(rows[0]["disagreement"] - 40) < 1e-9


def test_platform_feed(spark, tmp_path):
    _feather(tmp_path / "sensor_x_7.feather", c0=[0.0, 60.0, 180.0], c1=[50.0] * 3, c2=[20.0] * 3, c3=[0.0] * 3, c4=[0.0] * 3, c5=[1.0, 2.0, 5.0], c6=[1.0, 2.0, 5.0])
    r = points.read_pr(spark, str(tmp_path)).orderBy("ts")
    assert [(x["sensor_index"], x["ts"], x["a"]) for x in r.collect()] == [(7, datetime(1970, 1, 1, 5, 30), 1.5), (7, datetime(1970, 1, 1, 5, 32), 5.0)]
    h = spark.createDataFrame([(7, 0, "s", datetime(1960, 1, 1), datetime(1965, 1, 1)), (7, 1, "t", datetime(1965, 1, 1), datetime(2000, 1, 1))], "sensor_index long, position int, site string, effective_date timestamp_ntz, discontinue_date timestamp_ntz")
    assert points.format_pr(r, h).count() == 4 and points.format_pr(r, h, respect_periods=True).count() == 2


def test_regulatory(spark, tmp_path):
    t = pd.to_datetime(["2024-01-01 01:00", "2024-01-01 01:15"])
    for p, v in (("PM25", [10.0, 20.0]), ("NO2", [5.0, np.nan])):
        _feather(tmp_path / f"x_{p}_reg.feather", observation_hour_start=t, location_name=["L", "L"], average_value_in_hour=v)
    f = {"features": [{"properties": {"location_name": "L", "state_name": "S", "district_name": "D", "city_name": "C"}, "geometry": {"type": "Point", "coordinates": [75.0, 20.0]}}]}
    (tmp_path / "meta_reg.geojson").write_text(json.dumps(f))
    out = points.format_reg(points.read_reg(spark, str(tmp_path)), points.read_reg_meta(spark, str(tmp_path / "meta_reg.geojson"))).collect()
    assert len(out) == 1 and (out[0]["pm25"], out[0]["no2"], out[0]["o3"], out[0]["longitude"], out[0]["ts"]) == (15.0, 5.0, None, 75.0, datetime(2024, 1, 1, 0))


def test_counters(spark, tmp_path):
    t = pd.to_datetime(["2024-01-01 01:00", "2024-01-01 01:15"])
    _feather(tmp_path / "m_processed.feather", **{"time": t, "pm1": [1.0, 2.0], "pm25": [2.0, 4.0], "pm10": [3.0, 5.0], "met.rh": [50.0, 50.0], "met.temp": [20.0, 20.0], "sn": ["q", "q"]})
    _feather(tmp_path / "m.feather", timestamp_local=t, flag=[1, 2], sn=["q", "q"])
    _feather(tmp_path / "meta.feather", sensor=["q"], site=["S"], latitude=[20.0], longitude=[75.0])
    r = points.format_quantaq(points.read_quantaq(spark, str(tmp_path)), points.read_quantaq_meta(spark, str(tmp_path))).collect()
    assert r[0]["site"] == "S" and "sensor" not in r[0]
    assert [(x["pm25_qaq"], x["flag_qaq"]) for x in r] == [(3.0, 3)]


def test_rwi_and_existence(spark, tmp_path):
    (tmp_path / "rwi.csv").write_text("latitude,longitude,rwi\n20.0,75.0,1\n20.05,75.05,2\n20.3,75.0,3\n")
    got = {(r["iy"], r["ix"]): r["rwi"] for r in points.read_rwi(spark, str(tmp_path / "rwi.csv")).collect()}
    assert got[0, 0] == 2.0 and len(got) == 2
    assert arrow_files.exists(spark, str(tmp_path / "rwi.csv")) and not arrow_files.exists(spark, str(tmp_path / "no.csv")) and not arrow_files.exists(spark, "no_such_table")


def tiff(a: np.ndarray, x0: float, y0: float, step: float, deflate: bool) -> bytes:
    raw = a.astype("<f4").tobytes()
    raw = zlib.compress(raw) if deflate else raw
    extra = struct.pack("<3d", step, step, 0) + struct.pack("<6d", 0, 0, 0, x0, y0, 0) + b"-9\0"
    tags = [(256, 4, 1, a.shape[1]), (257, 4, 1, a.shape[0]), (258, 3, 1, 32), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, 8 + len(extra)), (277, 3, 1, 1), (278, 4, 1, a.shape[0]), (279, 4, 1, len(raw)), (339, 3, 1, 3), (33550, 12, 3, 8), (33922, 12, 6, 32), (42113, 2, 3, None)]
    out = io.BytesIO()
    out.write(b"II*\0" + struct.pack("<I", 8 + len(extra) + len(raw)) + extra + raw + struct.pack("<H", len(tags)))
    for tag, kind, n, v in tags:
        out.write(struct.pack("<HHI", tag, kind, n) + (b"-9\0\0" if v is None else struct.pack("<I", v)))
    return out.getvalue() + struct.pack("<I", 0)


def test_tiles(spark, tmp_path):
    d = tmp_path / "gee_aod"
    d.mkdir()
    a = np.add.outer(np.arange(6) * -0.1, np.arange(6) * 0.1)
    a[0, 0] = -9
    for name, deflate in (("t_2024-01-02.tif", True), ("t_2024-01-03.tif", False)):
        (d / name).write_bytes(tiff(a, 75.0, 21.0, 0.1, deflate))
    cells = arrow_files.geotiff(arrow_files.files(spark, str(d), "*.tif"))
    assert cells.count() == 72 and cells.where("value IS NULL OR isnan(value)").count() == 2
    out = rasters.read_gee(spark, str(tmp_path), box=(75.2, 20.6, 75.3, 20.7)).orderBy("ts", "latitude", "longitude").collect()
    assert len(out) == 2 * 11 * 11 and out[0]["ts"] == datetime(2024, 1, 2)
    r = out[0]
    assert abs(r["aod"] - ((r["longitude"] - 75.05) - (20.95 - r["latitude"]))) < 0.011


def test_reanalysis_versions(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, 20.0, 75.0, 1, 300.0, 290.0, 1.0, 0.0), (t, 20.0, 75.0, 5, 250.0, 240.0, 0.0, 0.0), (t, 21.0, 75.0, 5, 280.0, 270.0, 0.0, -1.0)], "valid_time timestamp_ntz, latitude double, longitude double, expver int, t2m double, d2m double, u10 double, v10 double")
    out = {r["latitude"]: r for r in rasters.format_era(df).collect()}
    assert abs(out[20.0]["t2m"] - 26.85) < 1e-9 and out[20.0]["wd10"] == 270 and out[21.0]["spd10"] == 1.0 and out[20.0]["ts"] == datetime(2024, 1, 1, 5)


def test_cells_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, m, 1), 20.0 + m, 75.0, float(m)) for m in (1, 2, 3)], "ts timestamp_ntz, latitude double, longitude double, v double")
    rasters.write_cells(df, str(tmp_path / "c"))
    assert rasters.read_cells(spark, str(tmp_path / "c"), (74, 21.5, 76, 30)).count() == 2
    assert trim_clip(df, "2024-01-15", None, [[(70.0, 20.0), (80.0, 20.0), (80.0, 22.5), (70.0, 22.5)]]).count() == 1


def test_streaming(spark, tmp_path):
    rows = [("s", "x", datetime(2024, 1, 1, h, m), 10.0, 11.0, 50.0) for h in range(6) for m in (0, 30)]
    df = spark.createDataFrame(rows, "site string, sensor string, ts timestamp_ntz, a double, b double, rh double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = hourly.to_parquet(hourly.hourly_means(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r["ts"].hour, r["pm"], r["n"]) for r in got][:3] == [(0, 10.5, 2), (1, 10.5, 2), (2, 10.5, 2)]
    batch = hourly.sessions(df, "1 hour").collect()
    assert len(batch) == 1 and batch[0]["n"] == 12
    assert hourly.flagged(df).where(F.col("a_flag") == 0).count() == 12
