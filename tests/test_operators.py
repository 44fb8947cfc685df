from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airweave.operators import baseline, blocks, bootstrap, calibration, car, filters, gpr, memd, merge, metrics, pod, spatial
from airweave.plans import pipelines


def points(spark, n=60, seed=0, name="k"):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 3, (n, 2)))], f"{name} long, latitude double, longitude double")


def test_nearest_axis_matches_brute_force(spark):
    p, axis = points(spark), np.array([0.1, 0.5, 0.9, 2.0, 2.9])
    a = spark.createDataFrame([(float(v),) for v in axis], "v double")
    for r in spatial.nearest_on_axis(p, a, "latitude", "near").collect():
        assert abs(r["near"] - r["latitude"]) == np.abs(axis - r["latitude"]).min()


def test_nearest_ties(spark):
    p = spark.createDataFrame([(1.5,), (-5.0,), (99.0,)], "y double")
    a = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    up = {r["y"]: r["n"] for r in spatial.nearest_on_axis(p, a, "y", "n").collect()}
    down = {r["y"]: r["n"] for r in spatial.nearest_on_axis(p, a, "y", "n", larger=False).collect()}
    assert up == {1.5: 2.0, -5.0: 1.0, 99.0: 2.0} and down[1.5] == 1.0


def test_nearest_axis_beyond_the_broadcast_bound(spark, monkeypatch):
    """The same as within it: points far off, ties, missing values, and ranks along the axis."""
    p = spark.createDataFrame([(55.0,), (-70.0,), (11.1,), (None,), (11.1,), (10.2,), (12.0,), (300.0,)], "y double")
    a = spark.createDataFrame([(10.2,), (12.0,), (100.0,), (500.0,)], "v double")
    both = []
    for most in (spatial.AXIS, 1):
        monkeypatch.setattr(spatial, "AXIS", most)
        both.append([sorted(((r["y"], r["n"]) for r in spatial.nearest_on_axis(p, a, "y", "n", larger).collect()), key=str) for larger in (True, False)])
    assert both[0] == both[1] and (55.0, 12.0) in both[0][0] and (None, None) in both[0][0] and (300.0, 500.0) in both[0][0] and (300.0, 100.0) in both[0][1]
    monkeypatch.setattr(spatial, "BUCKETS", 7)
    test_nearest_axis_matches_brute_force(spark)
    axis = spark.createDataFrame([(float(v) ** 3,) for v in range(40)], "v double")
    assert sorted(tuple(r) for r in spatial._ranked(axis, "x", "i").collect()) == [(float(v) ** 3, v, 40) for v in range(40)]


def test_sparse_process_is_close_to_the_exact_one(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.linspace(0, 10, 300)[:, None]
    y = np.sin(2 * x[:, 0]) + rng.normal(size=300) * 0.1
    exact = gpr.GP().fit(x, y)
    monkeypatch.setattr(gpr, "MOST", 100)
    monkeypatch.setattr(gpr, "INDUCING", 100)
    some = gpr.GP().fit(x, y)
    (m, s), (n, t) = exact.predict(x), some.predict(x)
    assert np.abs(m - n).max() < 0.1 and np.abs(s - t).max() < 0.1 and np.abs(n - np.sin(2 * x[:, 0])).mean() < 0.08


def test_projection_keeps_its_scale_where_stations_drop_out():
    d = memd.directions(4, 8)[0]
    x = np.tile(d, (3, 1))
    x[1, :2] = np.nan
    x[2] = np.nan
    got = memd.project(x, d)
    assert np.allclose(got[:2], [1.0, np.linalg.norm(d[2:])]) and np.isnan(got[2])


def test_tolerance_match_matches_brute_force(spark):
    a, b = points(spark, 80, 1, "l"), points(spark, 80, 2, "r")
    got = {r["l"]: r["r"] for r in spatial.tolerance_match(a, b, "l", "r", 0.3).collect()}
    x, y = a.toPandas(), b.toPandas()
    want = {}
    for i in x.itertuples():
        d = np.hypot(y.latitude - i.latitude, y.longitude - i.longitude)
        if d.min() < 0.3:
            want[i.l] = y.r[d.argmin()]
    assert got == want


def test_knn_matches_brute_force(spark):
    p = points(spark, 50, 3)
    got = {(r["src"], r["dst"]) for r in spatial.knn(p, "k", 4, cell=0.2).collect()}
    x = p.toPandas()
    xy = x[["latitude", "longitude"]].to_numpy()
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, j) for i in range(50) for j in np.argsort(d[i])[:4]}


def test_weights_sum_to_one(spark):
    w = spatial.weighted_sampling(points(spark, 10, 4, "station"), points(spark, 500, 5, "cell"), radius_km=40, sigma_km=20)
    assert all(abs(r["w"] - 1) < 1e-9 for r in w.groupBy("station").agg(F.sum("weight").alias("w")).collect())


def test_bilinear_reproduces_plane(spark):
    cells = spark.createDataFrame([(i * 0.5, j * 0.5, 3 * i * 0.5 - j * 0.5) for i in range(8) for j in range(8)], "latitude double, longitude double, v double")
    p = points(spark, 20, 6)
    for r in spatial.bilinear(cells, p, "v", 0.5).collect():
        assert abs(r["v"] - (3 * r["latitude"] - r["longitude"])) < 1e-9


def test_outer_merge(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, v double")
    assert {r["k"]: r["v"] for r in merge.outer_merge(a, b, ["k"]).collect()} == {1: 1.0, 2: 5.0, 3: 6.0}
    assert {r["k"]: r["v"] for r in merge.override_merge(a, b, ["k"]).collect()} == {1: 1.0, 2: None, 3: None}
    clash = spark.createDataFrame([(1, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="conflicting values"):
        merge.outer_merge(a, clash, ["k"]).collect()


def test_polygons(spark):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0)]]
    p = spark.createDataFrame([(1, 1.5, 1.5), (2, 0.7, 0.7), (3, 3.0, 1.0)], "sensor int, latitude double, longitude double")
    assert [r["sensor"] for r in filters.clip_points(p, square).collect()] == [1]
    rings = spark.createDataFrame([([[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]],)], "rings array<array<struct<x: double, y: double>>>")
    assert rings.select(F.size(filters.fill_holes(F.col("rings")))).collect()[0][0] == 2
    inside = rings.select(filters.in_polygon_column(F.lit(75.0), F.lit(75.0), F.col("rings")), filters.in_polygon_column(F.lit(25.0), F.lit(25.0), F.col("rings"))).collect()[0]
    assert tuple(inside) == (True, False)
    cells = spark.createDataFrame([(2.004, 1.0)], "latitude double, longitude double")
    assert filters.clip_raster(cells, square[:1]).count() == 0 and filters.clip_raster(cells, square[:1], all_touched=True).count() == 1


def test_site_filter_keeps_missing(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "site string")
    assert df.where(filters.not_equal("site", "A")).count() == 2


def test_metrics(spark):
    y, h = np.array([1.0, 2.0, 4.0, 7.0]), np.array([1.5, 1.5, 5.0, 6.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, h, strict=True)] + [(None, 1.0)], "y double, h double")
    r = metrics.evaluate(df, "y", "h").collect()[0]
    r2 = 1 - ((y - h) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert r["n"] == 4 and abs(r["r2"] - r2) < 1e-12 and abs(r["adj_r2"] - (1 - (1 - r2) * 3 / 2)) < 1e-12
    assert abs(r["mbe"] - (y - h).mean()) < 1e-12 and abs(r["nrmse"] - 100 * np.sqrt(((y - h) ** 2).mean()) / y.mean()) < 1e-9


def test_linear_and_nonlinear_fits(spark):
    rng = np.random.default_rng(0)
    raw, rh = rng.uniform(10, 200, 400), rng.uniform(20, 90, 400)
    lin = 0.5 * raw - 0.3 * rh + 20
    non = raw * 0.8 / (1 + 0.25 * (rh / 100) / (1 - rh / 100))
    df = spark.createDataFrame(pd.DataFrame({"site": "s", "pa_raw_x": raw, "rh": rh, "lin": lin, "non": non}))
    r = calibration.fit_linear(df, ["site"], "pa_raw_x", target="lin").collect()[0]
    assert np.allclose((r["b_pa"], r["b_rh"], r["b_int"]), (0.5, -0.3, 20), atol=1e-8)
    r = calibration.fit_nonlinear(df, ["site"], "pa_raw_x", target="non", bins=5000).collect()[0]
    assert np.allclose((r["alpha"], r["beta"]), (0.8, 0.25), atol=1e-3)
    with pytest.raises(ValueError, match="unknown model"):
        calibration.apply_historical(df, "nowhere")
    with pytest.raises(ValueError, match="pa_raw_"):
        calibration.apply_historical(df.drop("pa_raw_x"), "epa_usa")
    out = calibration.predict_all(df, {"mine": calibration.Fitted("linear", (0.5, -0.3, 20.0))})
    assert {"historical_epa_usa", "fitted_mine", "pred_mean", "pred_median", "pred_std"} <= set(out.columns)
    weights = calibration.best_fit(df.withColumn("p", F.col("lin")), ["p"], "lin", alpha=0.0)
    assert abs(weights["p"] - 1) < 1e-9
    named = calibration.fit_sites_seasons(df.withColumn("ts", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")), "lin").collect()
    assert named[0]["name"] == "linear_pa_raw_x_s01_t01"


def test_estimator_models(spark):
    class Twice:
        def predict(self, x):
            return 2 * x[:, 0]

    df = spark.createDataFrame([(3.0, 50.0), (None, 1.0)], "pa_raw_x double, rh double")
    got = [r[0] for r in df.select(calibration.Fitted("estimator", Twice()).column(F.col("pa_raw_x"), F.col("rh"))).collect()]
    assert got == [6.0, None]


def test_block_means(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(103)], "i long, v double")
    got = [r["v"] for r in blocks.block_means(df, "v", "i", 10).orderBy("block").collect()]
    assert np.allclose(got, [b.mean() for b in np.array_split(np.arange(103.0), 10)])


def test_bootstrap(spark):
    obs = np.random.default_rng(3).gamma(2, 20, 400)
    b = bootstrap.bounds(bootstrap.run(spark, obs, bootstrap.sample, [{"p": 50}], 200, n=200)).collect()[0]
    assert b["low"] < np.median(obs) < b["high"] and abs(b["mid"] - np.median(obs)) < 3
    one, two = (sorted(map(tuple, bootstrap.run(spark, obs, bootstrap.noisy, [{}], 3, n=50).collect())) for _ in range(2))
    assert one == two and len(one) == 3 * 99
    for sampler, kw in ((bootstrap.drift, {"p": 50, "dx": 0.001}), (bootstrap.replacement, {"p": 50, "step": 100}), (bootstrap.short, {"p": 50}), (bootstrap.multi_block, {"p": 50}), (bootstrap.stratified, {"p": 50, "ids": np.arange(400) % 50}), (bootstrap.aggregate, {"agg_n": 24, "agg_method": 2}), (bootstrap.noisy_block, {}), (bootstrap.tradeoff, {"noise": 0.1, "thresh": 0.2}), (bootstrap.agreement, {"loc": 0.1})):
        assert bootstrap.run(spark, obs, sampler, [kw], 2, n=100).where("value > 0").count() > 0
    assert bootstrap.run(spark, obs, bootstrap.tradeoff, [{"noise": 0.5, "thresh": 0.0}], 1).collect()[0]["value"] is None
    assert len(bootstrap.completeness_grid(200)) == 99 and len(bootstrap.tradeoff_grid()) == 9801 and len(bootstrap.aggregation_grid()) == 336


def test_baseline(spark):
    rng = np.random.default_rng(0)
    rows = [("s", datetime(2024, 1, 1, i // 2, 30 * (i % 2)), float(20 + 5 * np.sin(i / 8) + rng.gamma(1, 3))) for i in range(48)] + [("few", datetime(2024, 1, 1, i), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "sensor string, ts timestamp_ntz, v double")
    out = baseline.daily_baseline(df, "v").toPandas()
    assert set(out.sensor) == {"s"} and len(out) == 48 and (out.baseline >= 0).all() and (out.peak >= 0).all()
    assert 0.05 < (out.v < out.baseline).mean() < 0.15
    assert len(baseline.sensitivity_grid()) == 161


def field(spark, n_s=4, n_h=72, seed=0, gaps=0.4):
    rng = np.random.default_rng(seed)
    rows = [(s, h, 1 + h // 36, None if rng.random() < gaps else float(50 + 10 * s + 5 * np.sin(h / 4) + rng.normal())) for s in range(n_s) for h in range(n_h)]
    return spark.createDataFrame(rows, "s long, h long, month int, value double")


EDGES = [(a, b, 0.5 + 0.1 * min(a, b)) for a in range(4) for b in range(4) if abs(a - b) == 1]


def test_car_solution(spark):
    f, edges = field(spark), spark.createDataFrame(EDGES, "src long, dst long, w double")
    c = car.Config(iterations=2000, tolerance=1e-10)
    monthly = spark.createDataFrame([(s, m, 60.0 + s) for s in range(4) for m in (1, 2)], "s long, month int, level double")
    theta = car.fill_gaps(f, edges, monthly, c).toPandas().sort_values(["s", "h"]).theta.to_numpy()
    n = 72
    q, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    for i, j, w in EDGES:
        for h in range(n):
            q[i * n + h, i * n + h] += c.tau_spatial * w
            q[i * n + h, j * n + h] -= c.tau_spatial * w
    for k, tau in ((1, c.tau_hourly), (24, c.tau_daily)):
        for s in range(4):
            for h in range(n - k):
                x, y = s * n + h, s * n + h + k
                q[x, x] += tau
                q[y, y] += tau
                q[x, y] -= tau
                q[y, x] -= tau
    for r in f.collect():
        if r["value"] is not None:
            q[r["s"] * n + r["h"], r["s"] * n + r["h"]] += c.tau_sensor
            b[r["s"] * n + r["h"]] += c.tau_sensor * r["value"]
    for s in range(4):
        for m in (0, 1):
            at = slice(s * n + 36 * m, s * n + 36 * m + 36)
            q[at, at] += c.tau_satellite
            b[at] += c.tau_satellite * (60.0 + s) * 36
    assert np.abs(q @ theta - b).max() < 1e-4 * np.abs(b).max()


def test_car_distributed_agrees(spark):
    f, edges = field(spark, 2, 30), spark.createDataFrame([e for e in EDGES if max(e[:2]) < 2], "src long, dst long, w double")
    c = car.Config(iterations=12, tolerance=1e-3)
    cells = f.join(car.observation_precision(f, None, c.tau_sensor, 0.0), ["s", "h"], "left").na.fill(0.0, ["q", "b"]).select("s", "h", "month", "q", "b")
    a = {(r["s"], r["h"]): r["theta"] for r in car.solve(cells, edges, c).collect()}
    b = {(r["s"], r["h"]): r["theta"] for r in car.solve_distributed(cells, edges, c).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_car_helpers(spark):
    f, edges = field(spark), spark.createDataFrame(EDGES, "src long, dst long, w double")
    assert car.asymmetric(edges).count() == 0 and car.asymmetric(edges.where("src = 0")).count() == 1
    p = car.diurnal_patterns(f).groupBy("s").agg(F.avg("pattern").alias("m")).collect()
    assert all(abs(r["m"] - 1) < 1e-9 for r in p)
    assert car.borrowed_patterns(f, car.diurnal_patterns(f), edges, 45).count() == 96
    best = car.grid_search(f, edges, {"tau_spatial": [0.5, 2.0]}, c=car.Config(iterations=50)).collect()
    assert len(best) == 2 and best[0]["rmse"] <= best[1]["rmse"]
    assert car.loo_metrics(f, edges, car.Config()).collect()[0]["n"] > 0
    assert car.fine_grid({"tau": 2.0}) == {"tau": [1.0, 2.0, 3.0]}
    adj = car.exp_adjacency(spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "s long, latitude double, longitude double"))
    assert abs({(r["src"], r["dst"]): r["w"] for r in adj.collect()}[0, 2] - np.exp(-2)) < 1e-12


def test_pod(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 6))
    g = pod.GappyPOD(energy=1 - 1e-12).fit(x)
    assert np.allclose(g.reconstruction, x, atol=1e-8)
    y = x.copy()
    y[rng.random(x.shape) < 0.1] = np.nan
    g = pod.GappyPOD(n_modes=3, rounds=200, tolerance=1e-9).fit(y)
    assert np.abs(g.reconstruction - x).mean() < 0.2
    df = pod.long(spark, x, range(40), range(6), ("t", "station", "value"))
    fit = pod.GappyPOD(energy=1 - 1e-12).fit_frame(df)
    back = pod.unproject(pod.project(df, fit["spatial"], fit["mean"]), fit["spatial"], fit["mean"])
    assert df.withColumnRenamed("value", "v").join(back, ["t", "station"]).where("abs(v - value) > 1e-6").count() == 0
    tall = pod.spatial_pod(df, "t", "station", "value", 1 - 1e-12)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose([r["singular_value"] for r in tall["energy"].orderBy("mode").collect()][:3], s[:3])
    assert pod.pivot_order(np.array([[1.0, 5.0, 4.8], [0.0, 0.0, 1.0]])) == [1, 2, 0]
    modes = pod.imf_pods(df.withColumn("imf", F.lit(0)).unionByName(df.withColumn("imf", F.lit(1))))
    assert pod.compare_modes(modes).collect()[0]["cosine"] > 0.999
    h, w, phi = rng.normal(size=(9, 6)), rng.normal(size=(6, 2)), rng.normal(size=(9, 3))
    assert np.allclose(pod.reproject_mp(h, w, phi), pod.reproject_tikhonov(h, w, phi, 1e-12), atol=1e-6)


def test_space_time_model(spark):
    rng = np.random.default_rng(2)
    phi, c = rng.normal(size=(30, 2)), rng.normal(size=(2, 12))
    fieldv = (phi @ c).T
    stations = list(range(0, 30, 3))
    cov = pod.long(spark, phi @ rng.normal(size=(2, 4)), range(30), range(4), ("cell", "band", "value"))
    f = pod.long(spark, fieldv[:, stations], range(12), stations, ("t", "station", "value"))
    sampling = spark.createDataFrame([(s, s, 1.0) for s in stations], "cell long, station long, weight double")
    out = pod.space_time_model(f, cov, sampling, energy=1 - 1e-12)
    got = out["reconstruction"].toPandas().pivot(index="t", columns="cell", values="value").to_numpy()
    assert np.corrcoef(got.ravel(), fieldv.ravel())[0, 1] > 0.9
    assert pod.with_training_mask(out["reconstruction"], f, sampling).where("is_training").count() == 12 * len(stations)


def test_memd(spark):
    t = np.arange(200.0)
    x = np.column_stack((np.sin(t / 3) + np.sin(t / 25), np.cos(t / 3) + 0.5 * np.sin(t / 25)))
    imfs = memd.MEMD(n_directions=16, n_iterations=10).decompose(x)
    assert len(imfs) >= 2 and np.allclose(imfs.sum(0), x)
    assert memd.welch(imfs[0][:, 0])[1].argmax() >= memd.welch(imfs[-2][:, 0])[1].argmax()
    high, low = memd.extrema(np.array([0.0, 2.0, 1.0, 3.0, np.nan, 1.0]))
    assert high.tolist() == [1, 3] and low.tolist() == [0, 2]
    k = np.arange(6.0)
    assert np.allclose(memd.akima(k, 2 * k + 1, np.array([0.5, 4.2])), [2.0, 9.4])
    df = pod.long(spark, x, t, ["a", "b"], ("t", "station", "value")).withColumn("network", F.lit("n"))
    made = memd.decompose(df, n_directions=8, n_iterations=4)
    again = memd.reconstruct(made)
    assert again.withColumnRenamed("value", "v").join(df, ["t", "station"]).where("abs(v - value) > 1e-6").count() == 0
    assert abs(memd.imf_energies(made).agg(F.max("cumulative")).collect()[0][0] - 100) < 1e-6
    assert memd.select_imfs(made, energy_threshold=20).count() <= made.count()
    assert memd.location_metrics(made).count() > 0
    gappy = df.withColumn("value", F.when(~F.col("t").between(10, 14), F.col("value")))
    assert "5 " not in memd.report(gappy).split("missing")[0] and "longest 5" in memd.report(gappy)


def test_gp(spark):
    x = np.linspace(0, 10, 60)[:, None]
    y = np.sin(x[:, 0])
    mean, std = gpr.GP().fit(x, y, [[0.1, 0.3, 1.0]]).predict(np.array([[3.3], [50.0]]))
    assert abs(mean[0] - np.sin(3.3)) < 0.1 and std[1] > std[0]
    rows = spark.createDataFrame([(f"s{i}", float(t), 20.0 + i * 0.1, 75.0 + i * 0.05, float(50 + i + 5 * np.sin(t / 3))) for i in range(5) for t in range(20)], "station string, t double, latitude double, longitude double, value double")
    gp = gpr.fit_space_time(rows)
    assert gpr.predict_space_time(gp, rows.drop("value").limit(10)).where("std >= 0").count() == 10
    assert gpr.leave_one_site_out(rows).count() == 5


def test_variogram(spark):
    p = points(spark, 80, 7, "station").withColumn("value", F.col("latitude") * 2)
    v = gpr.variogram(p, longest=1.5)
    x = p.toPandas()
    d = np.hypot(*(x[["latitude", "longitude"]].to_numpy()[:, None] - x[["latitude", "longitude"]].to_numpy()[None]).transpose(2, 0, 1))[np.triu_indices(80, 1)]
    assert v.where("direction = 'omni'").agg(F.sum("n")).collect()[0][0] == ((d > 0) & (d <= 1.5)).sum()
    assert gpr.fit_variogram(v).where("model = 'spherical'").count() == 5


def test_pipelines(spark):
    rows = [(s, p, f"x{p}", datetime(2024, 5, 1, h), float(10 + p), float(12 + p), 50.0, 5.0, "Delhi", 20.0 + i, 75.0) for i, s in enumerate(("IITD", "B")) for p in (2 * i, 2 * i + 1) for h in range(3)]
    df = spark.createDataFrame(rows, "site string, position int, sensor string, ts timestamp_ntz, a double, b double, rh double, disagreement double, settlement string, latitude double, longitude double")
    dep = pipelines.deployment(df).orderBy("ts").collect()
    assert len(dep) == 3 and dep[0]["pa_raw_mean"] == 13.0 and dep[0]["season"] == "Pre-Monsoon" and dep[0]["latitude"] == 21.0
    col = pipelines.collocation(df).where("site = 'B'").collect()[0]
    assert col["pa_raw"] == 13.5 and abs(col["cv"] - np.std([12, 14, 13, 15], ddof=1) / 13.5) < 1e-12
    ref = spark.createDataFrame([("R", datetime(2024, 5, 1, 1), 40.0, 20.001, 75.001)], "site string, ts timestamp_ntz, pm25 double, latitude double, longitude double")
    got = pipelines.merge_collocation(df, ref).where("pm25 IS NOT NULL").collect()
    assert [(r["site"], r["pm25"]) for r in got] == [("IITD", 40.0)]
    assert pipelines.merge_phases(df, ["2024-05-01 00:00:00"], ["2024-05-01 01:00:00"]).count() == 4
    raster = spark.createDataFrame([(20.1, 75.0, 7.0), (30.0, 75.0, 8.0)], "latitude double, longitude double, population double")
    assert {r["population"] for r in pipelines.merge_deployment(df, [raster]).collect()} == {7.0}
    assert pipelines.history(df).count() == 12
