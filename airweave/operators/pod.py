"""Proper orthogonal decomposition, with gaps and without, reprojection and sensor placement.

Fields are long rows (t, station, value). Sums over time (Gram and correlation
matrices, projections) are Spark aggregates; what reaches numpy is a matrix over
stations, of which there are at most ``STATIONS``, or, for the iterative filling
of gaps, one field of at most ``CELLS`` values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATIONS, CELLS = 2000, 20_000_000


def wide(df: DataFrame, row: str = "t", col: str = "station", value: str = "value") -> pd.DataFrame:
    """One field as a matrix (means of repeats); raises beyond ``CELLS``."""
    means = df.groupBy(row, col).agg(F.avg(value).alias(value))
    if means.limit(CELLS + 1).count() > CELLS:
        raise ValueError(f"a field of over {CELLS} values; split it by level or period")
    return means.toPandas().pivot(index=row, columns=col, values=value).sort_index().sort_index(axis=1)


def long(spark, x: np.ndarray, rows, cols, names: tuple[str, str, str]) -> DataFrame:
    a, b, c = names
    return spark.createDataFrame(pd.DataFrame({a: np.repeat(np.asarray(rows), len(cols)), b: np.tile(np.asarray(cols), len(rows)), c: np.asarray(x, float).ravel()}))


def _signed(v: np.ndarray) -> np.ndarray:
    """Modes (columns) with their largest component positive, so that runs agree."""
    top = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
    return v * np.where(top < 0, -1, 1)


def gram(df: DataFrame, row: str, col: str, value: str) -> tuple[np.ndarray, list]:
    """(X'X, columns) of the long matrix: one join on rows and one aggregation."""
    cols = [r[0] for r in df.select(col).distinct().orderBy(col).limit(STATIONS + 1).collect()]
    if len(cols) > STATIONS:
        raise ValueError(f"over {STATIONS} columns")
    at = {c: i for i, c in enumerate(cols)}
    a = df.where(F.col(value).isNotNull()).select(F.col(row).alias("r"), F.col(col).alias("i"), F.col(value).alias("a"))
    b = a.select("r", F.col("i").alias("j"), F.col("a").alias("b"))
    g = np.zeros((len(cols), len(cols)))
    for r in a.join(b, "r").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).collect():
        g[at[r["i"]], at[r["j"]]] = g[at[r["j"]], at[r["i"]]] = r["g"]
    return g, cols


def spatial_pod(df: DataFrame, location: str = "location", band: str = "band", value: str = "value", energy: float = 0.95) -> dict:
    """SVD of a tall location x band matrix by its Gram matrix; enough modes for ``energy``.

    modes: (location, mode, value); loadings: (band, mode, value); energy: (mode, singular_value, share, cumulative).
    """
    spark = df.sparkSession
    g, bands = gram(df, location, band, value)
    w, v = np.linalg.eigh(g)
    order = np.argsort(w)[::-1]
    w, v = np.maximum(w[order], 0), _signed(v[:, order])
    share = w / max(w.sum(), 1e-300)
    k = min(int(np.searchsorted(np.cumsum(share), energy) + 1), int((w > 1e-12 * w[0]).sum()))
    s = np.sqrt(w[:k])
    loadings = long(spark, v[:, :k], bands, range(k), (band, "mode", "value"))
    scale = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(s)], "mode int, s double")
    onto = loadings.withColumn("mode", F.col("mode").cast("int")).join(F.broadcast(scale), "mode").select(band, "mode", (F.col("value") / F.col("s")).alias("_l"))
    modes = df.join(onto, band).groupBy(location, "mode").agg(F.sum(F.col(value) * F.col("_l")).alias("value"))
    return {"modes": modes, "loadings": loadings, "energy": energy_table(spark, w)}


def energy_table(spark, eigenvalues: np.ndarray) -> DataFrame:
    share = eigenvalues / max(eigenvalues.sum(), 1e-300)
    return spark.createDataFrame(pd.DataFrame({"mode": np.arange(len(share), dtype=np.int32), "singular_value": np.sqrt(np.maximum(eigenvalues, 0)), "share": share, "cumulative": np.cumsum(share)}))


def mode_energy(df: DataFrame, mode: str = "mode", value: str = "value", by: list[str] = ()) -> DataFrame:
    """Energy of each mode (sum of squares), its share, and the running share by falling energy."""
    by = list(by)
    e = df.groupBy(*by, mode).agg(F.sum(F.col(value) * F.col(value)).alias("energy"))
    share = F.try_divide(F.col("energy"), F.sum("energy").over(Window.partitionBy(*by)))
    run = Window.partitionBy(*by).orderBy(F.desc("energy"), mode).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("share", share).withColumn("cumulative", F.sum("share").over(run))


class GappyPOD:
    """POD of a field with gaps: mean-filled, then refined by at most ``rounds`` decompositions."""

    def __init__(self, n_modes: int | None = None, rounds: int = 5, tolerance: float = 1e-3, energy: float = 0.95, blend: float = 0.8):
        self.n_modes, self.rounds, self.tolerance, self.energy, self.blend = n_modes, rounds, tolerance, energy, blend

    def _modes(self, x: np.ndarray):
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        k = self.n_modes
        if k is None:
            e = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
            k = int(np.searchsorted(e, self.energy) + 1)
        k = min(k, len(s))
        turn = _signed(vt[:k].T).T
        sign = np.sign((turn * vt[:k]).sum(1))
        return u[:, :k] * sign, s[:k], turn

    def fit(self, x: np.ndarray) -> "GappyPOD":
        seen = np.isfinite(x)
        self.mean = np.array([c[k].mean() if k.any() else 0.0 for c, k in zip(x.T, seen.T, strict=True)])
        full = np.where(seen, x - self.mean, 0.0)
        self.uncertainty = (~seen).astype(float)
        self.history, before = [], None
        for i in range(self.rounds):
            u, s, vt = self._modes(full)
            made = (u * s) @ vt
            old = full[~seen]
            full[~seen] = made[~seen] if i == 0 else self.blend * made[~seen] + (1 - self.blend) * old
            if i:
                self.uncertainty[~seen] *= 0.9
            error = made[seen] - (x - self.mean)[seen]
            self.history.append((i, float(np.sqrt(np.mean(error**2))), len(s)))
            # modes that come or go count as a change in full
            if before is not None and before.shape == vt.shape and np.mean(np.abs(vt - before)) < self.tolerance:
                break
            before = vt
        self.spatial, self.temporal, self.singular, self.reconstruction, self.original = vt.T, u * s, s, made + self.mean, seen
        return self

    def fit_frame(self, df: DataFrame, row: str = "t", col: str = "station", value: str = "value") -> dict[str, DataFrame]:
        """Fit to long rows; everything comes back as long rows."""
        spark, w = df.sparkSession, wide(df, row, col, value)
        self.fit(w.to_numpy(float))
        self.rows, self.cols = list(w.index), list(w.columns)
        modes = range(len(self.singular))
        cells = long(spark, self.reconstruction, self.rows, self.cols, (row, col, "value"))
        pdf = pd.DataFrame({"uncertainty": self.uncertainty.ravel(), "is_original": self.original.ravel()})
        cells = spark.createDataFrame(pd.concat([pd.DataFrame({row: np.repeat(np.asarray(self.rows), len(self.cols)), col: np.tile(np.asarray(self.cols), len(self.rows)), "value": self.reconstruction.ravel()}), pdf], axis=1))
        return {
            "reconstruction": cells,
            "spatial": long(spark, self.spatial, self.cols, modes, (col, "mode", "value")),
            "temporal": long(spark, self.temporal, self.rows, modes, (row, "mode", "value")),
            "mean": spark.createDataFrame(pd.DataFrame({col: self.cols, "value": self.mean})),
            "history": spark.createDataFrame(self.history, "iteration int, rmse double, n_modes int"),
            "energy": energy_table(spark, self.singular**2),
        }


def project(df: DataFrame, spatial: DataFrame, mean: DataFrame | None = None, row: str = "t", col: str = "station", value: str = "value") -> DataFrame:
    """(t, mode, value): the field less its mean on spatial modes."""
    if mean is not None:
        df = df.join(mean.withColumnRenamed("value", "_m"), col).withColumn(value, F.col(value) - F.col("_m"))
    return df.select(row, col, F.col(value).alias("_v")).join(spatial, col).groupBy(row, "mode").agg(F.sum(F.col("_v") * F.col("value")).alias("value"))


def unproject(coefficients: DataFrame, spatial: DataFrame, mean: DataFrame | None = None, row: str = "t", col: str = "station") -> DataFrame:
    """(t, station, value) from coefficients and modes."""
    out = coefficients.select(row, "mode", F.col("value").alias("_c")).join(spatial, "mode").groupBy(row, col).agg(F.sum(F.col("_c") * F.col("value")).alias("value"))
    if mean is not None:
        out = out.join(mean.withColumnRenamed("value", "_m"), col).select(row, col, (F.col("value") + F.col("_m")).alias("value"))
    return out


def uncertainty_summary(cells: DataFrame, col: str = "station") -> DataFrame:
    return cells.groupBy(col).agg(F.avg("uncertainty").alias("mean"), F.max("uncertainty").alias("max"), F.avg((~F.col("is_original")).cast("double")).alias("missing"))


def gappy_correlation_pod(x: np.ndarray, energy: float = 0.99, least: int = 3, rounds: int = 10, tolerance: float = 1e-6) -> dict:
    """POD of one level by its correlation matrix; gaps are filled by the leading modes until the field's norm settles."""
    gap = ~np.isfinite(x)
    means = np.array([c[~g].mean() if (~g).any() else 0.0 for c, g in zip(x.T, gap.T, strict=True)])
    full = np.where(gap, means, x)

    def modes(f):
        c = np.nan_to_num(np.corrcoef(f.T) if f.shape[1] > 1 else np.ones((1, 1)))
        np.fill_diagonal(c, 1)
        w, v = np.linalg.eigh(c)
        return c, w[::-1], _signed(v[:, ::-1])

    if gap.any():
        norm = np.linalg.norm(full)
        for _ in range(rounds):
            _, w, v = modes(full)
            k = min(len(w), max(int(np.searchsorted(np.cumsum(w) / w.sum(), energy) + 1), min(least, len(w))))
            full[gap] = ((full @ v[:, :k]) @ v[:, :k].T)[gap]
            now = np.linalg.norm(full)
            if abs(now - norm) < tolerance * norm:
                break
            norm = now
    c, w, v = modes(full)
    return {"correlation": c, "eigenvalues": w, "eigenvectors": v, "explained": 100 * w / w.sum(), "coefficients": full @ v, "filled": full, "missing": gap}


def imf_pods(df: DataFrame, level: str = "imf", row: str = "t", col: str = "station", value: str = "value") -> DataFrame:
    """(imf, kind, mode, key, value) for all levels at once: one group and one task for each level.

    kind is eigenvalue, explained, eigenvector (key a station) or coefficient (key a time); coefficients of gaps too.
    """
    names = df.select(F.col(level).cast("int").alias("imf"), F.col(row).cast("string").alias("t"), F.col(col).cast("string").alias("station"), F.col(value).cast("double").alias("value"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="t", columns="station", values="value", dropna=False).sort_index()
        got = gappy_correlation_pod(m.to_numpy(float))
        k = len(got["eigenvalues"])
        part = lambda kind, mode, key, value: pd.DataFrame({"imf": int(pdf["imf"].iloc[0]), "kind": kind, "mode": mode, "key": key, "value": value})
        return pd.concat([
            part("eigenvalue", range(k), "", got["eigenvalues"]), part("explained", range(k), "", got["explained"]),
            part("eigenvector", np.tile(np.arange(k), k), np.repeat(m.columns.to_numpy(), k), got["eigenvectors"].ravel()),
            part("coefficient", np.tile(np.arange(k), len(m)), np.repeat(m.index.to_numpy(), k), got["coefficients"].ravel()),
        ])

    return names.groupBy("imf").applyInPandas(fit, "imf int, kind string, mode int, key string, value double")


def compare_modes(pods: DataFrame, mode: int = 0) -> DataFrame:
    """(imf_a, imf_b, cosine) of one mode of different levels, over the stations that both have."""
    v = pods.where((F.col("kind") == "eigenvector") & (F.col("mode") == mode))
    a, b = v.select("key", F.col("imf").alias("imf_a"), F.col("value").alias("a")), v.select("key", F.col("imf").alias("imf_b"), F.col("value").alias("b"))
    norm = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    return a.join(b, "key").where("imf_a < imf_b").groupBy("imf_a", "imf_b").agg(F.try_divide(F.sum(F.col("a") * F.col("b")), norm).alias("cosine"))


def reproject_mp(h: np.ndarray, w: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Coefficients (modes x r) of W (stations x r) in Phi (cells x modes), sampled by H (cells x stations): least squares."""
    return np.linalg.pinv(h.T @ phi) @ w


def reproject_tikhonov(h: np.ndarray, w: np.ndarray, phi: np.ndarray, ridge: float = 0.9) -> np.ndarray:
    a = h.T @ phi
    return np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ w)


def pivot_order(a: np.ndarray, n: int | None = None) -> list[int]:
    """Columns in the order that QR with column pivoting takes them."""
    a = np.array(a, float)
    left, out = list(range(a.shape[1])), []
    for _ in range(min(n or a.shape[1], a.shape[1])):
        norms = (a[:, left] ** 2).sum(0)
        i = left.pop(int(norms.argmax()))
        out.append(i)
        size = np.linalg.norm(a[:, i])
        if size > 1e-14:
            q = a[:, i] / size
            a = a - np.outer(q, q @ a)
    return out


def rank_sensors(spatial: DataFrame, explained: DataFrame, n_modes: int = 3, n_sensors: int | None = None, col: str = "station") -> DataFrame:
    """(rank, station, importance): pivots of the leading modes; the i-th pick has the i-th mode's share."""
    spark = spatial.sparkSession
    m = wide(spatial.where(F.col("mode") < n_modes), "mode", col, "value")
    picks = pivot_order(m.to_numpy(float), n_sensors)
    ranked = spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(picks), dtype=np.int32), col: m.columns.to_numpy()[picks]}))
    return ranked.join(explained.select(F.col("mode").cast("int").alias("rank"), F.col("share").alias("importance")), "rank", "left")


def space_time_model(field: DataFrame, covariates: DataFrame, sampling: DataFrame, energy: float = 0.95, ridge: float | None = None) -> dict:
    """Field at all cells from stations: gappy POD of stations, spatial POD of cell covariates, reprojection by ``sampling``.

    ``field`` (t, station, value), ``covariates`` (cell, band, value), ``sampling`` (cell, station, weight).
    reconstruction: (t, cell, value); parameters: (mode, r, value).
    """
    spark = field.sparkSession
    g = GappyPOD(energy=energy)
    ground = g.fit_frame(field)
    cells = spatial_pod(covariates, "cell", "band", "value", energy)
    phi = cells["modes"]
    # H'Phi, stations x modes, is one join and aggregation: cells stay on the executors
    hphi = sampling.join(phi, "cell").groupBy("station", "mode").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    a = wide(hphi, "station", "mode", "value").reindex(g.cols).fillna(0.0)
    x = a.to_numpy(float)
    coefficients = np.linalg.pinv(x) @ g.spatial if ridge is None else np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ g.spatial)
    parameters = long(spark, coefficients, list(a.columns), range(coefficients.shape[1]), ("mode", "r", "value"))
    at_cells = phi.select("cell", "mode", F.col("value").alias("_p")).join(parameters, "mode").groupBy("cell", F.col("r").alias("mode")).agg(F.sum(F.col("_p") * F.col("value")).alias("value"))
    out = unproject(ground["temporal"], at_cells, None, "t", "cell")
    mean = ground["mean"].agg(F.avg("value").alias("_m"))
    out = out.join(F.broadcast(mean)).select("t", "cell", (F.col("value") + F.col("_m")).alias("value"))
    return {"reconstruction": out, "parameters": parameters, "ground": ground, "cells": cells}


def with_training_mask(reconstruction: DataFrame, field: DataFrame, sampling: DataFrame) -> DataFrame:
    """Reconstruction with ``is_training``: cells that a station with a value at that time reads."""
    known = field.where("value IS NOT NULL").select("t", "station").join(sampling.select("cell", "station"), "station").select("t", "cell").distinct().withColumn("is_training", F.lit(True))
    return reconstruction.join(known, ["t", "cell"], "left").na.fill(False, ["is_training"])
