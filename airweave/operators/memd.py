"""Multivariate empirical mode decomposition: a network's series into modes of falling frequency.

Sifting is sequential and mixes all stations, so a network is one group; many
networks decompose side by side. Gap statistics and energies are SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airweave.operators.temporal import gaps, interpolate_short


def directions(n: int, count: int = 64, seed: int = 0) -> np.ndarray:
    """Unit vectors: along a circle for two variables, else random from a seed."""
    if n == 1:
        return np.ones((1, 1))
    if n == 2:
        a = 2 * np.pi * np.arange(count) / count
        return np.column_stack((np.cos(a), np.sin(a)))
    v = np.random.default_rng(seed).normal(size=(count, n))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def project(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Projection over the variables that are there, on the direction's part in them at unit length; missing where none is."""
    ok = np.isfinite(x)
    length = np.sqrt(ok @ (d * d))
    return np.where(length > 0, np.where(ok, x, 0) @ d / np.where(length > 0, length, 1), np.nan)


def extrema(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of maxima and minima within stretches of at least 3 values, ends included."""
    ok = np.isfinite(y)
    edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(np.int8)))
    high: list[int] = []
    low: list[int] = []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a < 3:
            continue
        up = np.sign(np.diff(y[a:b]))
        left, right = np.r_[-up[0], up], np.r_[up, -up[-1]]
        high += (a + np.flatnonzero((left > 0) & (right < 0))).tolist()
        low += (a + np.flatnonzero((left < 0) & (right > 0))).tolist()
    return np.array(high, int), np.array(low, int)


def akima(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Akima's interpolation; missing outside. Straight lines under four points."""
    if len(x) < 4:
        return np.interp(at, x, y)
    m = np.diff(y) / np.diff(x)
    m = np.r_[3 * m[0] - 2 * m[1], 2 * m[0] - m[1], m, 2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]
    d = np.abs(np.diff(m))
    w1, w2 = d[2:], d[:-2]
    total = w1 + w2
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(total > 1e-9 * max(total.max(), 1e-300), (w1 * m[1:-2] + w2 * m[2:-1]) / total, (m[1:-2] + m[2:-1]) / 2)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, s = x[i + 1] - x[i], at - x[i]
    k = (y[i + 1] - y[i]) / h
    c2, c3 = (3 * k - 2 * t[i] - t[i + 1]) / h, (t[i] + t[i + 1] - 2 * k) / h**2
    return np.where((at < x[0]) | (at > x[-1]), np.nan, y[i] + s * (t[i] + s * (c2 + s * c3)))


class MEMD:
    """``per_point``: the mean envelope counts at each point the directions that reach it (the gap-aware form)."""

    def __init__(self, n_directions: int = 64, n_iterations: int = 40, stop: float = 0.075, seed: int = 0, per_point: bool = True):
        self.n_directions, self.n_iterations, self.stop, self.seed, self.per_point = n_directions, n_iterations, stop, seed, per_point

    def mean_envelope(self, x: np.ndarray, t: np.ndarray) -> np.ndarray | None:
        total, count, used = np.zeros_like(x), np.zeros_like(x), 0
        for d in directions(x.shape[1], self.n_directions, self.seed):
            high, low = extrema(project(x, d))
            if len(high) < 2 or len(low) < 2:
                continue
            for v in range(x.shape[1]):
                a, b = high[np.isfinite(x[high, v])], low[np.isfinite(x[low, v])]
                if len(a) < 2 or len(b) < 2:
                    continue
                mid = (akima(t[a], x[a, v], t) + akima(t[b], x[b, v], t)) / 2
                ok = np.isfinite(mid)
                total[ok, v] += mid[ok]
                count[ok, v] += 1
            used += 1
        if not used:
            return None
        share = np.maximum(count, 1) if self.per_point else used
        return np.where(np.isfinite(x), total / share, np.nan)

    def sift(self, x: np.ndarray, t: np.ndarray) -> np.ndarray | None:
        mode = x.copy()
        for _ in range(self.n_iterations):
            mean = self.mean_envelope(mode, t)
            if mean is None:
                return None if mode is x else mode
            then = mode - mean
            ratios = []
            for v in range(x.shape[1]):
                ok = np.isfinite(then[:, v])
                top = np.abs(then[ok, v]).max() if ok.any() else 0
                if top > 1e-10:
                    ratios.append(np.mean(np.abs(mean[ok, v])) / top)
            mode = then
            if not ratios or np.mean(ratios) < self.stop:
                break
        return mode

    def decompose(self, x: np.ndarray, most: int = 10) -> np.ndarray:
        """(imf, time, variable); the modes and the residue, last, add up to the series."""
        x = np.atleast_2d(np.asarray(x, float).T).T
        t, out, rest = np.arange(len(x), dtype=float), [], x.copy()
        for _ in range(most):
            ok = np.isfinite(rest)
            if not ok.any() or np.abs(rest[ok]).max() < 1e-8:
                break
            high, low = extrema(project(rest, np.full(rest.shape[1], 1 / rest.shape[1])))
            if out and len(high) + len(low) <= 2:
                break
            mode = self.sift(rest, t)
            if mode is None or not np.isfinite(mode).any() or np.nanmax(np.abs(mode)) < 1e-8:
                break
            out.append(mode)
            rest = rest - mode
        ok = np.isfinite(rest)
        if not out or np.abs(rest[ok]).max(initial=0) >= 1e-8:
            out.append(rest)
        return np.array(out)


def fill_short(x: np.ndarray, longest: int = 3) -> np.ndarray:
    """Straight lines across short gaps, column by column."""
    out = x.copy()
    for v in range(x.shape[1]):
        ok = np.isfinite(x[:, v])
        edge = np.flatnonzero(np.diff(np.r_[False, ~ok, False].astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if 0 < a and b < len(x) and b - a <= longest:
                out[a:b, v] = np.interp(np.arange(a, b), (a - 1, b), (x[a - 1, v], x[b, v]))
    return out


def decompose(df: DataFrame, network: str = "network", t: str = "t", station: str = "station", value: str = "value", most: int = 10, gap_threshold: int = 3, min_segment: int = 24, **kw) -> DataFrame:
    """(network, imf, t, station, value): one task for each network.

    Gaps of up to ``gap_threshold`` steps are bridged first; stretches under
    ``min_segment`` between longer gaps are left out; longer gaps stay missing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=t, columns=station, values=value, dropna=False).sort_index()
        x = fill_short(m.to_numpy(float), gap_threshold)
        for v in range(x.shape[1]):
            edge = np.flatnonzero(np.diff(np.r_[False, np.isfinite(x[:, v]), False].astype(np.int8)))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a < min(min_segment, len(x)):
                    x[a:b, v] = np.nan
        imfs = MEMD(**kw).decompose(x, most)
        k, n, s = imfs.shape
        return pd.DataFrame({
            network: pdf[network].iloc[0], "imf": np.repeat(np.arange(k, dtype=np.int32), n * s), t: np.tile(np.repeat(m.index.to_numpy(), s), k),
            station: np.tile(m.columns.to_numpy(), k * n), "value": imfs.ravel(),
        }).dropna(subset=["value"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (network, t, station)]
    return df.select(network, t, station, F.col(value).cast("double").alias(value)).groupBy(network).applyInPandas(run, f"{kinds[0]}, imf int, {kinds[1]}, {kinds[2]}, value double")


def imf_energies(imfs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(imf, energy, percent, cumulative), in order of imf."""
    by = list(by)
    e = imfs.groupBy(*by, "imf").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    e = e.withColumn("percent", F.try_divide(F.col("energy"), F.sum("energy").over(Window.partitionBy(*by))) * 100)
    return e.withColumn("cumulative", F.sum("percent").over(Window.partitionBy(*by).orderBy("imf").rowsBetween(Window.unboundedPreceding, 0)))


def select_imfs(imfs: DataFrame, indices: list[int] | None = None, energy_threshold: float | None = None) -> DataFrame:
    """Modes by number, or those with at least so many percent of the energy."""
    if indices is not None:
        return imfs.where(F.col("imf").isin(indices))
    if energy_threshold is not None:
        return imfs.join(imf_energies(imfs).where(F.col("percent") >= energy_threshold).select("imf"), "imf", "left_semi")
    return imfs


def reconstruct(imfs: DataFrame, keys: list[str] = ("t", "station")) -> DataFrame:
    return imfs.groupBy(*keys).agg(F.sum("value").alias("value"))


def welch(x: np.ndarray, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, power) by Hann windows of ``size`` that overlap by half, each without its mean."""
    n = min(size, len(x))
    if n < 2:
        return np.zeros(1), np.zeros(1)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = [x[i : i + n] for i in range(0, len(x) - n + 1, max(1, n // 2))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * w)) ** 2 for p in parts], axis=0) / (w**2).sum()
    power[1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n), power


def location_metrics(imfs: DataFrame, station: str = "station", t: str = "t") -> DataFrame:
    """Spread, energy, amplitude and dominant frequency of each mode at each station."""
    v, q = F.col("value"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    plain = imfs.groupBy("imf", station).agg(F.stddev_pop("value").alias("std"), (q[1] - q[0]).alias("iqr"), F.sum(v * v).alias("energy"), F.avg(F.abs(v)).alias("mean_abs"), F.sqrt(F.avg(v * v)).alias("rms"))

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = welch(pdf.sort_values(t)["value"].to_numpy(float))
        return pd.DataFrame({"imf": [pdf["imf"].iloc[0]], station: [pdf[station].iloc[0]], "dominant_frequency": [float(f[p.argmax()])], "spectral_energy": [float(p.sum())]})

    kind = imfs.schema[station].dataType.simpleString()
    return plain.join(imfs.select("imf", station, t, "value").groupBy("imf", station).applyInPandas(spectrum, f"imf int, `{station}` {kind}, dominant_frequency double, spectral_energy double"), ["imf", station])


def missing_statistics(df: DataFrame, value: str = "value", station: str = "station", t: str = "t") -> DataFrame:
    """Share of missing values, number and longest and mean length of gaps, by station."""
    g = gaps(df, value, [station], t).groupBy(station).agg(F.count("*").alias("n_gaps"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"))
    return df.groupBy(station).agg(F.count("*").alias("n"), (1 - F.count(value) / F.count("*")).alias("missing")).join(g, station, "left").na.fill(0, ["n_gaps", "longest"])


def report(df: DataFrame, **kw) -> str:
    """Text of :func:`missing_statistics`, a line a station."""
    rows = missing_statistics(df, **kw).orderBy(kw.get("station", "station")).collect()
    return "\n".join(f"{r[0]}: {r['missing']:.1%} of {r['n']} missing in {r['n_gaps']} gaps, longest {r['longest']}" for r in rows)


__all__ = ["MEMD", "akima", "decompose", "extrema", "fill_short", "imf_energies", "interpolate_short", "location_metrics", "missing_statistics", "reconstruct", "report", "select_imfs", "welch"]
