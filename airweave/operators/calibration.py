"""Calibration of raw sensor values: published models, fitted models, ensembles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airweave.functions.scalars import code_name, linear_calibration, nonlinear_calibration, season
from airweave.operators.filters import columns_with_prefix

#: Published linear models (factor of PM2.5, factor of humidity in percent, intercept).
HISTORICAL = {"campmier_delhi": (0.546, -0.936, 50.3), "campmier_hamirpur": (0.496, -0.296, 22.0), "campmier_bengaluru": (0.515, -0.139, 14.1), "epa_usa": (0.546, -0.0862, 5.75)}


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in HISTORICAL.items()], "name string, b_pa double, b_rh double, b_int double")


def raw_column(df: DataFrame, wanted: str | None = None) -> str:
    """The raw column: ``wanted``, or the first that starts with ``pa_raw_``."""
    found = columns_with_prefix(df)
    if wanted is None and not found:
        raise ValueError("no column starts with pa_raw_")
    if wanted is not None and wanted not in df.columns:
        raise ValueError(f"no column {wanted}")
    return wanted or found[0]


def apply_historical(df: DataFrame, name: str, column: str | None = None, rh: str = "rh") -> Column:
    if name not in HISTORICAL:
        raise ValueError(f"unknown model {name}; there are {sorted(HISTORICAL)}")
    return linear_calibration(F.col(raw_column(df, column)), F.col(rh), *HISTORICAL[name])


class Fitted:
    """A fitted model: kind ``linear`` (b_pa, b_rh, b_int), ``nonlinear`` (alpha, beta), or any object with ``predict``."""

    def __init__(self, kind: str, params):
        if kind not in ("linear", "nonlinear", "estimator"):
            raise ValueError(f"unknown kind of model {kind}")
        self.kind, self.params = kind, params

    def column(self, raw: Column, rh: Column) -> Column:
        if self.kind == "linear":
            return linear_calibration(raw, rh, *self.params)
        if self.kind == "nonlinear":
            return nonlinear_calibration(raw, rh / 100, *self.params)
        model = self.params

        @F.pandas_udf("double")
        def predict(a: pd.Series, b: pd.Series) -> pd.Series:
            x = np.column_stack((a.to_numpy(float), b.to_numpy(float)))
            ok = np.isfinite(x).all(1)
            out = np.full(len(x), np.nan)
            if ok.any():
                out[ok] = model.predict(x[ok])
            return pd.Series(out).where(ok)

        return predict(raw, rh)


def apply_fitted(df: DataFrame, name: str, fitted: dict[str, Fitted], column: str | None = None, rh: str = "rh") -> Column:
    """A fitted model's column; names it lacks are looked up among the published ones."""
    if name in fitted:
        return fitted[name].column(F.col(raw_column(df, column)), F.col(rh))
    return apply_historical(df, name, column, rh)


def predict_all(df: DataFrame, fitted: dict[str, Fitted] | None = None, column: str | None = None, rh: str = "rh") -> DataFrame:
    """``historical_*`` and ``fitted_*`` columns, and their mean, median and sample std."""
    fitted = fitted or {}
    made = {f"historical_{n}": apply_historical(df, n, column, rh) for n in HISTORICAL} | {f"fitted_{n}": apply_fitted(df, n, fitted, column, rh) for n in fitted}
    out = df.withColumns(made)
    return out.withColumns({f"pred_{k}": ensemble([F.col(c) for c in made], k) for k in ("mean", "median", "std")})


def ensemble(columns: list[Column], how: str = "mean") -> Column:
    """Mean, median or sample std across columns, without the missing ones."""
    xs = F.array_sort(F.filter(F.array(*columns), lambda x: x.isNotNull()))
    n = F.size(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    if how == "mean":
        return F.try_divide(total, n)
    if how == "median":
        return F.when(n > 0, (F.try_element_at(xs, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(xs, (F.floor(n / 2) + 1).cast("int"))) / 2)
    mean = F.try_divide(total, n)
    return F.when(n > 1, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)))


def fit_linear(df: DataFrame, by: list[str], raw: str, rh: str = "rh", target: str = "pm25") -> DataFrame:
    """Ordinary least squares of target on (raw, rh, 1) by group, from moments: one aggregation, nothing collected."""
    rows = df.where(F.col(raw).isNotNull() & F.col(rh).isNotNull() & F.col(target).isNotNull())
    a, b, y = F.col(raw), F.col(rh), F.col(target)
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"),
        F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    ok = (F.col("n") > 2) & (det > 1e-12 * F.col("aa") * F.col("bb"))
    p = F.when(ok, (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / F.nullif(det, F.lit(0.0)))
    q = F.when(ok, (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / F.nullif(det, F.lit(0.0)))
    return m.select(*by, "n", p.alias("b_pa"), q.alias("b_rh"), (F.col("my") - p * F.col("ma") - q * F.col("mb")).alias("b_int"))


def fit_nonlinear(df: DataFrame, by: list[str], raw: str, rh: str = "rh", target: str = "pm25", bins: int = 200, rounds: int = 50) -> DataFrame:
    """Gauss-Newton for alpha, beta of the humidity-growth model by group.

    For given humidity the model is linear in raw, so a group's sums by humidity
    step (``bins`` of them) carry all that the fit needs: groups of any size
    reach Python as at most ``bins`` rows.
    """
    rows = df.where(F.col(raw).isNotNull() & F.col(target).isNotNull() & F.col(rh).between(0, 99.9))
    f = F.floor(F.col(rh) * bins / 100)
    sums = rows.groupBy(*by, f.alias("step")).agg(F.avg(F.col(rh) / 100).alias("h"), F.sum(F.col(raw) * F.col(raw)).alias("aa"), F.sum(F.col(raw) * F.col(target)).alias("ay"), F.count("*").alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = (pdf.h / (1 - pdf.h)).to_numpy(float)
        aa, ay = pdf["aa"].to_numpy(float), pdf["ay"].to_numpy(float)
        alpha, beta = (ay.sum() / aa.sum() if aa.sum() else np.nan), 0.1
        for _ in range(rounds):
            s = 1 / (1 + beta * g)
            ja, jb = s, -alpha * g * s * s  # derivatives of the factor of raw
            h = np.array([[(aa * ja * ja).sum(), (aa * ja * jb).sum()], [(aa * ja * jb).sum(), (aa * jb * jb).sum()]])
            r = ay - alpha * s * aa
            step = np.linalg.lstsq(h, np.array([(ja * r).sum(), (jb * r).sum()]), rcond=None)[0]
            alpha, beta = alpha + step[0], max(beta + step[1], -0.9 / max(g.max(), 1e-9))
            if np.abs(step).max() < 1e-10:
                break
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [int(pdf.n.sum())], "alpha": [float(alpha)], "beta": [float(beta)]})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return sums.groupBy(*by).applyInPandas(solve, f"{kinds}, n long, alpha double, beta double")


def fit_sites_seasons(df: DataFrame, target: str = "pm25", kind: str = "linear", ts: str = "ts") -> DataFrame:
    """One model for each site, season and raw column, with codes like s01 and t01 in its name."""
    seasoned = df if "season" in df.columns else df.withColumn("season", season(F.col(ts)))
    fit = {"linear": fit_linear, "nonlinear": fit_nonlinear}[kind]
    each = [fit(seasoned, ["site", "season"], c, target=target).withColumn("raw", F.lit(c)) for c in columns_with_prefix(df)]
    if not each:
        raise ValueError("no column starts with pa_raw_")
    out = reduce(lambda a, b: a.unionByName(b), each)
    codes = lambda c, letter: seasoned.select(c).distinct().groupBy().agg(F.array_sort(F.collect_list(c)).alias("a")).select(F.posexplode("a").alias("r", c)).select(c, code_name(F.col("r") + 1, letter).alias(f"{c}_code"))  # noqa: E731  names of sites: a dimension
    out = out.join(codes("site", "s"), "site").join(codes("season", "t"), "season")
    return out.withColumn("name", F.concat_ws("_", F.lit(kind), "raw", "site_code", "season_code"))


def best_fit(df: DataFrame, predictions: list[str], target: str, alpha: float = 1.0, rounds: int = 1000) -> dict[str, float]:
    """Lasso weights without intercept of predictions for the target: (1/2n)|y - Xw|² + alpha |w|.

    The Gram matrix comes from one aggregation; coordinate descent runs on it here.
    """
    k = len(predictions)
    rows = df.na.drop(subset=[*predictions, target])
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.avg(F.col(predictions[i]) * F.col(predictions[j])) for i, j in cells], *[F.avg(F.col(p) * F.col(target)) for p in predictions]).collect()[0]
    g, c = np.zeros((k, k)), np.array([x or 0.0 for x in got[len(cells) :]])
    for (i, j), v in zip(cells, got, strict=False):
        g[i, j] = g[j, i] = v or 0.0
    w = np.zeros(k)
    for _ in range(rounds):
        old = w.copy()
        for i in range(k):
            if g[i, i] > 0:
                rho = c[i] - g[i] @ w + g[i, i] * w[i]
                w[i] = np.sign(rho) * max(abs(rho) - alpha, 0) / g[i, i]
        if np.abs(w - old).max() < 1e-10:
            break
    return dict(zip(predictions, w.tolist(), strict=True))


def meta_model(df: DataFrame, train: DataFrame | None, predictions: list[str], method: str = "mean", target: str = "pm25") -> DataFrame:
    """``meta``: mean, median or Lasso combination of predictions."""
    if method in ("mean", "median"):
        return df.withColumn("meta", ensemble([F.col(p) for p in predictions], method))
    if method != "best_fit":
        raise ValueError(f"unknown method {method}")
    w = best_fit(train, predictions, target)
    return df.withColumn("meta", reduce(lambda a, b: a + b, [F.col(p) * v for p, v in w.items()]))
