"""Monte-Carlo samplers of a vector of observations.

Replicates are rows of ``spark.range``: each task draws its own from a seed that
the replicate's number fixes, so a lost task draws the same again. Random
streams are ours; results agree with other implementations in distribution.

The vector of observations is data of one site or sensor and is collected once,
after its size has been checked against ``MOST``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLICATES, MOST = 1000, 5_000_000
PERCENTILES = np.arange(1, 100)


def vector(df: DataFrame, value: str = "mu", order: str | None = None) -> np.ndarray:
    """The values that are there, in order; raises beyond ``MOST``."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"), *([F.col(order).alias("o")] if order else []))
    if rows.limit(MOST + 1).count() > MOST:
        raise ValueError(f"a sampler takes at most {MOST} observations")
    pdf = (rows.orderBy("o") if order else rows).toPandas()
    return pdf["v"].to_numpy(float)


def _noise(rng, x: np.ndarray, level) -> np.ndarray:
    """Channel noise: sigma is 5/3 below 50, else a share of the value over 3."""
    return x + rng.normal(size=x.shape) * np.where(x < 50, 5 / 3, np.abs(x) * level / 3)


def _some(rng, x: np.ndarray, n: int) -> np.ndarray:
    return rng.permutation(x)[: int(n)]


def _block(rng, x: np.ndarray, n: int) -> np.ndarray:
    start = rng.integers(0, max(1, len(x) - int(n) + 1))
    return x[start : start + int(n)]


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of len // n blocks, the first of which may have a value more."""
    return np.array([b.mean() for b in np.array_split(x, max(1, len(x) // int(n)))])


def sample(obs, rng, n, p, **_):
    """Percentile of n values drawn without replacement."""
    return np.percentile(_some(rng, obs, n), p)


def drift(obs, rng, n, p, dx, **_):
    """As :func:`sample` of values whose relative noise grows by ``dx`` a step."""
    return np.percentile(_some(rng, obs * (1 + rng.normal(size=len(obs)) * dx * np.arange(1, len(obs) + 1)), n), p)


def replacement(obs, rng, n, step, p, nl1=3.0, nl2=0.05, **_):
    """As :func:`sample`; up to ``step`` noise follows ``nl1``, from there on (a replaced sensor) ``nl2``."""
    level = np.where(np.arange(len(obs)) < step, nl1, nl2)
    return np.percentile(_some(rng, obs + rng.normal(size=len(obs)) * (5 + level * obs) / 3, n), p)


def short(obs, rng, n, p, **_):
    """Percentile of a stretch of n values."""
    return np.percentile(_block(rng, obs, n), p)


def stratified(obs, rng, n, p, ids=None, **_):
    """Percentile of up to n values, one at random from each stratum."""
    ids = np.asarray(ids)
    drawn = np.array([rng.choice(obs[ids == i]) for i in np.unique(ids)])
    return np.percentile(_some(rng, drawn, n), p)


def multi_block(obs, rng, n, p, blocks=4, **_):
    """Percentile of ``blocks`` stretches at random, apart from each other, n values in all."""
    size = max(1, int(n) // blocks)
    free = len(obs) - size * blocks
    if free < 0:
        return np.percentile(obs, p)
    starts = np.sort(rng.integers(0, free + 1, blocks)) + size * np.arange(blocks)
    return np.percentile(np.concatenate([obs[s : s + size] for s in starts]), p)


def aggregate(obs, rng, agg_n, scale=0.1, agg_method=0, **_):
    """Percentiles of block means of a noisy channel (0), of two channels' mean (1), or of both stacked (2)."""
    a, b = _noise(rng, obs, scale), _noise(rng, obs, scale)
    x = a if agg_method == 0 else (a + b) / 2 if agg_method == 1 else None
    means = _means(x, agg_n) if x is not None else np.concatenate((_means(a, agg_n), _means(b, agg_n)))
    return np.percentile(means, PERCENTILES)


def noisy(obs, rng, n, noise_level=0.1, **_):
    return np.percentile(_some(rng, (_noise(rng, obs, noise_level) + _noise(rng, obs, noise_level)) / 2, n), PERCENTILES)


def noisy_block(obs, rng, n, noise_level=0.1, **_):
    return np.percentile(_block(rng, (_noise(rng, obs, noise_level) + _noise(rng, obs, noise_level)) / 2, n), PERCENTILES)


def tradeoff(obs, rng, noise, thresh, **_):
    """Median of the channels' mean where they disagree by less than ``thresh``; missing if nowhere."""
    b = obs + np.abs(rng.normal(size=len(obs)) * obs * noise)
    keep = 2 * np.abs(obs - b) < thresh * np.abs(obs + b)
    return np.median(((obs + b) / 2)[keep]) if keep.any() else np.nan


def agreement(obs, rng, n, loc=0.0, scale=0.1, percentile="all", thresh=None, **_):
    """Percentiles of two channels' mean; ``loc`` and ``scale`` set their bias and spread, below 50 with a floor of 5/3."""
    spread = np.where(obs < 50, 5 / 3, np.abs(obs) * scale / 3)
    a = obs + rng.normal(size=len(obs)) * spread
    b = obs * (1 + loc) + rng.normal(size=len(obs)) * spread
    mean = (a + b) / 2
    if thresh is not None:
        mean = mean[2 * np.abs(a - b) <= thresh * np.abs(a + b)]
    if not len(mean):
        return np.full(len(PERCENTILES) if percentile == "all" else 1, np.nan)
    return np.percentile(_some(rng, mean, n), PERCENTILES if percentile == "all" else [percentile])


def run(spark: SparkSession, obs: np.ndarray, sampler: Callable, grid: list[dict], replicates: int = REPLICATES, seed: int = 1, **fixed) -> DataFrame:
    """(cell, replicate, k, value) of a sampler over a grid of parameters: one row for each number that it gives.

    ``k`` counts the sampler's numbers, that is percentiles 1 to 99 or the one asked for.
    """
    cast = spark.sparkContext.broadcast(np.asarray(obs, float))  # checked by vector()
    total = len(grid) * replicates
    rows = spark.range(0, total, 1, max(1, min(total // 500, 4 * spark.sparkContext.defaultParallelism)))

    def draw(batches):
        x = cast.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                cell, rep = divmod(int(i), replicates)
                got = np.atleast_1d(sampler(x, np.random.default_rng((seed, cell, rep)), **(fixed | grid[cell])))
                out.append(pd.DataFrame({"cell": cell, "replicate": rep, "k": np.arange(1, len(got) + 1), "value": got}))
            if out:
                yield pd.concat(out).astype({"cell": "int32", "replicate": "int32", "k": "int32"})

    found = rows.mapInPandas(draw, "cell int, replicate int, k int, value double")
    return found.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def with_grid(df: DataFrame, grid: list[dict]) -> DataFrame:
    """Parameters beside each cell's rows; the grid is a list of literals."""
    pdf = pd.DataFrame(grid)
    pdf.insert(0, "cell", np.arange(len(grid), dtype="int32"))
    return df.join(F.broadcast(df.sparkSession.createDataFrame(pdf)), "cell")


def bounds(df: DataFrame, by: list[str] = ("cell", "k")) -> DataFrame:
    """2.5, 50 and 97.5 percent points over replicates."""
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return df.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


def aggregation_grid(methods=(0, 1), longest: int = 168) -> list[dict]:
    return [{"agg_n": n, "agg_method": m} for m in methods for n in range(1, longest + 1)]


def completeness_grid(size: int, up: bool = True) -> list[dict]:
    """n for 1 to 99 percent of ``size``, rounded up or down."""
    rule = np.ceil if up else np.floor
    return [{"n": int(max(1, rule(round(size * c / 100, 9)))), "completeness": c / 100} for c in range(1, 100)]


def tradeoff_grid() -> list[dict]:
    return [{"thresh": t / 100, "noise": n / 100} for t in range(1, 100) for n in range(1, 100)]


def wander_grid() -> list[dict]:
    return [{"scale": s / 100} for s in range(1, 100)]


def fixed_grid() -> list[dict]:
    return [{"loc": s / 100} for s in range(1, 100)]


def joint_grid() -> list[dict]:
    return [{"thresh": t / 100, "scale": 0.1, "percentile": 50} for t in range(1, 100)]


def noise_grid() -> list[dict]:
    return [{"noise_level": round(0.03 * i, 2)} for i in range(100)]


def noise_bounds(spark, obs, replicates: int = REPLICATES, n: int | None = None, grid: list[dict] | None = None) -> DataFrame:
    """Bounds of each percentile over channel noise."""
    grid = grid or noise_grid()
    return with_grid(bounds(run(spark, obs, noisy, grid, replicates, n=n or len(obs))), grid)


def replacement_bounds(spark, obs, steps: list[int], percentiles: list[float], replicates: int = REPLICATES, n: int | None = None) -> DataFrame:
    """Bounds of percentiles over the step at which a sensor was replaced."""
    grid = [{"p": p, "step": s} for p in percentiles for s in steps]
    return with_grid(bounds(run(spark, obs, replacement, grid, replicates, n=n or len(obs))), grid)
