"""Conditional autoregressive gap filling of an hourly field over settlements.

The field is long rows (s, h, value). No precision matrix is ever built: its
product with a field is a join with the edges of the settlement graph and
``lag``/``lead`` over hours. Conjugate gradients run as a driver loop of such
products, each written to the shared folder. A field of at most ``SMALL`` cells
is solved in numpy by the same operator.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from airweave.session import shared_path

SMALL = 1_000_000


@dataclass(frozen=True)
class Config:
    """Default precisions, neighbours, hour of the satellite's pass, iterations."""

    tau_spatial: float = 2.0
    tau_hourly: float = 0.1
    tau_daily: float = 0.01
    tau_sensor: float = 20.0
    tau_satellite: float = 4.0
    k: int = 3
    hour: int = 13
    iterations: int = 500
    tolerance: float = 1e-6


def _stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, "field")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exp_adjacency(points: DataFrame, key: str = "s", lat: str = "latitude", lon: str = "longitude", reach: float = 10.0) -> DataFrame:
    """(src, dst, w = exp(-degrees)) of pairs nearer than ``reach`` (where w falls under 5e-5), by grid buckets."""
    b = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = points.select(F.col(key).alias("src"), F.col(lat).alias("_y"), F.col(lon).alias("_x"), b(lat).alias("by"), b(lon).alias("bx"))
    q = p.withColumnsRenamed({"src": "dst", "_y": "_v", "_x": "_u"})
    p = p.withColumn("o", F.explode(around)).withColumns({"by": F.col("by") + F.col("o.i"), "bx": F.col("bx") + F.col("o.j")})
    d = F.sqrt(F.pow(F.col("_y") - F.col("_v"), F.lit(2.0)) + F.pow(F.col("_x") - F.col("_u"), F.lit(2.0)))
    return p.join(q, ["by", "bx"]).where("src <> dst").withColumn("d", d).where(F.col("d") < reach).select("src", "dst", F.exp(-F.col("d")).alias("w"))


def inverse_distance_adjacency(near: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(src, dst, w) from directed neighbours (src, dst, distance): 1/d, then the mean of both directions."""
    if cutoff is not None:
        near = near.where(F.col("distance") <= cutoff)
    one = near.select("src", "dst", (F.lit(1.0) / F.greatest(F.col("distance"), F.lit(1e-10))).alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def diurnal_patterns(field: DataFrame, least: float = 0.0) -> DataFrame:
    """(s, hod, pattern): mean by h mod 24, over the mean of the 24 (hours without values count 0); 1 without values."""
    clock = field.where("value IS NOT NULL").groupBy("s", (F.col("h") % 24).alias("hod")).agg(F.avg("value").alias("m"))
    total = clock.groupBy("s").agg((F.sum("m") / 24).alias("mean"))
    grid = field.select("s").distinct().select("s", F.explode(F.sequence(F.lit(0), F.lit(23)).cast(ArrayType(field.schema["h"].dataType))).alias("hod"))
    out = grid.join(clock, ["s", "hod"], "left").join(total, "s", "left")
    return out.select("s", "hod", F.when(F.col("mean") > least, F.coalesce("m", F.lit(0.0)) / F.col("mean")).otherwise(1.0).alias("pattern"))


def diurnal_weights(field: DataFrame) -> DataFrame:
    """Earlier form: patterns over their largest value."""
    p = diurnal_patterns(field)
    return p.withColumn("pattern", F.try_divide(F.col("pattern"), F.max("pattern").over(Window.partitionBy("s"))))


def borrowed_patterns(field: DataFrame, patterns: DataFrame, edges: DataFrame, threshold: int = 100, least: float = 0.01) -> DataFrame:
    """Patterns of settlements with few values replaced by their neighbours' weighted mean, over its own mean."""
    counts = field.groupBy("s").agg(F.count("value").alias("n"))
    poor, rich = counts.where(F.col("n") < threshold).select("s"), counts.where(F.col("n") >= threshold).select(F.col("s").alias("dst"))
    links = edges.where(F.col("w") > least).join(poor, edges["src"] == poor["s"]).join(rich, "dst").select("s", "dst", "w")
    lent = links.join(patterns.select(F.col("s").alias("dst"), "hod", "pattern"), "dst").groupBy("s", "hod").agg((F.sum(F.col("w") * F.col("pattern")) / F.sum("w")).alias("b"))
    lent = lent.withColumn("b", F.try_divide(F.col("b"), F.avg("b").over(Window.partitionBy("s"))))
    return patterns.join(lent, ["s", "hod"], "left").select("s", "hod", F.coalesce("b", "pattern").alias("pattern"))


def anchored_fill(field: DataFrame, monthly: DataFrame, patterns: DataFrame) -> DataFrame:
    """Level of the month (s, month, level) times pattern of the hour, for each cell (s, h, month)."""
    return field.join(monthly, ["s", "month"]).withColumn("hod", F.col("h") % 24).join(patterns, ["s", "hod"]).withColumn("filled", F.col("level") * F.col("pattern")).drop("hod")


def prior_mean(field: DataFrame, monthly: DataFrame, patterns: DataFrame, as_total: bool = False) -> DataFrame:
    """As :func:`anchored_fill`; ``as_total`` spreads a monthly total over the month's hours."""
    out = anchored_fill(field, monthly, patterns)
    if as_total:
        hours = field.select("h", "month").distinct().groupBy("month").agg(F.count("*").alias("_n"))
        out = out.join(hours, "month").withColumn("filled", F.col("filled") / F.col("_n")).drop("_n")
    return out.select("s", "h", F.col("filled").alias("mu"))


def sensor_informed_prior(field: DataFrame, edges: DataFrame, monthly: DataFrame, least: float = 0.01, default: float = 50.0) -> DataFrame:
    """Observed value, else neighbours' weighted mean, else the hour's mean, else the satellite's level, else a default."""
    seen = field.where("value IS NOT NULL").select(F.col("s").alias("dst"), "h", F.col("value").alias("v"))
    near = edges.where(F.col("w") > least).join(seen, "dst").groupBy(F.col("src").alias("s"), "h").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("near"))
    hour = seen.groupBy("h").agg(F.avg("v").alias("hour"))
    out = field.join(near, ["s", "h"], "left").join(hour, "h", "left").join(monthly, ["s", "month"], "left")
    return out.select("s", "h", F.coalesce("value", "near", "hour", "level", F.lit(default)).alias("mu"))


def normalized_sensors(field: DataFrame, monthly: DataFrame) -> DataFrame:
    """Values scaled so that their mean over each settlement's month is the satellite's."""
    mean = F.avg("value").over(Window.partitionBy("s", "month"))
    out = field.withColumn("_m", mean).join(monthly, ["s", "month"], "left")
    return out.withColumn("value", F.when((F.col("_m") > 0) & F.col("level").isNotNull(), F.col("value") * F.col("level") / F.col("_m")).otherwise(F.col("value"))).drop("_m", "level")


def observation_precision(field: DataFrame, daily: DataFrame | None, tau_sensor: float, tau_satellite: float, hour: int = 13) -> DataFrame:
    """(s, h, q, b) summed over sensor hours and, at ``hour`` of each day, satellite values (s, day, value)."""
    rows = field.where("value IS NOT NULL").select("s", "h", F.lit(tau_sensor).alias("q"), (F.col("value") * tau_sensor).alias("b"))
    if daily is not None:
        rows = rows.unionByName(daily.where("value IS NOT NULL").select("s", (F.col("day") * 24 + hour).cast(field.schema["h"].dataType).alias("h"), F.lit(tau_satellite).alias("q"), (F.col("value") * tau_satellite).alias("b")))
    return rows.groupBy("s", "h").agg(F.sum("q").alias("q"), F.sum("b").alias("b"))


def prior_product(field: DataFrame, edges: DataFrame, c: Config, x: str = "x") -> DataFrame:
    """(s, h, x, y): y is the prior precision times x."""
    w = Window.partitionBy("s").orderBy("h")

    def steps(n: int) -> Column:
        back, ahead = F.lag(x, n).over(w), F.lead(x, n).over(w)
        return F.coalesce(F.col(x) - back, F.lit(0.0)) + F.coalesce(F.col(x) - ahead, F.lit(0.0))

    timed = field.withColumn("_t", c.tau_hourly * steps(1) + c.tau_daily * steps(24))
    out = field.select(F.col("s").alias("dst"), "h", F.col(x).alias("_o"))
    pulled = edges.join(out, "dst").groupBy(F.col("src").alias("s"), "h").agg(F.sum(F.col("w") * F.col("_o")).alias("_p"))
    degree = edges.groupBy(F.col("src").alias("s")).agg(F.sum("w").alias("_d"))
    joined = timed.join(pulled, ["s", "h"], "left").join(degree, "s", "left")
    return joined.withColumn("y", F.col("_t") + c.tau_spatial * (F.coalesce("_d", F.lit(0.0)) * F.col(x) - F.coalesce("_p", F.lit(0.0)))).drop("_t", "_p", "_d")


def month_product(field: DataFrame, tau: float, x: str = "x") -> Column:
    """Satellite constraint on a month's mean, times x, for rows with s and month: tau * A'A x."""
    return tau * F.sum(x).over(Window.partitionBy("s", "month"))


def solve(cells: DataFrame, edges: DataFrame, c: Config = Config(), monthly_tau: float = 0.0, start: float | None = None) -> DataFrame:
    """(s, h, theta) of (prior + q) theta = b by conjugate gradients; ``cells`` has s, h, q, b and, with ``monthly_tau``, month.

    With a monthly constraint, b holds tau times the month's total where it applies.
    """
    n = cells.count()
    return _solve_numpy(cells, edges, c, monthly_tau, start) if n <= SMALL else solve_distributed(cells, edges, c, monthly_tau, start)


def solve_distributed(cells: DataFrame, edges: DataFrame, c: Config, monthly_tau: float = 0.0, start: float | None = None) -> DataFrame:
    """The driver loop: two sums a step come to it, the field stays on the executors."""
    edges = _stored(edges)

    def times(v: DataFrame, x: str) -> DataFrame:
        out = prior_product(v, edges, c, x).withColumn("y", F.col("y") + F.col("q") * F.col(x))
        return out.withColumn("y", F.col("y") + month_product(out, monthly_tau, x)) if monthly_tau else out

    x0 = F.lit(float(start or 0.0))
    v = times(cells.withColumns({"theta": x0, "x": x0}), "x").withColumn("r", F.col("b") - F.col("y")).withColumn("p", F.col("r")).drop("y", "x")
    v = _stored(v)
    rr = first = v.agg(F.sum(F.col("r") * F.col("r"))).collect()[0][0] or 0.0
    for _ in range(c.iterations):
        if rr <= c.tolerance**2 * max(first, 1e-300):
            break
        v = _stored(times(v, "p"))
        curve = v.agg(F.sum(F.col("p") * F.col("y"))).collect()[0][0]
        if not curve or curve <= 0:
            break
        a = rr / curve
        v = v.withColumns({"theta": F.col("theta") + a * F.col("p"), "r": F.col("r") - a * F.col("y")}).drop("y")
        then = v.agg(F.sum(F.col("r") * F.col("r"))).collect()[0][0]
        v = _stored(v.withColumn("p", F.col("r") + then / rr * F.col("p")))
        rr = then
    return v.select("s", "h", "theta")


def operator(edges: list[tuple[int, int, float]], n_s: int, c: Config, q: np.ndarray, months: np.ndarray | None = None, monthly_tau: float = 0.0):
    """The same product on a (settlement x hour) array."""
    src, dst, w = (np.array(x) for x in zip(*edges, strict=True)) if edges else (np.empty(0, int), np.empty(0, int), np.empty(0))
    degree = np.bincount(src, w, n_s) if len(src) else np.zeros(n_s)

    def times(x: np.ndarray) -> np.ndarray:
        pulled = np.zeros_like(x)
        np.add.at(pulled, src, w[:, None] * x[dst])
        y = c.tau_spatial * (degree[:, None] * x - pulled) + q * x
        for n, tau in ((1, c.tau_hourly), (24, c.tau_daily)):
            if x.shape[1] > n:
                d = x[:, n:] - x[:, :-n]
                y[:, n:] += tau * d
                y[:, :-n] -= tau * d
        if monthly_tau:
            for m in np.unique(months):
                y[:, months == m] += monthly_tau * x[:, months == m].sum(1, keepdims=True)
        return y

    return times


def cg(times, b: np.ndarray, x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    r = b - times(x)
    p, rr = r.copy(), float((r * r).sum())
    first = rr
    for _ in range(iterations):
        if rr <= tolerance**2 * max(first, 1e-300):
            break
        y = times(p)
        curve = float((p * y).sum())
        if curve <= 0:
            break
        x, r = x + rr / curve * p, r - rr / curve * y
        then = float((r * r).sum())
        p, rr = r + then / rr * p, then
    return x


def _solve_numpy(cells: DataFrame, edges: DataFrame, c: Config, monthly_tau: float, start: float | None) -> DataFrame:
    spark = cells.sparkSession
    pdf = cells.toPandas().sort_values(["s", "h"])
    ss, hs = np.sort(pdf["s"].unique()), np.sort(pdf["h"].unique())
    at = {s: i for i, s in enumerate(ss)}
    i, j = pdf["s"].map(at).to_numpy(), np.searchsorted(hs, pdf["h"].to_numpy())
    q, b = np.zeros((len(ss), len(hs))), np.zeros((len(ss), len(hs)))
    q[i, j], b[i, j] = pdf["q"], pdf["b"]
    links = [(at[r["src"]], at[r["dst"]], r["w"]) for r in edges.collect() if r["src"] in at and r["dst"] in at]
    months = None
    if monthly_tau:
        months = np.zeros(len(hs))
        months[j] = pdf["month"]
    x = cg(operator(links, len(ss), c, q, months, monthly_tau), b, np.full(b.shape, float(start or 0.0)), c.iterations, c.tolerance)
    pdf = pdf[["s", "h"]].assign(theta=x[i, j])
    s, h = cells.schema["s"].dataType.simpleString(), cells.schema["h"].dataType.simpleString()
    return spark.createDataFrame(pdf, f"s {s}, h {h}, theta double")


def fill_gaps(field: DataFrame, edges: DataFrame, monthly: DataFrame | None = None, c: Config = Config(), prior: DataFrame | None = None) -> DataFrame:
    """MAP field (s, h, theta) of hourly values (s, h, month, value), a monthly mean (s, month, level) and a prior mean (s, h, mu).

    The constraint on a month is on its total: level times hours. Where there is a
    prior mean, the solution is that mean plus the field of what it leaves.
    """
    obs = observation_precision(field, None, c.tau_sensor, 0.0)
    cells = field.join(obs, ["s", "h"], "left").na.fill(0.0, ["q", "b"])
    if prior is not None:
        cells = cells.join(prior, ["s", "h"]).withColumn("b", F.col("b") - F.col("q") * F.col("mu"))
    else:
        cells = cells.withColumn("mu", F.lit(0.0))
    tau = 0.0
    if monthly is not None:
        tau = c.tau_satellite
        month = Window.partitionBy("s", "month")
        goal = F.coalesce(F.col("level"), F.lit(0.0)) * F.count("*").over(month) - F.sum("mu").over(month)
        cells = cells.join(monthly, ["s", "month"], "left").withColumn("b", F.col("b") + tau * goal)
    out = solve(cells.select("s", "h", "month", "q", "b"), edges, c, tau)
    return out.join(cells.select("s", "h", "mu"), ["s", "h"]).select("s", "h", (F.col("theta") + F.col("mu")).alias("theta"))


def fit_statistics(theta: DataFrame, field: DataFrame) -> DataFrame:
    """RMSE, mean and population std of error, and squared correlation, over the cells with values."""
    both = theta.join(field.where("value IS NOT NULL"), ["s", "h"]).withColumn("e", F.col("theta") - F.col("value"))
    return both.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean_error"), F.stddev_pop("e").alias("std_error"), F.pow(F.corr("theta", "value"), F.lit(2.0)).alias("r2"))


def loo_predictions(cells: DataFrame, theta: str = "theta", q: str = "q", tau: str = "tau", y: str = "y") -> DataFrame:
    """Leave-one-out prediction (q theta - tau y) / (q - tau), without cells where q - tau is at most 1e-10."""
    d = F.col(q) - F.col(tau)
    return cells.where(d > 1e-10).withColumn("loo", (F.col(q) * F.col(theta) - F.col(tau) * F.col(y)) / d)


def precision_diagonal(field: DataFrame, edges: DataFrame, obs: DataFrame, c: Config) -> DataFrame:
    """(s, h, q): diagonal of prior and observation precision."""
    w = Window.partitionBy("s").orderBy("h")
    n = lambda k: F.lag("h", k).over(w).isNotNull().cast("int") + F.lead("h", k).over(w).isNotNull().cast("int")
    degree = edges.groupBy(F.col("src").alias("s")).agg(F.sum("w").alias("_d"))
    out = field.select("s", "h").withColumn("_t", c.tau_hourly * n(1) + c.tau_daily * n(24)).join(degree, "s", "left").join(obs.select("s", "h", F.col("q").alias("_q")), ["s", "h"], "left")
    return out.select("s", "h", (F.col("_t") + c.tau_spatial * F.coalesce("_d", F.lit(0.0)) + F.coalesce("_q", F.lit(0.0))).alias("q"))


def loo_metrics(field: DataFrame, edges: DataFrame, c: Config, monthly: DataFrame | None = None) -> DataFrame:
    """RMSE and mean of leave-one-out residuals of the sensors."""
    theta = fill_gaps(field, edges, monthly, c)
    obs = observation_precision(field, None, c.tau_sensor, 0.0)
    q = precision_diagonal(field, edges, obs, c)
    cells = theta.join(q, ["s", "h"]).join(field.where("value IS NOT NULL").select("s", "h", F.col("value").alias("y")), ["s", "h"]).withColumn("tau", F.lit(c.tau_sensor))
    e = F.col("loo") - F.col("y")
    return loo_predictions(cells).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count("*").alias("n"))


def split(field: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test fields; which values are held out depends on their cell and the seed alone."""
    out = F.pmod(F.xxhash64(F.lit(seed), "s", "h"), F.lit(10_000)) < int(share * 10_000)
    keep = lambda c: field.withColumn("value", F.when(c, F.col("value")))
    return keep(~out), keep(out)


def grid_search(field: DataFrame, edges: DataFrame, grid: dict[str, list[float]], monthly: DataFrame | None = None, c: Config = Config(), how: str = "holdout") -> DataFrame:
    """Scores of each combination of ``grid``, best first: of held-out values, or by leave-one-out."""
    train, test = split(field)
    rows = []
    for values in itertools.product(*grid.values()):
        one = dict(zip(grid, map(float, values), strict=True))
        cc = replace(c, **one)
        got = (loo_metrics(field, edges, cc, monthly) if how == "loo" else fit_statistics(fill_gaps(train, edges, monthly, cc), test)).collect()[0]
        rows.append((*one.values(), got["rmse"]))
    return field.sparkSession.createDataFrame(rows, ", ".join(f"{k} double" for k in grid) + ", rmse double").orderBy("rmse")


def fine_grid(best: dict[str, float], factor: float = 0.5) -> dict[str, list[float]]:
    return {k: [v * (1 - factor), v, v * (1 + factor)] for k, v in best.items()}


def bias_corrected(pred: DataFrame, field: DataFrame, least: int = 10) -> DataFrame:
    """Predictions (s, h, theta) less each settlement's median error, where it has more than ``least``."""
    errors = pred.join(field.where("value IS NOT NULL").select("s", "h", "value"), ["s", "h"]).groupBy("s").agg(F.count("*").alias("n"), F.median(F.col("theta") - F.col("value")).alias("m"))
    return pred.join(errors, "s", "left").select("s", "h", F.when(F.col("n") > least, F.col("theta") - F.col("m")).otherwise(F.col("theta")).alias("theta"))


def residuals(pred: DataFrame, field: DataFrame, by: str = "s") -> DataFrame:
    """Mean, median, std and count of errors by settlement or by hour of day (``hod``)."""
    e = pred.join(field.where("value IS NOT NULL").select("s", "h", "value"), ["s", "h"]).select("s", (F.col("h") % 24).alias("hod"), (F.col("theta") - F.col("value")).alias("e"))
    return e.groupBy(by).agg(F.avg("e").alias("mean"), F.median("e").alias("median"), F.stddev_samp("e").alias("std"), F.count("*").alias("n"))


def flat_index(s: Column, h: Column, n_hours: int) -> Column:
    return s * n_hours + h


def unflatten(index: Column, n_hours: int) -> tuple[Column, Column]:
    return F.floor(index / n_hours), index % n_hours


def asymmetric(edges: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Edges whose opposite is missing or has another weight: none in a symmetric graph."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("_w"))
    return edges.join(back, ["src", "dst"], "left").where(F.col("_w").isNull() | (F.abs(F.col("w") - F.col("_w")) > tolerance)).drop("_w")
