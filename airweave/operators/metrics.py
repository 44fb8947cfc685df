"""Scores of predictions against truth, as aggregates. Rows where either is missing don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(y: str, yhat: str) -> tuple[Column, Column]:
    both = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    return F.when(both, F.col(y)), F.when(both, F.col(yhat))


def mae(y: str, yhat: str) -> Column:
    a, b = _pair(y, yhat)
    return F.avg(F.abs(a - b))


def rmse(y: str, yhat: str) -> Column:
    a, b = _pair(y, yhat)
    return F.sqrt(F.avg((a - b) * (a - b)))


def mbe(y: str, yhat: str) -> Column:
    """Mean of truth less prediction."""
    a, b = _pair(y, yhat)
    return F.avg(a - b)


def _percent(score: Column, y: str, yhat: str) -> Column:
    return F.try_divide(score, F.avg(_pair(y, yhat)[0])) * 100


def nmae(y: str, yhat: str) -> Column:
    return _percent(mae(y, yhat), y, yhat)


def nrmse(y: str, yhat: str) -> Column:
    return _percent(rmse(y, yhat), y, yhat)


def nmbe(y: str, yhat: str) -> Column:
    return _percent(mbe(y, yhat), y, yhat)


def r2(y: str, yhat: str) -> Column:
    """1 less residual over total sum of squares; the total is kept as a population variance, which is stable."""
    a, b = _pair(y, yhat)
    return 1 - F.try_divide(F.avg((a - b) * (a - b)), F.var_pop(a))


def adj_r2(y: str, yhat: str, k: int) -> Column:
    n = F.count(_pair(y, yhat)[0])
    return 1 - F.try_divide((1 - r2(y, yhat)) * (n - 1), n - k - 1)


def evaluate(df: DataFrame, y: str, yhat: str, by: list[str] = (), k: int = 1) -> DataFrame:
    """All scores in one pass, by group if asked."""
    scores = {"n": F.count(_pair(y, yhat)[0]), "r2": r2(y, yhat), "adj_r2": adj_r2(y, yhat, k), "mae": mae(y, yhat), "nmae": nmae(y, yhat), "rmse": rmse(y, yhat), "nrmse": nrmse(y, yhat), "mbe": mbe(y, yhat), "nmbe": nmbe(y, yhat)}
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in scores.items()])


def balanced_accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Mean over the classes of the share of each that is found."""
    return df.where(F.col(y).isNotNull()).groupBy(y).agg(F.avg(F.coalesce((F.col(y) == F.col(yhat)).cast("double"), F.lit(0.0))).alias("recall")).agg(F.avg("recall").alias("balanced_accuracy"))


def count_sensors(df: DataFrame, value: str, by: list[str], sensor: str = "sensor", least: int = 168) -> DataFrame:
    """Sensors with at least so many values, by group."""
    per = df.groupBy(*by, sensor).agg(F.count(value).alias("n"))
    return per.groupBy(*by).agg(F.count(F.when(F.col("n") >= least, 1)).alias("n_sensors"))


def group_r2(df: DataFrame, by: list[str], a: str = "a", b: str = "b", least: int = 168) -> DataFrame:
    """R² with ``a`` as truth; -1 for groups with fewer rows of both."""
    n = F.count(_pair(a, b)[0])
    return df.groupBy(*by).agg(F.when(n < least, F.lit(-1.0)).otherwise(r2(a, b)).alias("r2"))


def bias_matrix(df: DataFrame, time: str, column: str, value: str) -> DataFrame:
    """(i, j, nmbe): mean of i less j over times that have both, in percent of the mean of all of i.

    Long rows meet on time, so a time with n columns makes n² rows: that is the matrix asked for.
    """
    a = df.where(F.col(value).isNotNull()).select(F.col(time).alias("t"), F.col(column).alias("i"), F.col(value).alias("a"))
    b = a.select("t", F.col("i").alias("j"), F.col("a").alias("b"))
    own = a.groupBy("i").agg(F.avg("a").alias("mean"))
    diff = a.join(b, "t").groupBy("i", "j").agg(F.avg(F.col("a") - F.col("b")).alias("d"))
    return diff.join(own, "i").select("i", "j", (F.try_divide(F.col("d"), F.col("mean")) * 100).alias("nmbe"))
