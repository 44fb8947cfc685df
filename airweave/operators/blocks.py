"""Block means and entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_means(df: DataFrame, value: str, order: str, n: int, keys: list[str] = ()) -> DataFrame:
    """Means of len // n blocks of consecutive rows; the first len % blocks have a row more (none for under n rows: one block)."""
    keys = list(keys)
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    df = df.join(total, keys) if keys else df.join(F.broadcast(total))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    k = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    small, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    head = extra * (small + 1)
    block = F.when(F.col("_i") < head, F.floor(F.col("_i") / (small + 1))).otherwise(extra + F.floor((F.col("_i") - head) / small))
    return df.withColumn("_i", i).withColumn("block", block.cast("long")).groupBy(*keys, "block").agg(F.avg(value).alias(value))


def _edges(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Unit bins from floor(min + .1) to ceil(max + .1), at least two of them."""
    low, high = F.floor(F.min(value) + 0.1), F.ceil(F.max(value) + 0.1)
    return df.groupBy(*keys).agg(low.alias("_lo"), F.greatest(high, low + 2).alias("_hi"))


def _bins(df: DataFrame, edges: DataFrame, value: str, keys: list[str]) -> DataFrame:
    at = F.when(F.col(value) == F.col("_hi"), F.col("_hi") - 1).otherwise(F.floor(value))
    joined = df.join(edges, keys) if keys else df.join(F.broadcast(edges))
    return joined.where((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def shannon_entropy(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Natural-log entropy of values in unit bins."""
    keys = list(keys)
    df = df.where(F.col(value).isNotNull())
    counts = _bins(df, _edges(df, value, keys), value, keys)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    p: Column = F.col("n") / F.col("_t")
    return (counts.join(total, keys) if keys else counts.join(F.broadcast(total))).groupBy(*keys).agg((-F.sum(p * F.log(p))).alias("entropy"))


def relative_entropy(p: DataFrame, q: DataFrame, value: str) -> DataFrame:
    """Entropy of ``p`` relative to ``q`` in ``q``'s unit bins; empty bins of q count as 1e-13."""
    p, q = p.where(F.col(value).isNotNull()), q.where(F.col(value).isNotNull())
    edges = _edges(q, value, [])
    a, b = _bins(p, edges, value, []), _bins(q, edges, value, [])
    share = lambda c, name: c.join(F.broadcast(c.agg(F.sum("n").alias("_t")))).select("bin", (F.col("n") / F.col("_t")).alias(name))
    both = share(a, "p").join(share(b, "q"), "bin", "left")
    return both.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.coalesce("q", F.lit(0.0)) + 1e-13))).alias("relative_entropy"))


def mean_over(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean along the axes that are not named."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))
