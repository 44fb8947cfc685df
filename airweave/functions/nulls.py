"""The missing-value contract. Missing is NULL everywhere; NaN is turned into it on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame) -> DataFrame:
    """All floating columns with NaN as NULL; others as they are."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    named = {c: F.col(f"`{c}`") for c in df.columns}
    return df.select(*[F.when(~F.isnan(x), x).alias(c) if c in floats else x for c, x in named.items()])


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to even after scaling, as array libraries do."""
    return F.rint(x * 10.0**digits) / 10.0**digits if digits else F.rint(x)


def sum0(x: Column) -> Column:
    """Sum that is 0 where there is nothing to add."""
    return F.coalesce(F.sum(x), F.lit(0))


def finite_div(a: Column, b: Column) -> Column:
    """a / b; 0/0 is missing and x/0 infinite."""
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


def densify(df: DataFrame, keys: list[str], ts: str, step: str = "1 hour") -> DataFrame:
    """One row for each key and step between the first and last time of all of ``df``."""
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias(ts))
    entities = df.select(*keys).distinct() if keys else None
    grid = grid if entities is None else entities.join(grid)  # keys x steps is the asked-for result itself
    return grid.join(df, [*keys, ts], "left")
