"""Quality flags: 0 good, then the first condition that holds. Missing comparisons count as not true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted range of each regulatory pollutant.
LIMITS = {"pm25": (3, 1000), "pm10": (3, 2000), "co": (10, 4000), "no2": (2, 100), "so2": (2, 200), "o3": (2, 200)}


def range_flag(x: Column, low: float, high: float, extra: Column | None = None) -> Column:
    """1 missing, 2 out of range, 3 where ``extra`` holds, else 0."""
    out = F.when(x.isNull(), 1).when((x < low) | (x > high), 2)
    return (out if extra is None else out.when(extra, 3)).otherwise(0)


def qa_bam(df: DataFrame, value: str = "pm25_bam", status: str = "status") -> DataFrame:
    """Flag ``<value>_flag`` by range 3..1000 and instrument status, which is dropped."""
    return df.withColumn(f"{value}_flag", range_flag(F.col(value), 3, 1000, F.col(status) > 0)).drop(status)


def qa_reg(df: DataFrame, limits: dict[str, tuple[float, float]] = LIMITS, suffix: str = "_flag") -> DataFrame:
    """Flags of regulatory pollutants; PM2.5 above PM10 flags both 3, whatever their ranges say but for missing ones."""
    crossed = F.col("pm25") > F.col("pm10")
    out = {}
    for name, (low, high) in limits.items():
        if name in df.columns:
            flag = range_flag(F.col(name), low, high)
            out[name + suffix] = F.when(crossed, 3).otherwise(flag) if name in ("pm25", "pm10") and {"pm25", "pm10"} <= set(df.columns) else flag
    return df.withColumns(out)


def qa_pa(df: DataFrame, dt: float = 40, a: str = "a", b: str = "b", rh: str = "rh", disagree: str = "disagreement") -> DataFrame:
    """Flags of both channels (5..500, disagreement over ``dt`` percent) and of humidity (0..100)."""
    apart = F.col(disagree) > dt
    return df.withColumns({f"{a}_flag": range_flag(F.col(a), 5, 500, apart), f"{b}_flag": range_flag(F.col(b), 5, 500, apart), f"{rh}_flag": range_flag(F.col(rh), 0, 100)})


def qa_ghsl(df: DataFrame, value: str = "population") -> DataFrame:
    return df.withColumn(f"{value}_flag", F.when(F.col(value).isNull(), 1).when(F.col(value) == 0, 2).otherwise(0))


def qa_tropomi(df: DataFrame, value: str = "no2_column") -> DataFrame:
    return df.withColumn(f"{value}_flag", F.when(F.col(value).isNull(), 1).when(F.col(value) <= 0, 2).otherwise(0))


def qa_quantaq(df: DataFrame, flag: str = "flag_qaq", out: str = "qaq_flag") -> DataFrame:
    return df.withColumn(out, F.when(F.col(flag) > 0, 2).otherwise(0)).drop(flag)
