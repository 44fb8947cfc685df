"""Scalar formulas as column expressions. All pass NULL through unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airweave.functions.nulls import finite_div

#: Magnus coefficients (degrees C), Kelvin offset, degrees of latitude per km.
MAGNUS_A, MAGNUS_B, KELVIN, DEG_PER_KM = 17.625, 243.04, 273.15, 1 / 111


def relative_humidity(t: Column, dew: Column) -> Column:
    """Percent, from temperature and dew point in degrees C."""
    vapour = lambda x: F.exp(MAGNUS_A * x / (MAGNUS_B + x))
    return 100 * vapour(dew) / vapour(t)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees that the wind comes from, whole; may be 360. Calm gives 180, as two negative zeros do in IEEE arithmetic."""
    return F.when((u == 0) & (v == 0), F.lit(180.0)).otherwise(F.rint(F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))))


def celsius(kelvin: Column) -> Column:
    return kelvin - KELVIN


def disagreement(a: Column, b: Column) -> Column:
    """Percent by which two channels differ from their mean; infinite where the mean is 0 and they differ."""
    d = F.abs(a - b) * 2
    return F.when((a + b == 0) & (a != b), F.lit(float("inf"))).otherwise(F.try_divide(d, F.abs(a + b))) * 100


def disagreement_share(a: Column, b: Column) -> Column:
    """Earlier form: a fraction of the mean."""
    return finite_div(F.abs(a - b), (a + b) * 0.5)


def aqi_code(pm25: Column) -> Column:
    """Indian AQI class of PM2.5, 0 to 5; missing gives 0."""
    return F.when(pm25 > 250, 5).when(pm25 > 120, 4).when(pm25 > 90, 3).when(pm25 > 60, 2).when(pm25 > 30, 1).otherwise(0)


#: Fixed values: (last month, code, name) of the seasons.
SEASONS = [(2, 0, "Winter"), (5, 1, "Pre-Monsoon"), (9, 2, "Monsoon"), (12, 3, "Post-Monsoon")]


def season(ts: Column, name: bool = True) -> Column:
    out = None
    for last, code, label in SEASONS:
        value = F.lit(label if name else code)
        out = F.when(F.month(ts) <= last, value) if out is None else out.when(F.month(ts) <= last, value)
    return out


def wind_sector(direction: Column) -> Column:
    """Sector 0..15 of direction less 90; an angle of exactly 0 there is missing."""
    turned = F.pmod(direction - 90, F.lit(360.0))
    k = F.ceil(turned / 11.25)
    return F.when(k >= 1, F.pmod(F.floor(k / 2) - 1, F.lit(16))).cast("int")


def wind_speed_class(speed: Column) -> Column:
    """(0,1] is 0 up to (4,5] is 4; else missing."""
    k = F.ceil(speed)
    return F.when(k.between(1, 5), k - 1).cast("int")


def linear_calibration(pa: Column, rh: Column, b_pa: float, b_rh: float, b_int: float) -> Column:
    return pa * b_pa + rh * b_rh + b_int


def nonlinear_calibration(pa: Column, rh: Column, alpha: float, beta: float) -> Column:
    """``rh`` as a fraction."""
    return pa * alpha / (1 + beta * rh / (1 - rh))


def julian_date(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + 2440587.5


def local_time(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """UTC wall clock to local wall clock, both without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def from_epoch(seconds: Column, zone: str = "Asia/Kolkata") -> Column:
    return local_time(F.timestamp_seconds(seconds).cast("timestamp_ntz"), zone)


def site_sensor(site: Column, sensor: Column) -> Column:
    return F.concat_ws("&", site, sensor)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def name_suffix(path: Column, by: str = "_") -> Column:
    return F.element_at(F.split(path, by), -1)


def tile_date(path: Column) -> Column:
    """Date YYYY-MM-DD in a file name."""
    return F.to_date(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def tile_hour(path: Column) -> Column:
    """Time ddMonYYYY_HH in a file name."""
    return F.try_to_timestamp(F.regexp_extract(path, r"(\d{2}[A-Za-z]{3}\d{4}_\d{2})", 1), F.lit("ddMMMyyyy_HH")).cast("timestamp_ntz")


def gaussian_weight(distance_km: Column, sigma_km: float) -> Column:
    return F.exp(-0.5 * F.pow(distance_km / sigma_km, F.lit(2.0)))


def code_name(rank: Column, letter: str) -> Column:
    """s01, t01 and so on."""
    return F.concat(F.lit(letter), F.lpad(rank.cast("string"), 2, "0"))


def atm_to_cf1(atm: Column, spline=None) -> Column:
    """Under 20 as is, from 80 on times 1.5, between by ``spline`` (a column function, see ``airweave.functions.splines``)."""
    if spline is None:
        raise ValueError("ATM to CF1 needs a spline between 20 and 80; its knots and coefficients are not built in")
    return F.when(atm < 20, atm).when(atm >= 80, atm * 1.5).when(atm >= 20, spline(atm))
