"""Thermal, calendar and grid columns of detections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.common import col, flag, number

#: Months of the fire seasons (fixed values).
FOREST_MONTHS = (2, 3, 4, 5)
STUBBLE_MONTHS = (4, 5, 10, 11)


def brightness_difference(brightness: Column | str = "brightness", background: Column | str = "bright_t31") -> Column:
    """M1."""
    return col(brightness) - col(background)


def frp_ratio(frp: Column | str = "frp", brightness: Column | str = "brightness") -> Column:
    """M2: null where the brightness is 0."""
    return col(frp) / F.nullif(col(brightness), F.lit(0.0))


def log_frp(frp: Column | str = "frp") -> Column:
    """M3: ln(1 + max(frp, 0)), null stays null."""
    x = col(frp)
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def encode_confidence(c: Column | str = "confidence") -> Column:
    """M5: h, n, l to 2, 1, 0; numeric text to its value; anything else, null and NaN included, to 1."""
    x = F.lower(F.trim(col(c).cast("string")))
    return F.when(x == "h", 2.0).when(x == "n", 1.0).when(x == "l", 0.0).otherwise(F.coalesce(number(x), F.lit(1.0)))


def sensor_flag(source: Column | str, part: str) -> Column:
    """M6: 1 if the sensor's name holds ``part``, in any case."""
    return flag(F.contains(F.upper(col(source)), F.lit(part.upper())))


def cell_floor(c: Column | str, degrees: float = 0.01) -> Column:
    """M7: integer grid cell, cut down."""
    return F.floor(col(c) / F.lit(float(degrees))).cast("long")


def cell_round(c: Column | str, degrees: float = 0.01) -> Column:
    """M9: integer grid cell, nearest with halves to even."""
    return F.rint(col(c) / F.lit(float(degrees))).cast("long")


def grid_id(cell_y: Column | str, cell_x: Column | str, degrees: float = 0.01) -> Column:
    """M8: the cell's corner as text, for display."""
    return F.concat_ws("_", *(F.format_string("%.4f", col(c) * F.lit(float(degrees))) for c in (cell_y, cell_x)))


def hour_of(hhmm: Column | str = "acq_time") -> Column:
    """Hour of an HHMM number; what isn't a number counts as 0."""
    return F.floor(F.coalesce(number(hhmm), F.lit(0.0)) / 100).cast("int")


def is_day(daynight: Column | str = "daynight") -> Column:
    """From the day/night letter."""
    return flag(F.upper(col(daynight)) == "D")


def is_day_by_time(hhmm: Column | str = "acq_time") -> Column:
    """M12, second form: 1 from 06 to 18 h of the zero-padded time."""
    return flag(F.substring(F.lpad(col(hhmm).cast("string"), 4, "0"), 1, 2).try_cast("int").between(6, 18))


def in_months(date: Column | str, months: tuple[int, ...]) -> Column:
    """M13."""
    return flag(F.month(col(date)).isin(*months))
