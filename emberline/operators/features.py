"""Feature columns of detections: calendar, thermal, grid persistence, local anomaly, land cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import thermal as th
from emberline.functions.common import flag
from emberline.functions.labels import landcover_class
from emberline.params import DEFAULTS, Params
from emberline.sources.shared import materialize


def temporal_features(df: DataFrame) -> DataFrame:
    """M10-M13; a missing daynight column counts as night."""
    day = th.is_day("daynight") if "daynight" in df.columns else F.lit(0)
    return df.withColumns({
        "day_of_year": F.dayofyear("acq_date"), "month": F.month("acq_date"), "year": F.year("acq_date"), "hour": th.hour_of("acq_time"), "is_day": day,
        "is_forest_fire_season": th.in_months("acq_date", th.FOREST_MONTHS), "is_stubble_burning_season": th.in_months("acq_date", th.STUBBLE_MONTHS),
    })


def thermal_features(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """M1-M3, M5-M8."""
    g = params.grid_degrees
    df = df.withColumns({
        "brightness_difference": th.brightness_difference(), "frp_brightness_ratio": th.frp_ratio(), "log_frp": th.log_frp(), "confidence_encoded": th.encode_confidence(),
        "is_n20": th.sensor_flag("satellite_source", "N20"), "is_npp": th.sensor_flag("satellite_source", "NPP"), "cell_y": th.cell_floor("latitude", g), "cell_x": th.cell_floor("longitude", g),
    })
    return df.withColumn("grid_id", th.grid_id("cell_y", "cell_x", g))


def active_days(df: DataFrame, keys: tuple[str, ...] = ("cell_y", "cell_x"), by_year: bool = True) -> DataFrame:
    """A3, A4: distinct dates of each cell, per calendar year or over all time."""
    by = [F.col(k) for k in keys] + ([F.year("acq_date").alias("year")] if by_year else [])
    return df.groupBy(*by).agg(F.countDistinct("acq_date").alias("grid_active_days"))


def grid_persistence(df: DataFrame) -> DataFrame:
    """Count, total power and active days of each row's cell.

    The statistics are aggregated first, with partial sums on the map side, and joined back; a cell with many rows costs no single task a sort.
    """
    cells = df.groupBy("cell_y", "cell_x").agg(F.count("*").alias("grid_detection_count"), F.sum("frp").alias("grid_total_frp"))
    out = df.withColumn("year", F.year("acq_date")).join(cells, ["cell_y", "cell_x"]).join(active_days(df), ["cell_y", "cell_x", "year"])
    return out.withColumn("persistent_location_flag", flag(F.col("grid_active_days") >= DEFAULTS.persistent_days))


#: Fixed-point steps per unit: sums of whole numbers don't depend on the order of rows, so results are the same for any partitioning.
STEPS = {"brightness": 100, "frp": 1000}


def cell_statistics(df: DataFrame, columns: tuple[str, ...] = ("brightness", "frp")) -> DataFrame:
    """A5: rows of each cell (grid_obs) and per column the count, mean and sample deviation, with the exact sums behind them.

    Nulls are left out; the deviation of fewer than two values is null.
    """
    whole = {c: F.rint(F.col(c) * STEPS.get(c, 1000)).cast("long") for c in columns}
    sums = [a for c, x in whole.items() for a in (F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_s"), F.sum(x * x).alias(f"{c}_ss"))]
    out = df.groupBy("cell_y", "cell_x").agg(F.count("*").alias("grid_obs"), *sums)
    return out.withColumns({f"{c}_{k}": v for c in columns for k, v in zip(("mean", "std"), _moments(F.col(f"{c}_n"), F.col(f"{c}_s"), F.col(f"{c}_ss"), STEPS.get(c, 1000)), strict=True)})


def _moments(n: Column, s: Column, ss: Column, steps: int) -> tuple[Column, Column]:
    n, s, ss = (F.when(n > 0, x.cast("double")) for x in (n, s, ss))
    variance = (ss - s * s / n) / F.nullif(n - 1, F.lit(0.0))
    return s / n / steps, F.sqrt(F.greatest(variance, F.when(variance.isNotNull(), F.lit(0.0)))) / steps


def global_statistics(cells: DataFrame, columns: tuple[str, ...] = ("brightness", "frp")) -> DataFrame:
    """One row of all_<c>_mean and all_<c>_std, from the cells' exact sums."""
    wide = [a for c in columns for a in (F.sum(f"{c}_n").alias(f"{c}_n"), F.sum(F.col(f"{c}_s").cast("decimal(28,0)")).alias(f"{c}_s"), F.sum(F.col(f"{c}_ss").cast("decimal(28,0)")).alias(f"{c}_ss"))]
    one = cells.agg(*wide)
    return one.select(*(v.alias(f"all_{c}_{k}") for c in columns for k, v in zip(("mean", "std"), _moments(F.col(f"{c}_n"), F.col(f"{c}_s"), F.col(f"{c}_ss"), STEPS.get(c, 1000)), strict=True)))


def local_anomaly(df: DataFrame, columns: tuple[str, ...] = ("brightness", "frp"), params: Params = DEFAULTS) -> DataFrame:
    """Z-score of each row in its cell, by the whole table's mean and deviation where the cell has too few rows or no spread.

    Adds <c>_zscore_local and high_<c>_flag_local; a null value has a null score.
    """
    cells = cell_statistics(df, columns)
    whole = global_statistics(cells, columns)  # one row
    stats = cells.select("cell_y", "cell_x", "grid_obs", *(f"{c}_{k}" for c in columns for k in ("mean", "std")))
    out = df.join(stats, ["cell_y", "cell_x"]).crossJoin(F.broadcast(whole))
    for c in columns:
        z = zscore(F.col(c), F.col("grid_obs"), F.col(f"{c}_mean"), F.col(f"{c}_std"), F.col(f"all_{c}_mean"), F.col(f"all_{c}_std"), params.min_grid_obs)
        out = out.withColumn(f"{c}_zscore_local", z).withColumn(f"high_{c}_flag_local", flag(F.col(f"{c}_zscore_local") >= params.zscore_spike))
    return out.drop("grid_obs", *(f"{p}{c}_{k}" for p in ("", "all_") for c in columns for k in ("mean", "std")))


def zscore(x: Column, n: Column, mean: Column, std: Column, all_mean: Column, all_std: Column, least: int = DEFAULTS.min_grid_obs) -> Column:
    """Local if the cell has ``least`` rows and a spread; a whole-table deviation of 0 or null counts as 1."""
    spread = F.when(all_std > 0, all_std).otherwise(F.lit(1.0))
    return F.when((n >= least) & (std > 0), (x - mean) / std).otherwise((x - all_mean) / spread)


def rows_per_rounded_cell(df: DataFrame, degrees: float = 0.01) -> DataFrame:
    """Rows of each row's rounded cell as grid_count."""
    keyed = df.withColumns({"round_y": th.cell_round("latitude", degrees), "round_x": th.cell_round("longitude", degrees)})
    return keyed.join(keyed.groupBy("round_y", "round_x").agg(F.count("*").alias("grid_count")), ["round_y", "round_x"])


def sample_landcover(df: DataFrame, cells: DataFrame, degrees: float = 0.25) -> DataFrame:
    """Land-cover code and class of each row by raster cell; null code and Unknown where the raster has none."""
    keyed = df.withColumns({"_y": F.floor(F.col("latitude") / degrees), "_x": F.floor(F.col("longitude") / degrees)})
    right = cells.select(F.col("cell_y").alias("_y"), F.col("cell_x").alias("_x"), "landcover_code")
    return keyed.join(right, ["_y", "_x"], "left").withColumn("landcover_class", landcover_class("landcover_code")).drop("_y", "_x")


def attach_cached_landcover(df: DataFrame, sampled: DataFrame, key: str = "event_id") -> DataFrame:
    """A cached sample joined back by the stable event key."""
    return df.join(sampled.select(key, "landcover_code"), key, "left").withColumn("landcover_class", landcover_class("landcover_code"))


def global_zscore(df: DataFrame, column: str) -> DataFrame:
    """M4: log1p of the column and its z-score over the table (population deviation); nulls are left out."""
    logged = df.withColumn("log_value", F.log1p(column))
    whole = logged.agg(F.avg("log_value").alias("_m"), F.stddev_pop("log_value").alias("_s"))
    return logged.crossJoin(F.broadcast(whole)).withColumn("zscore", (F.col("log_value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def event_key() -> Column:
    """Stable key of a detection by its content (replaces row positions)."""
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("latitude", "longitude", "acq_date", "acq_time", "satellite_source"))), 256)


def display_id(ordinal: Column) -> Column:
    """M46."""
    return F.format_string("FIRMS_TN_%04d", ordinal)


def cell_roll_up(df: DataFrame) -> DataFrame:
    """The flagship question: persistent cells with how far their detections lie from the cell's own history."""
    celled = df.withColumns({"cell_y": th.cell_floor("latitude", DEFAULTS.grid_degrees), "cell_x": th.cell_floor("longitude", DEFAULTS.grid_degrees)})
    celled = materialize(celled.select("cell_y", "cell_x", "acq_date", "brightness", "frp"))  # read once for cells, days and scores
    days = active_days(celled).groupBy("cell_y", "cell_x").agg(F.max("grid_active_days").alias("grid_active_days"))
    scored = local_anomaly(celled, ("brightness",)).join(days, ["cell_y", "cell_x"])
    return scored.groupBy("cell_y", "cell_x").agg(F.count("*").alias("detections"), F.max("grid_active_days").alias("active_days"), F.round(F.max("brightness_zscore_local"), 6).alias("max_zscore"), F.sum("high_brightness_flag_local").alias("spikes"))


def duplicate_flags(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``df`` with is_duplicate, true for all but the first row of each key."""
    return df.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def first_seen(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key by a total order; a deterministic form of dropDuplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
