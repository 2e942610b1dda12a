"""Profiles and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.ranks import exact_quantiles, same_keys
from emberline.sources.shared import materialize

from emberline.functions.common import flag


def frequencies(df: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """Count and share of each value, nulls included."""
    c = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(c.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(name, "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``values`` of one column by another, in one pass."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(str(v)) for v in values))


def distribution(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Minimum, quartile-like points, mean, maximum and missing values; percentiles are exact and interpolated."""
    by = by or []
    out = df.groupBy(*by).agg(F.count(column).alias("n"), F.count_if(F.col(column).isNull()).alias("missing"), F.min(column).alias("lowest"), F.max(column).alias("highest"), F.avg(column).alias("mean"))
    q = exact_quantiles(df, column, [0.5, 0.75, 0.9], by, "_q")
    out = out.join(q, same_keys(out, q, by), "left").select(out["*"], "_q")
    return out.withColumns({n: F.round(F.col("_q")[i], 6) for i, n in enumerate(("median", "p75", "p90"))}).withColumn("mean", F.round("mean", 6)).drop("_q")


def by_coverage(df: DataFrame, coverage: str = "coverage", distance: str = "distance_m") -> DataFrame:
    """Median distance and shares within 2 and 5 km by coverage status."""
    share = lambda r: F.round(100.0 * F.count_if(F.col(distance) <= r) / F.count("*"), 4)
    df = materialize(df.select(coverage, distance))  # read twice
    out = df.groupBy(coverage).agg(F.count("*").alias("n"), share(2000).alias("pct_2km"), share(5000).alias("pct_5km"))
    q = exact_quantiles(df, distance, [0.5], [coverage], "_q")
    return out.join(q, same_keys(out, q, [coverage]), "left").select(out["*"], F.round(F.col("_q")[0], 3).alias("median_m"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls of each column, count and share, from one aggregation."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in columns)))
    return one.select("_rows", rows.alias("x")).select("x.*", F.coalesce(F.round(100.0 * F.col("x.nulls") / F.nullif(F.col("_rows"), F.lit(0)), 4), F.lit(0.0)).alias("pct"))


def dataset_profile(df: DataFrame, key: str = "event_id", flags: dict[str, Column] | None = None) -> DataFrame:
    """Rows, distinct, duplicate and missing ids, and rows that meet each further condition."""
    extra = [F.count_if(c).alias(n) for n, c in (flags or {}).items()]
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_ids"), (F.count(key) - F.countDistinct(key)).alias("duplicate_ids"), F.count_if(F.col(key).isNull()).alias("missing_ids"), *extra)


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Largest class over smallest."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"))


def region_band(lat: str = "latitude") -> Column:
    """North from 12 degrees, central from 10.5, else south."""
    return F.when(F.col(lat) >= 12, "north").when(F.col(lat) >= 10.5, "central").otherwise("south")


def region_counts(df: DataFrame) -> DataFrame:
    """Events by band, inland or not, and month."""
    return df.groupBy(region_band().alias("band"), flag(F.col("longitude") < 78.5).alias("inland"), F.date_format("acq_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def band_shares(population: DataFrame, batch: DataFrame, band: Column, name: str = "band") -> DataFrame:
    """Share of each band or category in a population and a batch, with the difference; bands of one side only count 0 on the other."""
    a, b = (frequencies(d, band, name) for d in (population, batch))
    a, b = a.select(name, F.col("pct").alias("population_pct")), b.select(name, F.col("pct").alias("batch_pct"))
    joined = a.join(b, name, "full").select(name, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("population_pct", "batch_pct")))
    return joined.withColumn("difference", F.round(F.col("batch_pct") - F.col("population_pct"), 4))


def frp_band(frp: str = "frp") -> Column:
    return F.when(F.col(frp) < 1, "below 1").when(F.col(frp) < 2.5, "1 to 2.5").when(F.col(frp) < 5, "2.5 to 5").when(F.col(frp) < 10, "5 to 10").when(F.col(frp) >= 10, "10 and more").otherwise("unknown")


def months_and_light(df: DataFrame) -> DataFrame:
    """Detections by year, month and day or night."""
    return df.groupBy(F.year("acq_date").alias("year"), F.month("acq_date").alias("month"), "daynight").agg(F.count("*").alias("n"))


def persistence_census(df: DataFrame, days: int = 3) -> DataFrame:
    """Events and cells with at least ``days`` active days, and the highest value; expects cell_y, cell_x, grid_active_days."""
    lasting = F.col("grid_active_days") >= days
    return df.agg(F.count_if(lasting).alias("events"), F.count_distinct(F.when(lasting, F.struct("cell_y", "cell_x"))).alias("cells"), F.max("grid_active_days").alias("most_days"))


def tiles(df: DataFrame, tile: Column) -> DataFrame:
    """Distinct tiles with their rows."""
    return df.groupBy(tile.alias("tile")).agg(F.count("*").alias("n"))


def nearby_categories(df: DataFrame, category: str, distance: str, most: float = 5000.0) -> DataFrame:
    """Categories of the nearest facility among rows within ``most`` metres."""
    return frequencies(df.filter(F.col(distance) <= most), category)


def marginal_gain(counts: DataFrame, threshold: str, n: str) -> DataFrame:
    """Gain of each threshold over the one before; one row per threshold."""
    return counts.withColumn("gain", F.col(n) - F.lag(n, 1, 0).over(Window.orderBy(threshold)))
