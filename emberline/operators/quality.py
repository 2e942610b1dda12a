"""Row checks, typed parsing and expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.common import finite, number
from emberline.params import DEFAULTS, Params

CLASSES = ("Agricultural Burning", "Industrial Thermal Activity", "Natural / Wildfire / Other")
REQUIRED = ("latitude", "longitude", "brightness", "frp", "acq_date")
NUMERIC = ("latitude", "longitude", "brightness", "bright_t31", "frp", "scan", "track")


def require_columns(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The table itself, or an error that names what is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """The table itself, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order, or an error."""
    return require_columns(df, tuple(columns)).select(*columns)


def coordinate_problem(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Why a row's coordinates can't be used; null if they can."""
    y, x = F.col(lat), F.col(lon)
    return F.when(y.isNull() | x.isNull(), "missing").when(~y.between(-90, 90), "latitude out of range").when(~x.between(-180, 180), "longitude out of range")


def clean_detections(df: DataFrame, params: Params = DEFAULTS, distinct: bool = True) -> DataFrame:
    """Numbers coerced, rows without key values or with impossible coordinates dropped, cut to the region's box, whole-row duplicates removed."""
    df = require_columns(df)
    kinds = dict(df.dtypes)
    real = lambda c: kinds[c] in ("double", "float")
    value = lambda c: F.col(c) if real(c) else number(c)
    here = value("latitude").between(max(params.bbox_south, -90.0), min(params.bbox_north, 90.0)) & value("longitude").between(max(params.bbox_west, -180.0), min(params.bbox_east, 180.0))
    # Nulls and NaN, which is above infinity, fail these tests.  Each column is named as seldom as can be: Spark puts what derives it in each place, and a test that grows too long isn't compiled.
    df = df.filter(here & (value("brightness") <= float("inf")) & (value("frp") <= float("inf")) & F.col("acq_date").isNotNull())
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c).cast("double")) if real(c) else number(c) for c in NUMERIC if c in kinds})
    return df.distinct() if distinct else df


def ingestion_funnel(df: DataFrame, params: Params = DEFAULTS, by: str = "satellite_source") -> DataFrame:
    """A10: rows that pass each step, by sensor, in one pass."""
    y, x = F.col("latitude"), F.col("longitude")
    valid = F.coalesce(y.between(-90, 90) & x.between(-180, 180), F.lit(False))
    inside = valid & y.between(params.bbox_south, params.bbox_north) & x.between(params.bbox_west, params.bbox_east)
    whole = inside & F.col("brightness").isNotNull() & F.col("frp").isNotNull()
    return df.groupBy(by).agg(F.count("*").alias("source_rows"), F.count_if(valid).alias("valid_coordinates"), F.count_if(inside).alias("in_box"), F.count_if(whole).alias("complete"))


def without_infinities(df: DataFrame) -> DataFrame:
    """Infinities and NaN of all floating columns to null."""
    return df.withColumns({c: finite(c) for c, t in df.dtypes if t in ("double", "float")})


def nullable_text(c: str) -> Column:
    """P14: '', null, nan and none in any case mean null."""
    x = F.trim(F.col(c))
    return F.when(~F.lower(x).isin("", "null", "nan", "none"), x)


def nullable_number(c: str) -> Column:
    """P14: '', N/A and null mean null, as does what isn't a number."""
    return number(F.trim(F.col(c)))


def as_bool(c: str) -> Column:
    """P14."""
    return F.coalesce(F.lower(F.trim(F.col(c))).isin("true", "1", "yes"), F.lit(False))


def parse_dashboard(raw: DataFrame) -> DataFrame:
    """Text rows to typed columns with defaults; reject_reason says why a row can't be used, null if it can."""
    lat, lon, frp = nullable_number("latitude"), nullable_number("longitude"), nullable_number("frp")
    key = F.trim(F.coalesce("event_id", F.lit("")))
    reason = (
        F.when(key == "", "missing event_id").when(lat.isNull() | lon.isNull(), "invalid coordinates").when(~lat.between(8.0, 14.0) | ~lon.between(76.0, 81.5), "coordinates out of bounds")
        .when(~F.coalesce(F.col("predicted_class").isin(*CLASSES), F.lit(False)), "invalid predicted_class").when(frp.isNull(), "missing frp")
    )
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return raw.select(
        key.alias("event_id"), lat.alias("latitude"), lon.alias("longitude"), frp.alias("frp"), F.col("predicted_class"), text("firms_confidence", "n").alias("firms_confidence"),
        text("ml_confidence", "MEDIUM").alias("ml_confidence"), text("landcover_class", "Unknown").alias("landcover_class"), text("nearest_facility_tier", "GENERAL_CONTEXT").alias("nearest_facility_tier"),
        nullable_text("nearest_facility_name").alias("nearest_facility_name"), F.coalesce(nullable_number("persistent_location_flag"), F.lit(0.0)).cast("int").alias("persistent_location_flag"),
        as_bool("has_human_validation").alias("has_human_validation"), nullable_number("s2_dnbr_mean").alias("s2_dnbr_mean"), reason.alias("reject_reason"),
    )


def invalid_fields(df: DataFrame, numbers: list[str], integers: list[str], sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` with invalid_fields, the names of columns whose text isn't a number, a whole number or in its set; nulls are invalid."""
    bad = [(c, number(c).isNull()) for c in numbers] + [(c, F.coalesce(number(c) != F.floor(number(c)), F.lit(True))) for c in integers]
    bad += [(c, ~F.coalesce(F.col(c).isin(*v), F.lit(False))) for c, v in sets.items()]
    return df.withColumn("invalid_fields", F.filter(F.array(*(F.when(b, F.lit(c)) for c, b in bad)), lambda x: x.isNotNull()))


def expectations(df: DataFrame, key: str, rows: int | None = None, critical: tuple[str, ...] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """Q1, Q4, Q10: (name, observed, expected, passed) of row count, unique key, nulls in critical columns and counts that must be 0, in one pass."""
    checks = [("row_count", F.count("*"), rows)] if rows is not None else []
    checks += [("duplicate_keys", F.count(key) - F.count_distinct(key), 0), ("missing_keys", F.count_if(F.col(key).isNull()), 0)]
    checks += [(f"null_{c}", F.count_if(F.col(c).isNull()), 0) for c in critical] + [(n, F.count_if(c), 0) for n, c in (extra or {}).items()]
    one = df.agg(*(c.cast("long").alias(n) for n, c, _ in checks))
    out = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("observed"), F.lit(e).cast("long").alias("expected")) for n, _, e in checks))).alias("x")).select("x.*")
    return out.withColumn("passed", F.col("observed") == F.col("expected"))


def id_differences(left: DataFrame, right: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids that one side only has; empty if both hold the same."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left only")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right only")))


def preserved_fields(left: DataFrame, right: DataFrame, key: str, columns: list[str], eps: float = 1e-9) -> DataFrame:
    """Q3, Q7: (field, compared, differing, largest) of columns that both sides should hold alike."""
    a, b = (d.select(F.col(key).alias("k"), *(F.col(c).alias(f"{p}_{c}") for c in columns)) for p, d in (("l", left), ("r", right)))
    numeric = {c for c, t in left.dtypes if t in ("double", "float", "int", "bigint")}
    out = []
    for c in columns:
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        gap = F.abs(x - y) if c in numeric else F.lit(None).cast("double")
        differs = (F.coalesce(gap > eps, x.isNull() != y.isNull())) if c in numeric else ~x.eqNullSafe(y)
        out.append(F.struct(F.lit(c).alias("field"), F.count("*").alias("compared"), F.count_if(differs).alias("differing"), F.max(gap.cast("double")).alias("largest")))
    return a.join(b, "k").agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def probability_audit(df: DataFrame, columns: list[str], label: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Q5, Q6: nulls, values out of range, rows that don't sum to 1 within 0.001, and rows whose class isn't the largest (the first of equals)."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns))
    aggs = [F.count("*").alias("rows"), F.count_if(F.abs(total - 1) > 0.001).alias("bad_sums")]
    aggs += [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"{c}_out_of_range"), F.round(F.min(c), 9).alias(f"{c}_min"), F.round(F.max(c), 9).alias(f"{c}_max"))]
    if label:
        top = F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(F.array(*columns), F.greatest(*columns)).cast("int"))
        aggs.append(F.count_if(~F.col(label).eqNullSafe(top)).alias("argmax_mismatches"))
    return df.agg(*aggs)


def fingerprint(df: DataFrame) -> DataFrame:
    """Q9: row count and an order-insensitive hash of the content."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("hash"))


def binary_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q11: (field, other_values) of columns that should hold 0 and 1 only."""
    one = df.agg(*(F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("other_values")) for c in columns))).alias("x")).select("x.*")
