"""Serving tables: predictions on the master, facet filter, KPIs, lookups, review labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.labels import normalize_annotation


@dataclass(frozen=True)
class Facets:
    """An empty list means any value; no ceiling on power unless one is given."""

    lists: dict[str, tuple[str, ...]] = field(default_factory=dict)
    only_persistent: bool = False
    frp_min: float = 0.0
    frp_max: float = float("inf")


def facet_filter(events: DataFrame, facets: Facets) -> DataFrame:
    """Rows that meet every facet; an unknown power passes the range."""
    for column, values in facets.lists.items():
        if values:
            events = events.filter(F.col(column).isin(*values))
    if facets.only_persistent:
        events = events.filter("persistent_location_flag = 1")
    outside = (F.col("frp") < facets.frp_min) | (F.col("frp") > facets.frp_max)
    return events.filter(~F.coalesce(outside, F.lit(False)))


def kpis(events: DataFrame) -> DataFrame:
    """One row, zeros on empty input; an unknown power counts as 0 in the mean."""
    is_ = lambda c: F.count_if(F.col("predicted_class") == c)
    return events.agg(
        F.count("*").alias("total"), is_("Agricultural Burning").alias("agricultural"), is_("Industrial Thermal Activity").alias("industrial"), is_("Natural / Wildfire / Other").alias("natural"),
        F.count_if(F.col("ml_confidence") == "HIGH").alias("high_confidence"), F.coalesce(F.round(F.sum(F.coalesce("frp", F.lit(0.0))) / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(0.0)).alias("avg_frp"),
    )


def with_predictions(master: DataFrame, predictions: DataFrame, key: str = "event_id") -> DataFrame:
    """Every master row, predictions where there are some; columns that both have come from the predictions."""
    drop = [c for c in predictions.columns if c != key and c in master.columns]
    return master.drop(*drop).join(predictions, key, "left")


def with_review(master: DataFrame, review: DataFrame, key: str = "event_id", raw: str = "raw_label") -> DataFrame:
    """reviewers' labels on the master, normalised; rows without one are UNREVIEWED, and only unambiguous labels are eligible for training."""
    r = review.withColumn("_l", normalize_annotation(raw)).select(key, F.col(raw).alias("raw_label"), F.col("_l.label").alias("reviewed_class"), F.col("_l.unambiguous").alias("_u"))
    out = master.join(r, key, "left")
    return out.withColumns({
        "has_review": F.col("reviewed_class").isNotNull(), "review_status": F.when(F.col("reviewed_class").isNull(), "UNREVIEWED").when(F.col("_u"), "REVIEWED").otherwise("REVIEW_REQUIRED"),
        "ml_training_eligible": F.coalesce("_u", F.lit(False)),
    }).drop("_u")


def training_cohort(reviewed: DataFrame) -> DataFrame:
    """L16, P19."""
    return reviewed.filter("ml_training_eligible")


def parity(old: DataFrame, new: DataFrame, key: str = "event_id", column: str = "predicted_class") -> DataFrame:
    """Compared rows, differing rows and their rate."""
    j = old.select(key, F.col(column).alias("_a")).join(new.select(key, F.col(column).alias("_b")), key)
    return j.agg(F.count("*").alias("compared"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing")).withColumn("rate", F.coalesce(F.round(F.col("differing") / F.nullif(F.col("compared"), F.lit(0)), 6), F.lit(0.0)))


def lookup(features: DataFrame, ids: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted ids, and the ids that are unknown."""
    wanted = ids.select(key).distinct()
    return features.join(wanted, key, "left_semi"), wanted.join(features, key, "left_anti")


def provenance(df: DataFrame, renames: dict[str, str], constants: dict[str, str], leaked: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed, constant columns added, leaking columns dropped."""
    return df.drop(*leaked).withColumnsRenamed(renames).withColumns({k: F.lit(v) for k, v in constants.items()})
