"""Resume, retry and upsert of processed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.common import flag
from emberline.functions.labels import error_category

FAILED = ("PROCESSING_API_ERROR", "AUTH_REQUIRED")


def completed_ids(manifest: DataFrame, checkpoints: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids in the manifest or in a checkpoint with a status."""
    return manifest.select(key).union(checkpoints.filter("status is not null").select(key)).distinct()


def to_process(events: DataFrame, done: DataFrame, key: str = "event_id") -> DataFrame:
    """J21."""
    return events.join(done.select(key), key, "left_anti")


def upsert(master: DataFrame, recovered: DataFrame, key: str = "event_id") -> DataFrame:
    """Columns of ``recovered`` overwrite those of ``master`` where a row with a value is there; all else stays, extra columns are ignored."""
    shared = [c for c in recovered.columns if c != key and c in master.columns]
    new = recovered.select(key, *(F.col(c).alias(f"_new_{c}") for c in shared))
    return master.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in shared else c for c in master.columns))


def retry_windows(events: DataFrame) -> DataFrame:
    """(event_id, window, reason) of events of which an observation failed for a reason that may pass."""
    bad = {t: F.coalesce(F.col(f"{t}_status").isin(*FAILED), F.lit(False)) for t in ("pre", "post")}
    window = F.when(bad["pre"] & bad["post"], "both").when(bad["pre"], "pre").when(bad["post"], "post")
    reason = F.concat_ws("; ", F.when(bad["pre"], F.concat(F.lit("pre: "), "pre_status")), F.when(bad["post"], F.concat(F.lit("post: "), "post_status")))
    return events.select("event_id", window.alias("window"), reason.alias("reason")).filter("window is not null")


def retry_counts(retries: DataFrame) -> DataFrame:
    """A29."""
    n = lambda w: F.count_if(F.col("window") == w)
    return retries.agg(n("pre").alias("pre_only"), n("post").alias("post_only"), n("both").alias("both"), (n("pre") + n("post") + 2 * n("both")).alias("windows"))


def error_signatures(df: DataFrame, columns: tuple[str, ...] = ("pre_error", "post_error"), width: int = 40) -> DataFrame:
    """How often each kind of message occurs; known kinds by a part of their text, others by their beginning."""
    m = F.explode(F.array(*columns)).alias("m")
    low = F.lower("m")
    kind: Column = F.when(low.contains("timeout"), "timeout").when(low.contains("429"), "rate limit").when(low.contains("401") | low.contains("403"), "authorization").otherwise(F.substring("m", 1, width))
    return df.select(m).filter("m is not null and m <> ''").select(kind.alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


def recovery_matrix(df: DataFrame) -> DataFrame:
    """Events by window and status, statuses as rows."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(t).alias("window"), F.col(f"{t}_status").alias("status")) for t in ("pre", "post")))).alias("x")).select("x.*")
    return rows.groupBy("status").agg(*(F.count_if(F.col("window") == t).alias(t) for t in ("pre", "post")))


def manifest(events: DataFrame) -> DataFrame:
    """Execution manifest of processed events."""
    real = (F.col("pre_status") == "REAL_CDSE_SUCCESS") | (F.col("post_status") == "REAL_CDSE_SUCCESS")
    return events.select("event_id", "processing_status", "pre_status", "post_status", flag(real).alias("is_real"), error_category("processing_status").alias("error_category"))
