"""Structured Streaming forms of ingest, dedup, cell activity, enrichment, scoring and upsert."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberline.functions.thermal import cell_floor
from emberline.operators.ml import score
from emberline.operators.quality import clean_detections
from emberline.operators.recovery import upsert
from emberline.operators.site_index import SiteIndex
from emberline.sources.shared import materialize


def detection_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "csv", files: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)


def clean_stream(stream: DataFrame) -> DataFrame:
    """The row rules of the batch scan; they keep no state."""
    return clean_detections(stream, distinct=False)


def deduplicated(stream: DataFrame, keys: list[str], event_time: str = "event_time", delay: str = "2 days") -> DataFrame:
    """The first of equal keys within the watermark; state is dropped behind it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def daily_cells(stream: DataFrame, event_time: str = "event_time", delay: str = "2 days") -> DataFrame:
    """Detections and power of each cell and day, appended once the day is behind the watermark."""
    keyed = stream.withColumns({"cell_y": cell_floor("latitude"), "cell_x": cell_floor("longitude")}).withWatermark(event_time, delay)
    out = keyed.groupBy(F.window(event_time, "1 day").alias("w"), "cell_y", "cell_x").agg(F.count("*").alias("detections"), F.sum("frp").alias("total_frp"))
    return out.select(F.to_date("w.start").alias("day"), "cell_y", "cell_x", "detections", "total_frp")


def yearly_activity(daily: DataFrame) -> DataFrame:
    """Active days per cell and year from the daily table, in batch."""
    return daily.groupBy("cell_y", "cell_x", F.year("day").alias("year")).agg(F.countDistinct("day").alias("grid_active_days"), F.sum("detections").alias("detections"))


def enriched(stream: DataFrame, joins: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """T4: stream-static joins in turn, such as the land-cover sample, tile coverage or nearest facility with their tables bound; none keeps state."""
    for join in joins:
        stream = join(stream)
    return stream


def with_nearest(stream: DataFrame, index: SiteIndex, prefix: str = "nearest", distance: str = "distance_to_facility_m") -> DataFrame:
    """The nearest site of an index that was built before the stream began; nulls where there is none."""
    out = index.look_up(stream, result="_near").withColumn("_near", F.get("_near", 0))
    return out.withColumns({distance: F.col("_near.distance_m"), **{f"{prefix}_{c}": F.col(f"_near.{c}") for c in index.keep}}).drop("_near")


def scored(stream: DataFrame, model: PipelineModel, numeric: list[str], keep: list[str]) -> DataFrame:
    """T5: class, probabilities and tier of each row by a model that was fitted in batch."""
    return score(stream, model, numeric, keep)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once, as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path`` if there is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing was written yet
        return None


@dataclass(frozen=True)
class Master:
    """A table in ``buckets`` parts by a hash of its key, under one folder.

    ``data/v=<n>/bucket=<b>`` holds the rows of part b as batch n left them; ``manifest/v=<n>`` names the version of every part.  A manifest is one file, which appears whole and last, so
    readers see a batch in full or not at all, and parts that a batch doesn't touch keep their files.
    """

    path: str
    key: str = "event_id"
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession) -> DataFrame | None:
        """(bucket, v) of the last whole batch."""
        found = _present(spark, f"{self.path}/manifest")
        if found is None:
            return None
        last = found.agg(F.max("batch")).first()[0]
        return found.filter(F.col("batch") == last).select("batch", "bucket", F.col("version").alias("v"))

    def create(self, rows: DataFrame) -> Master:
        """Writes ``rows`` as version -1."""
        spark = rows.sparkSession
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v=-1")
        first = spark.range(self.buckets).select(F.lit(-1).cast("long").alias("batch"), F.col("id").cast("int").alias("bucket"), F.lit(-1).cast("int").alias("version"))
        first.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch_no=-1")
        return self

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of the last whole batch, of all parts or some; the manifest has a row for each part and prunes the files."""
        rows = spark.read.parquet(f"{self.path}/data")
        rows = rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))
        return rows.join(F.broadcast(self._manifest(spark).select("bucket", "v")), ["bucket", "v"]).drop("bucket", "v")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Overwrites the columns that ``batch`` has on the rows it names (J22); of rows with one key the last value of each column counts.  A batch that is in a manifest already changes nothing."""
        spark = batch.sparkSession
        old = self._manifest(spark)
        if old.first()["batch"] >= number:
            return
        new = batch.groupBy(self.key).agg(*(F.last(c, ignorenulls=True).alias(c) for c in batch.columns if c != self.key))
        new = materialize(new)
        touched = sorted(r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect())
        if touched:
            rows = upsert(self.read(spark, touched), new, self.key).withColumn("bucket", self._bucket())
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        found = _present(spark, f"{self.path}/data/v={number}") if touched else None  # no file if the batch names no row of the master
        written = [] if found is None else [r["bucket"] for r in found.select("bucket").distinct().collect()]
        version = F.when(F.col("bucket").isin(written), F.lit(number)).otherwise(F.col("v"))
        following = old.select(F.lit(number).cast("long").alias("batch"), "bucket", version.cast("int").alias("version"))
        following.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch_no={number}")


def upsert_to(stream: DataFrame, master: Master, checkpoint: str) -> StreamingQuery:
    """Each batch is applied to the parts of the master that it touches, once even if it comes again after a failure."""
    return stream.writeStream.foreachBatch(master.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, good: str, late: str, marks: str, checkpoint: str, event_time: str = "event_time", delay: str = "2 days") -> StreamingQuery:
    """Rows more than ``delay`` behind the newest row of all earlier batches go to ``late``, others to ``good``; rows without a time are good.

    As with a watermark, a batch is measured against what came before it, so the first has no late rows.  The newest time so far is kept in ``marks`` with the batch it stands
    for; each batch writes its own folders ``batch_id=<n>``, so one that comes again after a failure replaces what it wrote.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = _present(spark, marks)
        newest = None if seen is None else seen.filter(F.col("batch_id") < number).agg(F.max("newest")).first()[0]
        rows = materialize(batch)
        old = F.coalesce(F.col(event_time) < F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}"), F.lit(False))
        rows.filter(old).write.mode("overwrite").parquet(f"{late}/batch_id={number}")
        rows.filter(~old).write.mode("overwrite").parquet(f"{good}/batch_id={number}")
        mark = rows.agg(F.greatest(F.max(event_time), F.lit(newest).cast("timestamp")).alias("newest"))
        mark.write.mode("overwrite").parquet(f"{marks}/batch_id={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
