"""Queries that run a stream to its end over the events and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import features, spatial
from emberline.operators.site_index import site_index
from emberline.plans.detection_queries import CLEAN, COVER, LAND, SEARCHED, near_sql
from emberline.plans.registry import ORACLE_SQL, QUERIES, query
from emberline.sources.fixtures import DERIVED, load, with_tables
from emberline.sources.shared import shared_folder
from emberline.streaming import pipelines


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of detections with their time."""
    path = f"{sf_dir}/events.parquet"
    stream = pipelines.detection_stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema, "parquet")  # a pattern, as a stream's path may not be a single file
    return spark.sql(DERIVED["detections"].replace("FROM events", "FROM {events}").replace("AS daynight", "AS daynight, CAST(ts AS TIMESTAMP) AS event_time"), events=stream)


def _in_files(spark: SparkSession, df: DataFrame, folder: str, part: Column, parts: range) -> None:
    """``df`` as files of a folder that come one after another, those with part 0 first."""
    for i in parts:
        df.filter(part == i).coalesce(1).write.mode("append").parquet(folder)


def _arriving(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as a stream, one a batch."""
    return pipelines.detection_stream(spark, folder, spark.read.parquet(folder).schema, "parquet", files=1)


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = _folder(spark)
    pipelines.append_to(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_query(name: str, tables: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = with_tables(tables, sql)
        return f

    return keep


@stream_query("t1_incremental_ingest", "detections", CLEAN + " SELECT event_id, latitude, frp FROM clean")
def _(spark, sf_dir):
    """Four files; the stream runs over two, is started again and takes the other two, each row once."""
    folder, rows, part = _folder(spark), load(spark, sf_dir, "detections"), F.col("event_id") % 4
    for parts in (range(2), range(2, 4)):
        _in_files(spark, rows, f"{folder}/in", part, parts)
        stream = pipelines.clean_stream(_arriving(spark, f"{folder}/in")).select("event_id", "latitude", "frp")
        pipelines.append_to(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@stream_query("t2_stream_dedup", "detections", "SELECT event_id, satellite_source FROM detections")
def _(spark, sf_dir):
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _run(spark, pipelines.deduplicated(twice, ["event_id"], delay="40 days").select("event_id", "satellite_source"))


@stream_query("t3_daily_cells", "detections", """, e AS (SELECT CAST(FLOOR(d.latitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_y, CAST(FLOOR(d.longitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_x, d.acq_date AS day FROM detections d)
  SELECT day, cell_y, cell_x, COUNT(*) AS detections FROM e WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT MAX(ts) - INTERVAL 2 DAY FROM events) GROUP BY day, cell_y, cell_x""")  # fmt: skip
def _(spark, sf_dir):
    return _run(spark, pipelines.daily_cells(_events(spark, sf_dir))).select("day", "cell_y", "cell_x", "detections")


@stream_query("t3_late_rows", "detections", """, e AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) AS batch_id, ts FROM events),
  m AS (SELECT batch_id, (SELECT MAX(x.ts) FROM e x WHERE x.batch_id < b.batch_id) AS newest FROM (SELECT DISTINCT batch_id FROM e) b)
  SELECT e.event_id, e.batch_id, COALESCE(e.ts < m.newest - INTERVAL 10 DAY, FALSE) AS late FROM e JOIN m ON e.batch_id = m.batch_id""")  # fmt: skip
def _(spark, sf_dir):
    """Three batches, a restart before the last; rows ten days behind all earlier batches are late."""
    folder, part = _folder(spark), F.col("event_id") % 3
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("event_time"))
    for parts in (range(2), range(2, 3)):
        _in_files(spark, rows, f"{folder}/in", part, parts)
        pipelines.split_late(_arriving(spark, f"{folder}/in"), f"{folder}/good", f"{folder}/late", f"{folder}/marks", f"{folder}/checkpoint", delay="10 days").awaitTermination()
    good, late = (spark.read.parquet(f"{folder}/{n}").select("event_id", F.col("batch_id").cast("int").alias("batch_id"), F.lit(n == "late").alias("late")) for n in ("good", "late"))
    return good.union(late)


@stream_query("t4_stream_enrichment", "detections facilities landcover_cells tiles", CLEAN + COVER + LAND + near_sql() + """ SELECT l.event_id, l.landcover_class, c.coverage, n.osm_type AS nearest_osm_type, n.osm_id AS nearest_osm_id, n.distance_m AS distance_to_facility_m
  FROM landed l JOIN covered c ON l.event_id = c.event_id LEFT JOIN near n ON l.event_id = n.event_id""")  # fmt: skip
def _(spark, sf_dir):
    cells, tiles = load(spark, sf_dir, "landcover_cells"), load(spark, sf_dir, "tiles")
    index = site_index(load(spark, sf_dir, "facilities"))
    joins = [lambda s: features.sample_landcover(s, cells), lambda s: spatial.tile_coverage(s, tiles), lambda s: pipelines.with_nearest(s, index)]
    stream = pipelines.enriched(pipelines.clean_stream(_events(spark, sf_dir)), joins)
    return _run(spark, stream.select("event_id", "landcover_class", "coverage", "nearest_osm_type", "nearest_osm_id", "distance_to_facility_m"))


def _scoring(spark, sf_dir):
    """T5: the forest of L3, fitted in batch, scores the stream, which is dealt over all cores, ``SEARCHED`` rows a task, as its scan has few partitions."""
    from emberline.operators import ml
    from emberline.plans.learning_queries import CATEGORICAL, NUMERIC, cohort

    fitted = ml.fit(cohort(lambda t: load(spark, sf_dir, t)), NUMERIC, CATEGORICAL, "target_class")
    parts = max(spark.sparkContext.defaultParallelism, -(-load(spark, sf_dir, "events").count() // SEARCHED))
    rows = features.thermal_features(features.temporal_features(_events(spark, sf_dir).repartition(parts)))
    return _run(spark, pipelines.scored(rows, fitted, NUMERIC, ["event_id"]))


QUERIES["t5_stream_scoring"] = _scoring


@stream_query("t6_stream_upsert", "detections", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'DONE' ELSE 'NEW' END AS status, frp FROM detections")
def _(spark, sf_dir):
    """Three batches of finished events, a restart before the last, and the first batch's rows again."""
    folder = _folder(spark)
    rows = load(spark, sf_dir, "detections")
    master = pipelines.Master(f"{folder}/master", buckets=16).create(rows.select("event_id", F.lit("NEW").alias("status"), "frp"))
    fresh = rows.filter("event_id % 4 = 0").select("event_id", F.lit("DONE").alias("status"))
    for parts in (range(2), range(2, 4)):
        _in_files(spark, fresh, f"{folder}/in", F.col("event_id") % 12 / 4, parts)
        if parts.start:
            _in_files(spark, fresh, f"{folder}/in", F.col("event_id") % 12 / 4, range(1))
        pipelines.upsert_to(_arriving(spark, f"{folder}/in"), master, f"{folder}/checkpoint").awaitTermination()
    return master.read(spark)


@query("t3_yearly_activity", "detections", "SELECT CAST(FLOOR(latitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_y, CAST(FLOOR(longitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_x, CAST(EXTRACT(YEAR FROM acq_date) AS INTEGER) AS year, COUNT(DISTINCT acq_date) AS grid_active_days, COUNT(*) AS detections FROM detections GROUP BY 1, 2, 3")
def _(t):
    from emberline.functions.thermal import cell_floor

    daily = t("detections").groupBy(F.col("acq_date").alias("day"), cell_floor("latitude").alias("cell_y"), cell_floor("longitude").alias("cell_x")).agg(F.count("*").alias("detections"))
    return pipelines.yearly_activity(daily)
