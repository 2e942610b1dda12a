"""Streams over several batches and restarts: late rows, bucketed upserts, nearest facilities."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from emberline.operators.site_index import site_index
from emberline.streaming import pipelines


def arriving(spark, folder):
    return pipelines.detection_stream(spark, folder, spark.read.parquet(folder).schema, "parquet", files=1)


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def times(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(*t) if t else None) for i, t in rows], "event_id long, event_time timestamp")


def test_late_rows_are_measured_against_earlier_batches(spark, tmp_path):
    box = f"file://{tmp_path}"

    def run():
        pipelines.split_late(arriving(spark, f"{box}/in"), f"{box}/good", f"{box}/late", f"{box}/marks", f"{box}/check").awaitTermination()

    put(times(spark, [(1, (2024, 1, 10)), (2, (2023, 1, 1)), (3, None)]), f"{box}/in")  # nothing came before them
    put(times(spark, [(4, (2023, 1, 1)), (5, (2024, 1, 8)), (6, (2024, 1, 7, 23))]), f"{box}/in")
    run()
    put(times(spark, [(7, (2024, 1, 9)), (8, (2023, 12, 31)), (9, (2024, 2, 1))]), f"{box}/in")
    put(times(spark, [(10, (2024, 1, 29))]), f"{box}/in")
    run()  # a restart keeps the newest time
    assert {r.event_id for r in spark.read.parquet(f"{box}/late").collect()} == {4, 6, 8, 10}
    assert {r.event_id for r in spark.read.parquet(f"{box}/good").collect()} == {1, 2, 3, 5, 7, 9}


def test_master_rewrites_touched_parts_only(spark, tmp_path):
    master = pipelines.Master(f"file://{tmp_path}/m", buckets=4)
    master.create(spark.range(40).select(F.col("id").alias("event_id"), F.lit("NEW").alias("status"), (F.col("id") * 2).alias("frp")))

    def state():
        return {r.event_id: (r.status, r.frp) for r in master.read(spark).collect()}

    def files():
        return {(p, os.path.getmtime(p)) for p in glob.glob(f"{tmp_path}/m/data/**/*.parquet", recursive=True)}

    def versions():
        return {r.bucket: r.v for r in master._manifest(spark).collect()}

    before, old, want = files(), versions(), state()
    master.apply(spark.createDataFrame([(3, "A"), (3, "B"), (99, "X")], "event_id long, status string").coalesce(1), 0)
    want[3] = ("B", 6)
    assert state() == want and before <= files()
    assert sum(versions()[b] != v for b, v in old.items()) == 1  # one part has a new version
    after = files()
    master.apply(spark.createDataFrame([(3, "AGAIN")], "event_id long, status string"), 0)  # the batch comes again after its manifest was written
    assert state() == want and files() == after
    batch = spark.createDataFrame([(5, "C"), (7, None)], "event_id long, status string")
    spark.createDataFrame([(5, "HALF", 1)], "event_id long, status string, frp long").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{master.path}/data/v=1")  # killed before its manifest
    assert state() == want
    master.apply(batch, 1)
    want[5] = ("C", 10)
    assert state() == want
    master.apply(spark.createDataFrame([(500, "no row of the master")], "event_id long, status string"), 2)
    assert state() == want


def test_upserts_over_three_batches_and_a_restart(spark, tmp_path):
    box = f"file://{tmp_path}"
    master = pipelines.Master(f"{box}/m", buckets=3).create(spark.range(12).select(F.col("id").alias("event_id"), F.lit(0).alias("n")))
    for n in (1, 2):
        put(spark.createDataFrame([(n, n), (5, n)], "event_id long, n int"), f"{box}/in")
    pipelines.upsert_to(arriving(spark, f"{box}/in"), master, f"{box}/check").awaitTermination()
    put(spark.createDataFrame([(5, 9), (7, 9)], "event_id long, n int"), f"{box}/in")
    pipelines.upsert_to(arriving(spark, f"{box}/in"), master, f"{box}/check").awaitTermination()
    assert {r.event_id: r.n for r in master.read(spark).collect()} == {i: {1: 1, 2: 2, 5: 9, 7: 9}.get(i, 0) for i in range(12)}


def test_nearest_on_a_stream(spark, tmp_path):
    box = f"file://{tmp_path}"
    sites = spark.createDataFrame([("node", 1, 10.0, 77.0), ("way", 2, 12.0, 79.0)], "osm_type string, osm_id long, latitude double, longitude double")
    put(spark.createDataFrame([(1, 10.1, 77.0), (2, 50.0, -100.0), (3, None, 1.0)], "event_id long, latitude double, longitude double"), f"{box}/in")
    stream = pipelines.with_nearest(arriving(spark, f"{box}/in"), site_index(sites))
    assert stream.isStreaming
    pipelines.append_to(stream, f"{box}/out", f"{box}/check").awaitTermination()
    got = {r.event_id: r for r in spark.read.parquet(f"{box}/out").collect()}
    assert got[1].nearest_osm_id == 1 and got[1].distance_to_facility_m == pytest.approx(11_120, abs=20) and got[2].nearest_osm_id == 2 and got[3].nearest_osm_id is None
