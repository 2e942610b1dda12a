"""Queries against their SQL in DuckDB on the smallest tables, and plans without Cartesian products or Python."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
CHECKED = (
    "p1_p4_clean_detections p5_polygon_filter m1_m9_thermal_scalars m10_m13_calendar a3_active_days_per_year a5_cell_statistics m30_m31_local_anomaly j1_nearest_facility j4_three_nearest j11_tile_coverage j8_landcover_sample "
    "m29_facility_classes j12_j13_image_match a15_m37_scl_quality a16_a18_spectral_statistics j15_m26_change m24_m25_event_status m27_annotations j17_j18_review_merge a19_kpis p11_facet_filter p14_s18_dashboard_parse q5_q6_probability_audit "
    "a32_summary_metrics w2_global_rank p7_box_fallback p18_guarded_rows w5_duplicate_flags j24_space_time_pairs k3_best_pools m35_published_score k9_representatives k11_w6_strata_batch s8_tile_grid q1_q4_expectations hotspots t1_incremental_ingest t3_daily_cells t3_late_rows t4_stream_enrichment t6_stream_upsert j6_nearest_without_ties j16_footprints j25_spatial_duplicates w8_a9_folds k13_holdout k4_quintile_best k5_s16_extremes_per_class a11_distribution a14_distance_by_coverage l5_full_manifests"
).split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


@pytest.mark.parametrize("name", ["p5_polygon_filter", "j1_nearest_facility", "j12_j13_image_match", "m29_facility_classes", "a16_a18_spectral_statistics", "j24_space_time_pairs"])
def test_plans_stay_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "MapInPandas"))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", ["p5_polygon_filter", "p6_polygon_key_dedup", "hotspots"])
def test_generated_code_stays_small(spark, name):
    """A method beyond 64 KB of bytecode isn't compiled; Spark would fall back to interpretation."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no final plan before it runs
    try:
        code = entry.queries()[name](spark, SMALL)._jdf.queryExecution().debug().codegenToSeq()
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
        assert sizes and 0 < min(sizes) and max(sizes) < 64_000  # -1: not compiled
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
