"""Golden rows, rule chains and properties of the thermal-event operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import geo, thermal
from emberline.functions import labels as lb
from emberline.operators import evidence, features, quality, recovery, serve, spatial

D = dt.date


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "code"), [("h", 2.0), ("N ", 1.0), ("l", 0.0), ("85", 85.0), ("invalid", 1.0), ("NaN", 1.0), (None, 1.0)])
def test_confidence(spark, text, code):
    assert one(spark, thermal.encode_confidence(F.lit(text).cast("string"))) == code


def test_thermal_golden_values(spark):
    assert one(spark, thermal.brightness_difference(F.lit(330.0), F.lit(300.0))) == 30
    assert one(spark, thermal.frp_ratio(F.lit(10.0), F.lit(320.0))) == 10 / 320
    assert one(spark, thermal.frp_ratio(F.lit(10.0), F.lit(0.0))) is None
    assert one(spark, thermal.log_frp(F.lit(9.0))) == pytest.approx(math.log(10))
    assert one(spark, thermal.log_frp(F.lit(None).cast("double"))) is None


def test_tiles_and_distance(spark):
    assert one(spark, geo.tile_name(F.lit(11.2), F.lit(78.5))) == "N09E078"
    assert one(spark, geo.tile_name(F.lit(-5.0), F.lit(-40.0))) == "S06W042"
    assert one(spark, geo.haversine_m(F.lit(10.0), F.lit(78.0), F.lit(10.0), F.lit(78.0))) == 0


def test_active_days_count_per_year(spark):
    rows = [(1, 1, D(y, 1, 1)) for y in (2020, 2022, 2024)]
    got = features.active_days(spark.createDataFrame(rows, "cell_y long, cell_x long, acq_date date")).collect()
    assert sorted((r.year, r.grid_active_days) for r in got) == [(2020, 1), (2022, 1), (2024, 1)]


def test_small_cells_use_the_whole_table(spark):
    rows = [(0, 0, 300.0 + i, 1.0) for i in range(6)] + [(1, 1, 400.0, 1.0), (1, 1, None, None)]
    got = features.local_anomaly(spark.createDataFrame(rows, "cell_y long, cell_x long, brightness double, frp double")).collect()
    alone = next(r for r in got if r.brightness == 400.0)
    values = [300.0 + i for i in range(6)] + [400.0]
    mean = sum(values) / 7
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / 6)
    assert alone.brightness_zscore_local == pytest.approx((400 - mean) / std) and alone.high_brightness_flag_local == 1
    assert next(r for r in got if r.brightness is None).brightness_zscore_local is None


@pytest.mark.parametrize(("d", "days", "hot", "lc", "forest", "stubble", "label"), [
    (500.0, 5, False, "Built-up", 0, 0, "Persistent Thermal Source"), (500.0, 1, True, "Built-up", 0, 0, "Industrial Fire"), (None, 1, False, "Tree cover", 1, 0, "Forest Fire"),
    (9e3, 1, False, "Cropland", 0, 1, "Agricultural Burning"), (9e3, 5, False, "Cropland", 0, 1, "Other/Unclassified"), (500.0, 5, False, None, 0, 0, "Persistent Thermal Source"),
    (500.0, 1, True, "Unknown", 0, 0, "Industrial Fire"), (9e3, 1, True, "Unknown", 1, 0, "Possible Forest Fire"), (9e3, 1, False, "Unknown", 0, 1, "Possible Agricultural Burning"), (9e3, 9, False, "Unknown", 0, 0, "Other/Unclassified"),
])
def test_weak_labels(spark, d, days, hot, lc, forest, stubble, label):
    assert one(spark, lb.weak_label(F.lit(d).cast("double"), F.lit(days), F.lit(hot), F.lit(lc).cast("string"), F.lit(forest), F.lit(stubble))) == label


def test_facility_rules_first_match_wins(spark):
    for category, tier, kind, tags, names in lb.FACILITY_RULES:
        for key, values in tags.items():
            cols = {k: F.lit("") for k in ("power", "industrial", "man_made", "landuse", "building", "name")} | {key: F.lit(values[-1].upper())}
            assert one(spark, lb.classify_facility(**cols)).normalized_category in (category, "Refinery / Petrochemical")
        del tier, kind, names
    none = {k: F.lit(None).cast("string") for k in ("power", "industrial", "man_made", "landuse", "building", "name")}
    assert tuple(one(spark, lb.classify_facility(**none))) == lb.FACILITY_DEFAULT
    assert one(spark, lb.classify_facility(**none | {"name": F.lit("Mineral Water")})).normalized_category == "Mining & Quarry"
    assert one(spark, lb.classify_facility(**none | {"name": F.lit("Mineral Water")}, strict_words=True)).normalized_category == "Other Industrial"


def test_clean_keeps_three_of_five(spark):
    rows = [("11.0", "78.0", "320", "5", D(2024, 1, 1)), ("bad", "78.0", "320", "5", D(2024, 1, 1)), ("12.0", "79.0", "NaN", "5", D(2024, 1, 1)), ("12.0", "79.0", "330", "5", D(2024, 1, 2)), ("10.0", "77.0", "310", "1", D(2024, 1, 3))]
    df = spark.createDataFrame(rows, "latitude string, longitude string, brightness string, frp string, acq_date date")
    assert quality.clean_detections(df).count() == 3
    with pytest.raises(ValueError, match="brightness"):
        quality.clean_detections(df.drop("brightness"))


def test_nearest_equals_brute_force(spark):
    r = random.Random(9)
    points = [(i, r.uniform(-60, 60), r.uniform(-170, 170)) for i in range(60)] + [(90, None, 1.0), (91, 0.0, 179.9)]
    sites = [(i, "node", r.uniform(-60, 60), r.uniform(-170, 170)) for i in range(40)] + [(50, "node", 0.0, -179.9)]
    p, s = spark.createDataFrame(points, "event_id long, latitude double, longitude double"), spark.createDataFrame(sites, "osm_id long, osm_type string, latitude double, longitude double")
    got = {x.event_id: [(n.distance_m, n.osm_id) for n in x.nearest] for x in spatial.nearest(p, s, 3).collect()}

    def dist(a, b):
        y1, x1, y2, x2 = map(math.radians, (*a, *b))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return round(2 * 6_371_000 * math.asin(math.sqrt(h)), 3)

    assert got[90] == []
    for i, y, x in points:
        if y is not None:
            want = sorted((dist((y, x), (b, c)), k) for k, _, b, c in sites)[:3]
            assert [k for _, k in got[i]] == [k for _, k in want]
            assert all(abs(a - b) < 0.01 for (a, _), (b, _) in zip(got[i], want, strict=True))
    assert all(x.nearest == [] for x in spatial.nearest(p, s.limit(0)).collect())


def test_polygon_excludes_its_edge_and_empty_polygon_keeps_columns(spark):
    edges = spark.createDataFrame([(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 2.0), (2.0, 2.0, 0.0, 2.0), (0.0, 2.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.0, 1.0), (3, 3.0, 1.0), (4, 2.0, 2.0)], "event_id long, latitude double, longitude double")
    assert [r.event_id for r in spatial.in_polygon(points, edges).collect()] == [1]
    assert spatial.in_polygon(points, edges.limit(0)).columns == points.columns
    assert [r.event_id for r in spatial.in_polygon(points, edges, most_edges=1).collect()] == [1]
    for most in (1, 5000):
        assert [r.event_id for r in spatial.in_polygon(points, edges.union(edges.limit(1).selectExpr(*(f"cast(null as double) as {c}" for c in edges.columns))), most_edges=most).collect()] == [1]


def test_image_ranking_prefers_the_nearest_day(spark):
    ev = spark.createDataFrame([(1, 7, D(2024, 11, 10)), (2, 8, D(2024, 11, 10)), (3, 9, D(2024, 11, 10))], "event_id long, tile_no int, acq_date date")
    images = [(1, 7, D(2024, 11, 8), 18.0), (2, 7, D(2024, 11, 8), 15.0), (3, 7, D(2024, 10, 29), 2.0), (4, 7, D(2024, 11, 10), 0.0), (5, 8, D(2024, 11, 5), 80.0), (6, 7, D(2024, 10, 25), 0.0), (7, 7, D(2024, 11, 25), None)]
    got = {(r.event_id, r.timing): r for r in evidence.match_images(ev, spark.createDataFrame(images, "product_id long, tile_no int, image_date date, cloud_cover double")).collect()}
    assert got[1, "pre"].product_id == 2 and got[1, "pre"].candidates == 3
    assert got[1, "post"].product_id == 7 and got[1, "post"].days == 15
    assert got[2, "pre"].status == "CLOUD_REJECTED" and got[3, "post"].status == "MISSING_PRODUCT"


def test_index_golden_values(spark):
    row = [("a", "pre", 4, 1000.0, 3000.0, 1500.0, 1200.0), ("a", "pre", 9, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(row, "event_id string, timing string, scl int, b04 double, b08 double, b11 double, b12 double")
    x = evidence.spectral_features(df).first()
    assert x.ndvi_mean == 0.5 and x.nbr_mean == pytest.approx(1800 / 4200) and x.ndwi_mean == pytest.approx(1 / 3) and x.swir_ratio_mean == pytest.approx(0.8) and x.valid_pixels == 1 and x.ndvi_std == 0


def test_patch_problems_are_named(spark):
    kind = "event_id long, timing string, scl array<int>, b04 array<double>, b08 array<double>, b11 array<double>, b12 array<double>"
    full = [1.0, 2.0]
    rows = [(1, "pre", [4, 5], full, full, full, full), (2, "pre", [4], full, full, full, full), (3, "pre", None, full, full, full, full), (4, "pre", [], [], [], [], [])]
    got = {r.event_id: r.patch_status for r in evidence.patch_to_pixels(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: "OK", 2: "DIMENSION_MISMATCH", 3: "MISSING_BAND", 4: "EMPTY_PATCH"}


def test_upsert_and_resume(spark):
    master = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "event_id long, s string, o string")
    new = spark.createDataFrame([(1, "z", None), (9, "q", "q")], "event_id long, s string, o string")
    assert sorted(map(tuple, recovery.upsert(master, new).collect())) == [(1, "z", "x"), (2, "b", "y")]
    assert [r.event_id for r in recovery.to_process(master, new).collect()] == [2]


def test_facets_let_unknown_power_pass_and_kpis_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(1, None, "Agricultural Burning", "HIGH", 1), (2, 50.0, "Agricultural Burning", "LOW", 0)], "event_id long, frp double, predicted_class string, ml_confidence string, persistent_location_flag int")
    assert [r.event_id for r in serve.facet_filter(df, serve.Facets(frp_max=20.0)).collect()] == [1]
    assert tuple(serve.kpis(df.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)
    assert serve.kpis(df).first().avg_frp == 25.0


def test_file_scan_by_sensor_and_header_order(spark, tmp_path):
    from emberline.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "fire_J1V_x.csv").write_text("latitude,longitude,brightness,frp,acq_date,acq_time\n11,78,320,5,2024-01-01,0630\n11,78,320,5,2024-01-01,0630\n")
    (tmp_path / "fire_SV-C2.csv").write_text("acq_date,frp,longitude,latitude,brightness\n2024-01-02,3,79,12,330\n")
    (tmp_path / "fire_J2V.csv").write_text("latitude,longitude,brightness,frp,acq_date\n11,78,320,5,2024-01-01\n")
    (tmp_path / "fire_SV_bad.csv").write_text("latitude,longitude,frp\n11,78,5\n")
    got = files.typed_detections(files.scan_detections(spark, [str(tmp_path)], {"J1V": ("N20", True), "_SV": ("NPP", True), "J2V": ("N21", False)})).collect()
    assert sorted((r.satellite_source, r.latitude, str(r.acq_date)) for r in got) == [("N20", 11.0, "2024-01-01"), ("NPP", 12.0, "2024-01-02")]


def test_file_scan_parses_quotes_line_ends_and_headers(spark, tmp_path):
    from emberline.sources import files

    sensors = {"J1V": ("N20", True), "_SV": ("NPP", True), "J2V": ("N21", False)}
    (tmp_path / "a_J1V.csv").write_text('latitude,longitude,brightness,frp,acq_date,satellite,instrument\n11,78,320,5,2024-01-01,"A, b","say ""hi"""\n12,79,321,6,2024-01-02,plain, spaced \n13,80,322\n14,81,323,7,2024-01-03,x,y,z\nlatitude,longitude,brightness,frp,acq_date,satellite,instrument\n')
    (tmp_path / "b_J1V.csv").write_text('"satellite","frp","acq_date","latitude","longitude","brightness"\n"two\nlines",8,2024-02-01,15,82,324\n"one",,2024-02-02,16,83,325\n')
    (tmp_path / "c_SV.csv").write_text("\ufefflatitude,longitude,brightness,frp,acq_date\n17,84,326,9,2024-03-01\n")
    (tmp_path / "d_J2V.csv").write_text("latitude,longitude,brightness,frp,acq_date\n18,85,327,9,2024-03-01\n")
    (tmp_path / "e_SV.csv").write_text("")
    got = {r.latitude: r for r in files.scan_detections(spark, [str(tmp_path)], sensors).collect()}
    assert sorted(got) == ["11", "12", "15", "16", "17"]
    assert (got["11"].satellite, got["11"].instrument, got["11"].acq_date) == ("A, b", 'say "hi"', "2024-01-01")
    assert (got["12"].instrument, got["15"].satellite, got["15"].frp, got["16"].frp, got["16"].longitude) == ("spaced", "two\nlines", "8", None, "83")
    assert (got["17"].satellite_source, got["17"].satellite, got["15"].satellite_source) == ("NPP", None, "N20")
    assert sorted((r.file_name, r.first_cell) for r in files.rejected_rows(spark, [str(tmp_path)], sensors).collect()) == [("a_J1V.csv", "13"), ("a_J1V.csv", "14")]


def test_facility_and_boundary_files(spark, tmp_path):
    import json

    from emberline.sources import files

    (tmp_path / "f.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"power": "plant"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "Old Quarry"}}, {"type": "way", "id": 3, "tags": {}}]}))
    got = {r.osm_id: (r.latitude, r.normalized_category) for r in files.facilities(spark, [str(tmp_path / "f.json")]).collect()}
    assert got == {1: (1.0, "Power Plant"), 2: (3.0, "Mining & Quarry")}
    ring = [[0, 0], [2, 0], [2, 2], [0, 0]]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME_1": "Tamil Nadu"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"name": "Other"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}))
    assert files.boundary_edges(spark, str(tmp_path / "b.geojson"), "tamil nadu").count() == 3
    assert files.boundary_edges(spark, str(tmp_path / "b.geojson"), "OTHER").count() == 6


def test_global_rank_keeps_all_rows_and_columns(spark):
    from emberline.operators import curation

    df = spark.range(300_000, numPartitions=16).select("id", (F.xxhash64("id") % 1000).alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), (F.col("id") * 2).alias("twice"))
    got = curation.global_rank(df, [F.desc("s"), F.asc("id")])
    assert got.columns == ["id", "s", "wide", "twice", "rank"]
    rows = got.select("rank", "s", "id", (F.col("twice") == F.col("id") * 2).alias("whole")).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 300_001)) and all(r.whole for r in rows)
    assert all((-a.s, a.id) < (-b.s, b.id) for a, b in zip(rows, rows[1:], strict=False))


def test_region_falls_back_to_its_box_and_guards_empty_input(spark):
    points = spark.createDataFrame([(1, 10.0, 78.0), (2, 0.0, 0.0)], "event_id long, latitude double, longitude double")
    none = spark.createDataFrame([], "x1 double, y1 double, x2 double, y2 double")
    assert [r.event_id for r in spatial.in_region(points, none).collect()] == [1] == [r.event_id for r in spatial.in_region(points, None).collect()]
    assert quality.require_rows(points).count() == 2
    with pytest.raises(ValueError, match="detections has no rows"):
        quality.require_rows(points.limit(0), "detections")


def test_nearest_with_few_and_far_sites(spark):
    points = spark.createDataFrame([(1, 10.0, 78.0), (2, -40.0, -170.0)], "event_id long, latitude double, longitude double")
    sites = spark.createDataFrame([(7, "node", 11.0, 78.0), (8, "way", 60.0, 10.0)], "osm_id long, osm_type string, latitude double, longitude double")
    got = {r.event_id: [n.osm_id for n in r.nearest] for r in spatial.nearest(points, sites, 3, block=1).collect()}
    assert got[1] == [7, 8] and sorted(got[2]) == [7, 8]


def test_sinks_write_what_they_read_back(spark, tmp_path):
    from emberline.sources import files

    df = spark.createDataFrame([(1, 1.5, float("inf"), "A, b", D(2024, 1, 1)), (2, float("nan"), 2.0, 'say "x"', D(2024, 1, 2))], "event_id long, frp double, z double, predicted_class string, acq_date date")
    files.write_clean(df, f"{tmp_path}/clean")
    back = spark.read.parquet(f"{tmp_path}/clean")
    assert sorted(back.columns) == sorted(df.columns) and back.filter("acq_date = '2024-01-02'").count() == 1
    files.write_classified(df, f"{tmp_path}/classified")
    got = {r.event_id: (r.frp, r.z, r.predicted_class) for r in spark.read.csv(f"{tmp_path}/classified", header=True, schema=df.schema).collect()}
    assert got == {1: (1.5, None, "A, b"), 2: (None, 2.0, 'say "x"')}
    files.write_facilities(df.select("event_id", F.create_map(F.lit("power"), F.lit("plant")).alias("tags")), f"{tmp_path}/sites")
    assert {r.tags["power"] for r in files.read_tags(spark.read.csv(f"{tmp_path}/sites", header=True)).collect()} == {"plant"}
    files.write_review_sheets(df.drop("acq_date"), f"{tmp_path}/sheets")
    assert {p.name for p in tmp_path.joinpath("sheets").iterdir() if p.is_dir()} and spark.read.option("header", True).csv(f"{tmp_path}/sheets").count() == 2


def test_model_record_and_saved_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from emberline.operators import ml

    rows = spark.createDataFrame([(i, float(i % 7), "x" if i % 2 else "y", "A" if i % 7 > 3 else "B") for i in range(80)], "event_id long, a double, b string, target string")
    for family in ("rf", "extra", "gbt"):
        fitted = ml.fit(rows, ["a"], ["b"], "target", family, trees=10, depth=3)
        assert ml.predicted(rows, fitted, ["a"]).filter("predicted_class = target").count() >= 76
    fitted = ml.fit(rows, ["a"], ["b"], "target", trees=10, depth=3)
    record = ml.save(fitted, str(tmp_path), rows, ["a"], ["b"], "target", {"accuracy": 1.0}).first()
    assert record.rows == 80 and record.rows_by_class == {"A": 33, "B": 47} and record.parameters["numTrees"] == "10" and record.metrics == {"accuracy": 1.0}
    again = PipelineModel.load(f"{tmp_path}/model")
    assert [r.predicted_class for r in ml.predicted(rows, again, ["a"]).orderBy("event_id").collect()] == [r.predicted_class for r in ml.predicted(rows, fitted, ["a"]).orderBy("event_id").collect()]
    with pytest.raises(ValueError, match="leaking"):
        ml.guard(rows.withColumn("cv_fold", F.lit(1)), ["a"])


def test_selections_match_plain_code(spark):
    from emberline.operators import curation

    r = random.Random(3)
    covers = ["Built-up", "Cropland", "Tree cover", "Mangroves"]
    rows = [(i, r.uniform(8, 13), r.uniform(76, 80), round(r.uniform(0, 9), 3), D(2024, 1, 1 + i % 28), r.choice(covers), "COVERED", i % 2, r.choice(["HIGH", "MEDIUM", "LOW"]), False) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, frp double, acq_date date, landcover_class string, coverage string, persistent_location_flag int, candidate_priority string, is_spatial_duplicate boolean")
    got = [x.event_id for x in curation.greedy_diverse(df, {"HIGH": 3, "MEDIUM": 2}, 6).orderBy("selection_order").collect()]
    by = {x[0]: x for x in rows}
    assert got[0] == min(i for i, x in by.items() if x[5] == "Mangroves") and len(got) == len(set(got)) == 6
    assert sum(by[i][8] == "HIGH" for i in got) >= 3 and sum(by[i][8] == "MEDIUM" for i in got) >= 2
