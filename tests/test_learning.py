"""Feature manifests, model families and the comparison of experiments."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import matrix, ml


def test_manifests_have_their_features(spark):
    sizes = {kind: len({c for c, *_ in matrix.manifest_rows(kind)}) for kind in ("training", "baseline", "sentinel2")}
    assert sizes == {"training": 31, "baseline": 36, "sentinel2": 73}
    numeric, categorical = matrix.columns_of(matrix.manifest_table(spark, "sentinel2"))
    assert (len(numeric), len(categorical)) == (67, 6) and {"s2_pre_ndvi_std", "s2_abs_dswir_ratio_mean", "s2_change_missing"} <= set(numeric)
    kinds = {c: k for c, k, _ in matrix.manifest_rows()}
    assert (kinds["near_industrial_500m"], kinds["landcover_code"], kinds["distance_to_facility_m"], kinds["persistent_location_flag"], kinds["is_day"]) == ("binary", "categorical", "numeric", "binary", "binary")


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(600).select(F.col("id").alias("event_id"), (F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"), F.when(F.rand(3) < 0.9, F.rand(4)).alias("noise"), F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("kind"))
    y = F.when(F.col("a") + F.col("b") > 13, "Industrial Thermal Activity").when(F.col("a") > F.col("b"), "Agricultural Burning").otherwise("Natural / Wildfire / Other")
    return spark.createDataFrame(x.withColumn("target_class", y).collect(), "event_id long, a double, b double, noise double, kind string, target_class string")


@pytest.mark.parametrize(("family", "how"), [("rf", {"trees": 20, "depth": 6}), ("extra", {"trees": 20, "depth": 6}), ("gbt", {"rounds": 3})])
def test_families_beat_chance_on_held_out_rows(rows, family, how):
    train, test = rows.filter("event_id % 4 <> 0"), rows.filter("event_id % 4 = 0")
    fitted = ml.fit(train, ["a", "b", "noise"], ["kind"], "target_class", family, **how)
    unseen = test.withColumn("kind", F.when(F.col("event_id") % 8 == 0, "never seen").otherwise(F.col("kind")))
    assert ml.summary_metrics(ml.predicted(unseen, fitted, ["a", "b", "noise"]), "target_class", "predicted_class").first()["accuracy"] > 0.75
    if family == "extra":
        cuts = [sorted({round(x, 6) for x in c["a"]}) for c, _ in fitted.groups]
        assert len({tuple(c) for c in cuts}) == len(cuts) > 1  # every group has its own cut points
        p = fitted.transform(unseen).select("probability").first()[0]
        assert sum(p) == pytest.approx(1)


def test_scores_are_the_forests_own(rows):
    """scoring takes batches of rows through the trees, and gives what Spark's own walk of each row gives, one-hot columns and unseen values included."""
    from pyspark.ml.functions import vector_to_array

    numeric = ["a", "b", "noise"]
    fitted = ml.fit(rows, numeric, ["kind"], "target_class", trees=20, depth=8)
    unseen = rows.withColumn("kind", F.when(F.col("event_id") % 8 == 0, "never seen").otherwise(F.col("kind")))
    p = vector_to_array("probability")
    own = {r.event_id: (r.predicted_class, *r.p) for r in ml.predicted(unseen, fitted, numeric).select("event_id", "predicted_class", F.array(*(F.round(p[i], 4) for i in range(3))).alias("p")).collect()}
    scored = ml.score(unseen, fitted, numeric, ["event_id"])
    got = {r[0]: tuple(r)[1:5] for r in scored.collect()}
    assert got == own and len(own) == 600
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()


def test_cut_points_are_counted_in_one_step(spark):
    """each group's vector has how many cuts a column exceeds, not-a-numbers all of them, then the one-hot columns; the step is the same few expressions however many columns and cuts there are."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = spark.createDataFrame([(1, 0.5, 7.0, 1.0), (2, 2.0, 7.0, 0.0), (3, 9.0, float("nan"), 1.0)], "i int, _a_f double, _b_f double, o double")
    data = VectorAssembler(inputCols=["o"], outputCol="_kind_o").transform(data)
    out = ml.ExtraTrees._binned(data, [{"a": [1.0, 2.0, 3.0], "b": [7.0, 7.0, 7.0]}, {"a": [0.0, 0.1, 8.0], "b": [1.0, 6.0, 8.0]}], ["kind"])
    got = {r.i: (list(r.x), list(r.y)) for r in out.select("i", vector_to_array("_cut0").alias("x"), vector_to_array("_cut1").alias("y")).collect()}
    assert got == {1: ([0, 0, 1], [2, 2, 1]), 2: ([1, 0, 0], [2, 2, 0]), 3: ([3, 3, 1], [3, 3, 1])}


def test_experiments_compare_and_select(rows):
    sets = {"Baseline": (["noise"], ["kind"]), "More": (["a", "b", "noise"], ["kind"])}
    oof = ml.experiments(rows, sets, "target_class", families={"rf": {"trees": 5, "depth": 4}}, k=3)
    assert oof.count() == 1200 and oof.groupBy("experiment", "event_id").count().filter("count > 1").count() == 0
    got = {r.experiment: r for r in ml.compared(oof, "target_class", "Baseline").collect()}
    assert got["More"].selected and not got["Baseline"].selected and got["Baseline"].macro_f1_delta == 0
    assert got["More"].macro_f1_delta == pytest.approx(got["More"].macro_f1 - got["Baseline"].macro_f1, abs=1e-6) and got["More"].balanced_accuracy_delta > 0.2
    assert 0 < got["More"].macro_f1_cv_std < 0.2 and got["More"].industrial_recall > 0.6


def test_experiments_share_the_first_steps_of_a_fold(rows, monkeypatch):
    """weights, medians and categories are worked out once a fold, for all manifests and families, and predictions are those of fits of their own."""
    sets, families = {"Baseline": (["noise"], ["kind"]), "More": (["a", "b", "noise"], [])}, {"rf": {"trees": 5, "depth": 4}, "extra": {"trees": 5, "depth": 4}}
    plain, calls = ml.balanced, []
    monkeypatch.setattr(ml, "balanced", lambda *x: calls.append(1) or plain(*x))
    oof = ml.experiments(rows, sets, "target_class", families=families, k=2)
    assert len(calls) == 2
    folded = ml.materialize(ml.folds(rows, "target_class", k=2))
    for name, (numeric, categorical) in sets.items():
        for family, how in families.items():
            own = {x.event_id: x.predicted_class for x in ml.cross_validate(folded, numeric, categorical, "target_class", model=family, k=2, **how).collect()}
            assert own == {x.event_id: x.predicted_class for x in oof.filter((oof.experiment == name) & (oof.model_name == family)).collect()}


def test_selection_takes_industrial_recall_third(spark):
    results = spark.createDataFrame([("p", 0.7, 0.7, 0.5, 0.9), ("q", 0.7, 0.7, 0.6, 0.1), ("r", 0.7, 0.6, 0.9, 0.9)], "model_name string, macro_f1 double, balanced_accuracy double, industrial_recall double, accuracy double")
    assert ml.best_model(results).first()["model_name"] == "q"


def test_wanted_rows_have_the_features_of_the_whole_table(spark):
    """a model's rows are searched alone, but the statistics of their cells are over all detections."""
    from emberline.sources.fixtures import load

    x = load(spark, "/root/testdata/sf0.001", "detections").filter("event_id % 401 <> 0 and brightness is not null")
    every = matrix.feature_table(x, None, None, None, sources={"cells"})
    some = matrix.feature_table(x, None, None, None, sources={"cells"}, wanted=x.filter("event_id % 9 = 0").select("event_id").union(x.limit(0).select("event_id")))
    few = [c for c in every.columns if c != "grid_total_frp"]  # a sum of doubles
    assert some.count() == x.filter("event_id % 9 = 0").count() > 0
    assert some.select(*few).exceptAll(every.select(*few)).count() == 0
