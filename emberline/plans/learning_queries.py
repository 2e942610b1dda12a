"""Queries over learned models: folds, training, scoring, metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.labels import target_class
from emberline.operators import features, matrix, ml, serve
from emberline.plans.detection_queries import SEARCHED, _classified, clean
from emberline.plans.registry import Tables, query
from emberline.plans.serving_queries import CLASS_SQL, REVIEWED, TARGET
from emberline.sources.shared import materialize, shared_folder, spread, union_all

NUMERIC = ["brightness", "bright_t31", "frp", "scan", "track", "brightness_difference", "log_frp", "hour", "confidence_encoded"]
CATEGORICAL = ["satellite_source", "daynight"]


def cohort(t: Tables) -> DataFrame:
    """Reviewed events with features and the training class."""
    d = features.thermal_features(features.temporal_features(t("detections")))
    x = serve.training_cohort(serve.with_review(d, t("reviewer_labels")))
    return x.withColumn("target_class", target_class("reviewed_class")).filter("target_class is not null")


def sites(t: Tables) -> DataFrame:
    """Facilities with the class of their tags."""
    tags = _classified(t).select("osm_id", "facility_type", "normalized_category")
    return t("facilities").join(tags, "osm_id", "left")


def matrix_of(t: Tables, kind: str, wanted: DataFrame | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Features of all detections, or of those with a key in ``wanted``, as a manifest asks for them, and its numeric and categorical columns."""
    table = matrix.manifest_table(t("detections").sparkSession, kind)
    numeric, categorical = matrix.columns_of(table)
    sources = {r["source"] for r in table.select("source").distinct().collect()}
    rows = matrix.feature_table(clean(t), sites(t), t("landcover_cells"), t("tiles"), t("pixels") if "images" in sources else None, sources, wanted=wanted)
    return materialize(rows), numeric, categorical


def labelled(t: Tables, rows: DataFrame) -> DataFrame:
    """The reviewed ones of ``rows`` with their training class."""
    return rows.join(cohort(t).select("event_id", "target_class"), "event_id")


COHORT = REVIEWED + f", cohort AS (SELECT event_id, {TARGET} AS target_class FROM reviewed WHERE reviewed_class <> 'REVIEW_REQUIRED')"


@query("w8_a9_folds", "detections reviewer_labels", COHORT + """, c AS (SELECT target_class, COUNT(*) AS n FROM cohort GROUP BY 1), f AS (SELECT CAST(k AS INTEGER) AS cv_fold FROM (VALUES (0), (1), (2), (3), (4)) v(k)) SELECT target_class, cv_fold, n // 5 + CASE WHEN cv_fold < n % 5 THEN 1 ELSE 0 END AS n FROM c CROSS JOIN f WHERE n // 5 + CASE WHEN cv_fold < n % 5 THEN 1 ELSE 0 END > 0""")
def _(t):
    return ml.folds(cohort(t), "target_class").groupBy("target_class", "cv_fold").agg(F.count("*").alias("n"))


@query("a9_crosstab", "detections reviewer_labels", COHORT + ", c AS (SELECT event_id % 4 AS part, target_class FROM cohort) SELECT part, " + ", ".join(f"COUNT(CASE WHEN target_class = '{c}' THEN 1 END) AS \"{c}\"" for c in CLASS_SQL) + " FROM c GROUP BY part")
def _(t):
    from emberline.operators.report import crosstab

    return crosstab(cohort(t).withColumn("part", F.col("event_id") % 4), "part", "target_class", list(CLASS_SQL))


@query("k13_holdout", "detections reviewer_labels", COHORT + " SELECT target_class, COUNT(*) // 4 AS held FROM cohort GROUP BY 1")
def _(t):
    return ml.holdout(cohort(t), "target_class").groupBy("target_class").agg(F.count_if("is_test").alias("held"))


@query("l3_l14_train_and_score")
def _(t):
    """The forest of 300 trees over the 31 training features, and its score of every detection."""
    rows, numeric, categorical = matrix_of(t, "training")
    train = materialize(labelled(t, ml.guard(rows, numeric)))
    return ml.score(spread(rows, SEARCHED), ml.fit(train, numeric, categorical, "target_class"), numeric, ["event_id"])


@query("l8_a32_cross_validation")
def _(t):
    oof = ml.cross_validate(materialize(ml.folds(cohort(t), "target_class")), NUMERIC, CATEGORICAL, "target_class", trees=100, depth=6)
    return ml.summary_metrics(oof, "target_class", "predicted_class", "cv_fold")


@query("l9_model_families")
def _(t):
    """Metrics of each family on the quarter that is held out."""
    rows = materialize(ml.holdout(cohort(t), "target_class"))
    train, test = rows.filter("not is_test"), rows.filter("is_test")
    out = []
    for family, how in ml.FAMILIES.items():
        fitted = ml.fit(train, NUMERIC, CATEGORICAL, "target_class", family, **how)
        out.append(ml.summary_metrics(ml.predicted(test, fitted, NUMERIC), "target_class", "predicted_class").withColumn("model_name", F.lit(family)))
    return union_all(out)


@query("l10_experiments")
def _(t):
    """Both manifests, five folds and the two forests: a row each with its differences and whether it is the selected one.  Boosting takes part through ``families``; see the README."""
    rows, *_ = matrix_of(t, "sentinel2", cohort(t))
    spark = rows.sparkSession
    sets = {name: matrix.columns_of(matrix.manifest_table(spark, kind)) for name, kind in (("Baseline", "baseline"), ("Sentinel-2 Enhanced", "sentinel2"))}
    return ml.compared(ml.experiments(labelled(t, rows), sets, "target_class", families={k: ml.FAMILIES[k] for k in ("rf", "extra")}), "target_class", "Baseline")


@query("l12_model_metadata")
def _(t):
    """The record of a forest over the baseline's 36 features as it is kept beside the saved model, with its out-of-fold metrics."""
    rows, numeric, categorical = matrix_of(t, "baseline", cohort(t))
    train = materialize(ml.folds(labelled(t, rows), "target_class"))
    oof = ml.cross_validate(train, numeric, categorical, "target_class", trees=100, depth=6)
    metrics = ml.summary_metrics(oof, "target_class", "predicted_class").first().asDict()
    folder = f"{shared_folder(train.sparkSession)}/model-{uuid.uuid4().hex}"
    record = ml.save(ml.fit(train, numeric, categorical, "target_class", trees=100, depth=6), folder, train, numeric, categorical, "target_class", metrics)
    return record.select("model_type", "rows", F.size("classes").alias("classes"), (F.size("numeric_features") + F.size("categorical_features")).alias("features"), F.element_at("parameters", "numTrees").alias("trees"), F.element_at("metrics", "macro_f1").alias("macro_f1"), F.element_at("metrics", "accuracy").alias("accuracy"))


@query("l5_full_manifests", "detections", "SELECT * FROM (VALUES ('baseline', CAST(36 AS BIGINT), CAST(6 AS BIGINT)), ('sentinel2', CAST(73 AS BIGINT), CAST(6 AS BIGINT)), ('training', CAST(31 AS BIGINT), CAST(0 AS BIGINT))) v(kind, features, categorical)")
def _(t):
    """Features of each manifest that the matrix holds: all of them."""
    rows, *_ = matrix_of(t, "sentinel2")
    spark = rows.sparkSession
    parts = [ml.manifest(rows, matrix.manifest_table(spark, kind)).withColumn("kind", F.lit(kind)) for kind in ("baseline", "sentinel2", "training")]
    held = union_all(parts).filter(F.col("feature_name").isin(rows.columns))
    return held.groupBy("kind").agg(F.count("*").alias("features"), F.count_if(F.col("data_type") == "categorical").alias("categorical"))


@query("l5_manifest", "detections", """SELECT 'brightness' AS feature_name, 'numeric' AS data_type, COUNT(*) - COUNT(brightness) AS missing_count, ROUND(100.0 * (COUNT(*) - COUNT(brightness)) / CAST(COUNT(*) AS DOUBLE), 4) AS missing_pct, CASE WHEN COUNT(*) > COUNT(brightness) THEN 'median' ELSE 'as is' END AS handling FROM detections
  UNION ALL SELECT 'daynight', 'categorical', COUNT(*) - COUNT(daynight), CAST(0 AS DOUBLE), 'one-hot' FROM detections UNION ALL SELECT 'slope', 'numeric', COUNT(*), CAST(100 AS DOUBLE), 'median' FROM detections""")  # fmt: skip
def _(t):
    d = t("detections")
    spec = d.sparkSession.createDataFrame([("brightness", "numeric"), ("daynight", "categorical"), ("slope", "numeric")], "feature_name string, data_type string")
    return ml.manifest(d, spec)


PAIRS = ", pairs AS (SELECT event_id, predicted_class AS p, CASE WHEN event_id % 5 = 0 THEN 'Agricultural Burning' WHEN event_id % 7 = 0 THEN 'Natural / Wildfire / Other' ELSE predicted_class END AS y, CAST(event_id % 3 AS INTEGER) AS fold FROM predictions)"


def _pairs(t: Tables) -> DataFrame:
    e = F.col("event_id")
    y = F.when(e % 5 == 0, "Agricultural Burning").when(e % 7 == 0, "Natural / Wildfire / Other").otherwise(F.col("predicted_class"))
    return t("predictions").select("event_id", F.col("predicted_class").alias("p"), y.alias("y"), (e % 3).cast("int").alias("fold"))


@query("a31_confusion", "predictions", PAIRS + ", b AS (SELECT * FROM (VALUES (0, 'Agricultural Burning'), (1, 'Industrial Thermal Activity'), (2, 'Natural / Wildfire / Other')) v(class_no, true_class)) SELECT CAST(class_no AS INTEGER) AS class_no, true_class, " + ", ".join(f"COUNT(CASE WHEN p = '{c}' THEN 1 END) AS pred_{i}" for i, c in enumerate(CLASS_SQL)) + " FROM b LEFT JOIN pairs ON y = true_class GROUP BY 1, 2")
def _(t):
    return ml.confusion(_pairs(t), "y", "p", list(CLASS_SQL))


METRICS = """, k AS (SELECT c.c, COUNT(CASE WHEN y = c.c THEN 1 END) AS s, COUNT(CASE WHEN p = c.c THEN 1 END) AS q, COUNT(CASE WHEN y = c.c AND p = c.c THEN 1 END) AS tp FROM pairs CROSS JOIN (SELECT DISTINCT y AS c FROM pairs) c GROUP BY c.c)"""


@query("a32_class_metrics", "predictions", PAIRS + METRICS + ' SELECT c AS "class", s AS support, ROUND(COALESCE(tp / CAST(NULLIF(q, 0) AS DOUBLE), 0), 6) AS precision, ROUND(COALESCE(tp / CAST(NULLIF(s, 0) AS DOUBLE), 0), 6) AS recall, ROUND(2.0 * tp / CAST(s + q AS DOUBLE), 6) AS f1 FROM k')
def _(t):
    return ml.class_metrics(_pairs(t), "y", "p")


@query("a32_summary_metrics", "predictions", PAIRS + METRICS + " SELECT ROUND(SUM(tp) / CAST(SUM(s) AS DOUBLE), 6) AS accuracy, ROUND(AVG(tp / CAST(s AS DOUBLE)), 6) AS balanced_accuracy, ROUND(AVG(2.0 * tp / CAST(s + q AS DOUBLE)), 6) AS macro_f1 FROM k")
def _(t):
    return ml.summary_metrics(_pairs(t), "y", "p")


@query("a33_fold_spread", "predictions", PAIRS + ", f AS (SELECT fold, COUNT(CASE WHEN y = p THEN 1 END) / CAST(COUNT(*) AS DOUBLE) AS accuracy FROM pairs GROUP BY fold) SELECT ROUND(AVG(ROUND(accuracy, 6)), 6) AS accuracy_mean, ROUND(STDDEV_SAMP(ROUND(accuracy, 6)), 6) AS accuracy_std FROM f")
def _(t):
    m = ml.summary_metrics(_pairs(t), "y", "p", "fold")
    return ml.fold_spread(m, ["accuracy"]).select(F.round("accuracy_mean", 6).alias("accuracy_mean"), F.round("accuracy_std", 6).alias("accuracy_std"))


RESULTS = """, results AS (SELECT fold AS f, 'rf' || fold AS model_name, 'base' AS features, COUNT(CASE WHEN y = p THEN 1 END) / CAST(COUNT(*) AS DOUBLE) AS accuracy FROM pairs GROUP BY fold)"""


@query("k7_best_model", "predictions", PAIRS + RESULTS + " SELECT model_name, ROUND(accuracy, 6) AS accuracy FROM results ORDER BY accuracy DESC, model_name LIMIT 1")
def _(t):
    r = _pairs(t).groupBy("fold").agg((F.count_if(F.col("y") == F.col("p")) / F.count("*")).alias("accuracy")).withColumn("model_name", F.concat(F.lit("rf"), "fold"))
    return ml.best_model(r, ("accuracy",)).select("model_name", F.round("accuracy", 6).alias("accuracy"))


@query("l10_experiment_deltas", "predictions", PAIRS + """, r AS (SELECT 'rf' AS model_name, CASE fold WHEN 0 THEN 'base' WHEN 1 THEN 'full' ELSE 'image' END AS features, ROUND(COUNT(CASE WHEN y = p THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) AS accuracy FROM pairs GROUP BY fold)
  SELECT features, accuracy, ROUND(accuracy - (SELECT accuracy FROM r WHERE features = 'base'), 6) AS accuracy_delta FROM r""")  # fmt: skip
def _(t):
    name = F.when(F.col("fold") == 0, "base").when(F.col("fold") == 1, "full").otherwise("image")
    r = _pairs(t).groupBy("fold").agg(F.round(F.count_if(F.col("y") == F.col("p")) / F.count("*"), 6).alias("accuracy")).select(F.lit("rf").alias("model_name"), name.alias("features"), "accuracy")
    return ml.compared_to(r, "base", ("accuracy",)).select("features", "accuracy", "accuracy_delta")


@query("l17_errors", "predictions detections", PAIRS + " SELECT p.event_id, p.y, p.p AS predicted_class, d.frp FROM pairs p JOIN detections d ON p.event_id = d.event_id WHERE p.y <> p.p")
def _(t):
    return ml.errors(_pairs(t).select("event_id", "y", F.col("p").alias("predicted_class")), t("detections").select("event_id", "frp"), "y")


@query("l1_l2_matrix_and_medians", "detections", "SELECT event_id, COALESCE(brightness, (SELECT MEDIAN(brightness) FROM detections)) AS brightness, CAST(0 AS DOUBLE) AS slope FROM detections")
def _(t):
    from pyspark.ml.feature import Imputer

    x = ml.numeric_matrix(t("detections").select("event_id", "brightness"), ["brightness", "slope"])
    return Imputer(strategy="median", inputCols=["brightness"], outputCols=["b"], relativeError=0.0).fit(x).transform(x).select("event_id", F.col("b").alias("brightness"), "slope")


@query("k8_l11_importances")
def _(t):
    fitted = ml.fit(cohort(t), NUMERIC, CATEGORICAL, "target_class")
    rows = ml.numeric_matrix(cohort(t), NUMERIC)
    for stage in fitted.stages[1:-1]:
        rows = stage.transform(rows)
    return ml.importances(fitted, rows)
