"""Learning and scoring with Spark ML."""

from __future__ import annotations

import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberline.functions.labels import confidence_tier
from emberline.operators.ranks import ranks_within
from emberline.sources.shared import materialize, shared_folder, spread

LEAKAGE = ("reviewed_class", "raw_label", "target_class", "cv_fold", "validation_label")


def manifest(df: DataFrame, spec: DataFrame) -> DataFrame:
    """Spec rows (feature_name, data_type, source) with missing counts and how they are handled; features that ``df`` lacks are all missing."""
    names = [r["feature_name"] for r in spec.select("feature_name").collect()]
    one = df.agg(F.count("*").alias("_rows"), *((F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(c) for c in names))
    rows = one.select("_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("missing_count")) for c in names))).alias("x")).select("_rows", "x.*")
    out = spec.join(F.broadcast(rows), "feature_name")
    handling = F.when(F.col("data_type") == "categorical", "one-hot").when(F.col("missing_count") > 0, "median").otherwise("as is")
    return out.withColumns({"missing_pct": F.coalesce(F.round(100.0 * F.col("missing_count") / F.nullif(F.col("_rows"), F.lit(0)), 4), F.lit(0.0)), "handling": handling}).drop("_rows")


def numeric_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """L1: the columns as doubles; a missing one is 0."""
    return df.withColumns({c: (F.col(c).cast("double") if c in df.columns else F.lit(0.0)) for c in columns})


def guard(df: DataFrame, columns: list[str], leakage: tuple[str, ...] = LEAKAGE) -> DataFrame:
    """An error if a leaking column is there or a feature is missing."""
    if bad := [c for c in leakage if c in df.columns]:
        raise ValueError(f"leaking columns: {', '.join(bad)}")
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing features: {', '.join(gone)}")
    return df


def stages(numeric: list[str], categorical: list[str], label: str, model: str | None = "rf", trees: int = 300, depth: int = 12, seed: int = 42, rounds: int = 100) -> list:
    """Median imputation, one-hot with unknown values kept apart, and a model: rf, or gbt (histogram boosting, one class against the rest, ``rounds`` each); None stops before it."""
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    prep = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"_{c}_f" for c in numeric])] if numeric else []
    if categorical:
        prep.append(StringIndexer(inputCols=categorical, outputCols=[f"_{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"))
        prep.append(OneHotEncoder(inputCols=[f"_{c}_i" for c in categorical], outputCols=[f"_{c}_o" for c in categorical]))
    prep.append(VectorAssembler(inputCols=[f"_{c}_f" for c in numeric] + [f"_{c}_o" for c in categorical], outputCol="_features"))
    common = {"featuresCol": "_features", "labelCol": "_label"}
    forest = {"numTrees": trees, "maxDepth": depth, "minInstancesPerNode": 3, "seed": seed, "weightCol": "_weight", "maxMemoryInMB": 1024, "cacheNodeIds": True}
    if model is None:
        return [indexer, *prep]
    learner = {
        "rf": lambda: RandomForestClassifier(**common, **forest),
        "gbt": lambda: OneVsRest(classifier=GBTClassifier(**common, maxIter=rounds, maxDepth=4, minInstancesPerNode=3, seed=seed, cacheNodeIds=True, checkpointInterval=-1), weightCol="_weight", parallelism=3, **common),
    }[model]()
    return [indexer, *prep, learner]


class ExtraTrees:
    """Trees over random cut points.

    Trees are grown in ``groups``; each group draws its own cut points between a column's least and greatest value, so its trees can split there only, and searches a random
    subset of columns at each node, without bootstrap.  Probabilities are the mean over the groups.
    """

    CUTS = 8

    def __init__(self, prepared: PipelineModel, groups: list[tuple[dict[str, list[float]], object]], categorical: list[str]):
        self.prepared, self.groups, self.categorical, self.labels = prepared, groups, categorical, prepared.stages[0].labels

    @staticmethod
    def _binned(rows: DataFrame, groups: list[dict[str, list[float]]], categorical: list[str]) -> DataFrame:
        """``rows`` with a vector _cut0, _cut1, ... for each group: how many of its cuts each column exceeds, and the one-hot columns.  One vectorised step for all columns and groups, as comparisons
        written out one by one are more code than Spark compiles."""
        names = list(groups[0]) if groups else []
        if not names:
            for g in range(len(groups)):
                rows = VectorAssembler(inputCols=[f"_{c}_o" for c in categorical], outputCol=f"_cut{g}").transform(rows)
            return rows
        cuts = np.array([[points[c] for points in groups] for c in names])  # column, group, cut

        @arrow_udf("array<array<double>>")
        def bins(table: pa.Array) -> pa.Array:
            n = len(table)
            values = table.flatten().to_numpy(zero_copy_only=False).reshape(n, len(names))
            out = np.empty((n, len(groups), len(names)))
            for i, column in enumerate(cuts):
                for g, points in enumerate(column):
                    out[:, g, i] = np.searchsorted(points, values[:, i])  # not-a-numbers exceed all
            inner = pa.ListArray.from_arrays(pa.array(np.arange(n * len(groups) + 1) * len(names), pa.int32()), pa.array(out.ravel()))
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(groups), pa.int32()), inner)

        rows = rows.withColumn("_bins", bins(F.array(*(F.col(f"_{c}_f") for c in names))))
        for g in range(len(groups)):
            rows = VectorSizeHint(inputCol=f"_bins{g}", size=len(names), handleInvalid="optimistic").transform(rows.withColumn(f"_bins{g}", array_to_vector(F.get("_bins", g))))
            rows = VectorAssembler(inputCols=[f"_bins{g}", *(f"_{c}_o" for c in categorical)], outputCol=f"_cut{g}").transform(rows).drop(f"_bins{g}")
        return rows.drop("_bins")

    @classmethod
    def fit(cls, rows: DataFrame, numeric: list[str], categorical: list[str], label: str, trees: int = 100, depth: int = 6, groups: int = 5, seed: int = 42, prepared: PipelineModel | None = None) -> ExtraTrees:
        """``rows`` has _weight; see ``fit`` of this module."""
        prepared = prepared or Pipeline(stages=stages(numeric, categorical, label, None)).fit(rows)
        ready = materialize(prepared.transform(rows).select("_label", "_weight", *(f"_{c}_f" for c in numeric), *(f"_{c}_o" for c in categorical)))
        ends = ready.agg(*(f(f"_{c}_f").alias(f"{c}_{n}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max)))).first() if numeric else {}
        all_cuts = []
        for g in range(groups):
            draw = {c: random.Random(f"{seed} {g} {c}") for c in numeric}
            all_cuts.append({c: sorted(draw[c].uniform(ends[f"{c}_lo"], ends[f"{c}_hi"]) for _ in range(cls.CUTS)) for c in numeric})
        ready = materialize(cls._binned(ready, all_cuts, categorical).select("_label", "_weight", *(f"_cut{g}" for g in range(groups))))
        made = []
        for g, cuts in enumerate(all_cuts):
            forest = RandomForestClassifier(featuresCol=f"_cut{g}", labelCol="_label", weightCol="_weight", numTrees=-(-trees // groups), maxDepth=depth, minInstancesPerNode=2, bootstrap=False, featureSubsetStrategy="sqrt", subsamplingRate=1.0, seed=seed + g)
            made.append((cuts, forest.fit(ready)))
        return cls(prepared, made, categorical)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with probability (an array in the order of ``labels``) and predicted_class, the first of equals."""
        for stage in self.prepared.stages[1:]:
            rows = stage.transform(rows)
        rows = self._binned(rows, [cuts for cuts, _ in self.groups], self.categorical)
        for i, (_, forest) in enumerate(self.groups):
            rows = forest.transform(rows).withColumn(f"_p{i}", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction", f"_cut{i}")
        parts = [f"_p{i}" for i in range(len(self.groups))]
        mean = F.array(*(reduce(Column.__add__, [F.col(p)[k] for p in parts]) / len(parts) for k in range(len(self.labels))))
        best = F.array_position(F.col("probability"), F.array_max("probability")).cast("int")
        return rows.withColumn("probability", mean).withColumn("predicted_class", F.element_at(F.array(*map(F.lit, self.labels)), best)).drop(*parts)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """L3: _weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(counts.crossJoin(whole)), label).withColumn("_weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def weighted(df: DataFrame, numeric: list[str], categorical: list[str], label: str) -> DataFrame:
    """The rows that a fit reads, with _weight, written once as every step reads them; a column without any value is 0."""
    filled = numeric_matrix(df, numeric)
    empty = filled.agg(*(F.count(c).alias(c) for c in numeric)).first().asDict() if numeric else {}
    if gone := [c for c, n in empty.items() if not n]:
        filled = filled.fillna(0.0, gone)
    filled = filled.withColumns({c: F.col(c).cast("string") for c in categorical})
    return materialize(balanced(filled, label))


def fit(df: DataFrame, numeric: list[str], categorical: list[str], label: str, model: str = "rf", ready: tuple[DataFrame, PipelineModel] | None = None, **how) -> PipelineModel | ExtraTrees:
    """The fitted pipeline of a family: rf, gbt or extra, on weighted rows dealt over all cores.

    ``ready`` has those of ``df`` and the fitted steps before the features are put together, where fits on the same rows share them; they may hold more columns.
    """
    rows, prepared = ready or (weighted(df, numeric, categorical, label), None)
    rows = rows.coalesce(-(-rows.count() // 20_000) or 1) if model == "gbt" else spread(rows)  # boosting runs thousands of short jobs, which few partitions make shorter
    if model == "extra":
        return ExtraTrees.fit(rows, numeric, categorical, label, prepared=prepared, **how)
    steps = stages(numeric, categorical, label, model, **how)
    if prepared is None:
        return Pipeline(stages=steps).fit(rows)
    return PipelineModel([*prepared.stages, *Pipeline(stages=steps[-2:]).fit(prepared.transform(rows)).stages])


def save(fitted: PipelineModel, path: str, df: DataFrame, numeric: list[str], categorical: list[str], label: str, metrics: dict[str, float]) -> DataFrame:
    """Writes the pipeline to ``path``/model and its record to ``path``/metadata, and returns the record: one row of what the model is and was fitted on."""
    learner = fitted.stages[-1]
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    row = (type(learner).__name__, fitted.stages[0].labels, numeric, categorical, sum(counts.values()), {str(k): v for k, v in counts.items()}, {p.name: str(v) for p, v in learner.extractParamMap().items()}, metrics)
    kind = "model_type string, classes array<string>, numeric_features array<string>, categorical_features array<string>, rows long, rows_by_class map<string,long>, parameters map<string,string>, metrics map<string,double>"
    fitted.write().overwrite().save(f"{path}/model")
    record = df.sparkSession.createDataFrame([row], kind)
    record.write.mode("overwrite").parquet(f"{path}/metadata")
    return df.sparkSession.read.parquet(f"{path}/metadata")


def _votes(forest: RandomForestClassificationModel, spark: SparkSession):
    """The function from arrays of features to a forest's raw prediction: the sum of its trees' class shares, as Spark's own.

    Spark takes each row through all trees, whose nodes don't fit the caches when they are many and deep; here a batch of rows goes through one tree after another.  The nodes are
    read from the saved model and broadcast: the trees and their depth bound them, whatever the rows.
    """
    folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    forest.save(folder)
    split = F.col("nodeData.split")
    nodes = spark.read.parquet(f"{folder}/data").select(
        "treeID", "nodeData.id", "nodeData.rightChild", split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], 0).alias("cut"), split["numCategories"].alias("categories"), F.col("nodeData.impurityStats").alias("stats"),
    ).orderBy("treeID", "id").toArrow()
    tree, own, right, feature, cut, categories = (nodes.column(c).to_numpy() for c in ("treeID", "id", "rightChild", "feature", "cut", "categories"))
    if (categories > 2).any():
        raise ValueError("splits over more than two categories aren't scored in batches")
    n, leaf, starts = len(tree), right < 0, np.flatnonzero(own == 0)
    at = np.arange(n)
    left, right = np.where(leaf, at, at + 1), np.where(leaf, at, starts[np.cumsum(own == 0) - 1] + right)  # a node's left child follows it
    ones_left = (categories == 2) & (cut == 1)  # of the values 0 and 1
    cut = np.where(leaf, np.inf, np.where(categories == 2, 0.5, cut))
    children = np.stack([np.where(ones_left, left, right), np.where(ones_left, right, left)], 1).astype(np.int32).ravel()  # of a value above the cut, and of one up to it
    stats = nodes.column("stats").combine_chunks().flatten().to_numpy().reshape(n, -1)
    total = stats.sum(1, keepdims=True)
    shares = np.where(total != 0, stats / np.where(total != 0, total, 1.0), 0.0)
    depths = [t.depth for t in forest.trees]
    held = spark.sparkContext.broadcast((np.maximum(feature, 0).astype(np.int32), cut, children, shares, starts.astype(np.int32), depths))

    @arrow_udf("array<double>")
    def votes(features: pa.Array) -> pa.Array:
        feature, cut, children, shares, starts, depths = held.value
        x = features.flatten().to_numpy(zero_copy_only=False)
        places = np.arange(len(features), dtype=np.int32) * np.int32(len(x) // max(len(features), 1))
        out = np.zeros((len(features), shares.shape[1]))
        for start, depth in zip(starts, depths, strict=True):
            at = np.full(len(features), start, np.int32)
            for _ in range(depth):
                at = children.take(2 * at + (x.take(places + feature.take(at)) <= cut.take(at)))
            out += shares.take(at, 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return votes


def score(df: DataFrame, fitted: PipelineModel, numeric: list[str], keep: list[str]) -> DataFrame:
    """Class, probabilities to four digits, the largest, and its tier."""
    labels = fitted.stages[0].labels
    if isinstance(fitted.stages[-1], RandomForestClassificationModel):
        votes = _votes(fitted.stages[-1], df.sparkSession)
        rows = _prepared(df, fitted, numeric, fitted.stages[1:-1]).withColumn("_votes", votes(vector_to_array("_features")))
        raw = [F.col("_votes")[i] for i in range(len(labels))]
        p = [v / reduce(Column.__add__, raw) for v in raw]
        rows = rows.withColumn("predicted_class", F.element_at(F.array(*map(F.lit, labels)), F.array_position("_votes", F.array_max("_votes")).cast("int")))
    else:
        rows, p = predicted(df, fitted, numeric), [vector_to_array("probability")[i] for i in range(len(labels))]
    names = ["probability_" + "_".join("".join(ch if ch.isalnum() else " " for ch in x).lower().split()) for x in labels]
    out = rows.select(*keep, "predicted_class", *(F.round(v, 4).alias(n) for v, n in zip(p, names, strict=True)))
    return out.withColumn("max_probability", F.greatest(*names)).withColumn("ml_confidence", confidence_tier("max_probability"))


def folds(df: DataFrame, label: str, key: str = "event_id", k: int = 5, seed: int = 42) -> DataFrame:
    """cv_fold from 0 to k - 1, dealt in turn within each class in the order of a hash; sizes per class differ by one at most."""
    ranked = ranks_within(df, [label], [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], "_rank")
    return ranked.withColumn("cv_fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def holdout(df: DataFrame, label: str, key: str = "event_id", share: float = 0.25, seed: int = 42) -> DataFrame:
    """is_test for a quarter of each class by hash order."""
    ranked = ranks_within(df, [label], [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], "_rank", "_size")
    return ranked.withColumn("is_test", F.col("_rank") <= F.floor(share * F.col("_size"))).drop("_rank", "_size")


def _prepared(df: DataFrame, fitted: PipelineModel, numeric: list[str], steps: list) -> DataFrame:
    """``df`` after some steps of a fitted pipeline."""
    rows = numeric_matrix(df, numeric)
    texts = [c for stage in fitted.stages if isinstance(stage, StringIndexerModel) and stage.isSet("inputCols") for c in stage.getInputCols()]
    rows = rows.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else rows
    return reduce(lambda x, stage: stage.transform(x), steps, rows)


def predicted(df: DataFrame, fitted: PipelineModel | ExtraTrees, numeric: list[str]) -> DataFrame:
    """``df`` with predicted_class."""
    if isinstance(fitted, ExtraTrees):
        rows = numeric_matrix(df, numeric)
        return fitted.transform(rows.withColumns({c: F.col(c).cast("string") for c in fitted.categorical}))
    rows = _prepared(df, fitted, numeric, fitted.stages[1:])
    return IndexToString(inputCol="prediction", outputCol="predicted_class", labels=fitted.stages[0].labels).transform(rows)


def cross_validate(df: DataFrame, numeric: list[str], categorical: list[str], label: str, key: str = "event_id", fold: str = "cv_fold", model: str = "rf", k: int = 5, jobs: int = 5, ready: list[tuple[DataFrame, PipelineModel]] | None = None, also: list[str] | None = None, **how) -> DataFrame:
    """Out-of-fold predictions (key, label, fold, predicted_class); everything is fitted on the other folds only, ``jobs`` folds at a time.  ``ready`` has the rows and first steps of each
    fold's ``fit``, and ``also`` the further numeric columns that those know."""

    def one(i: int) -> DataFrame:
        fitted = fit(df.filter(F.col(fold) != i), numeric, categorical, label, model, ready and ready[i], **how)
        return materialize(predicted(df.filter(F.col(fold) == i), fitted, [*numeric, *(also or [])]).select(key, label, fold, "predicted_class"))

    with ThreadPoolExecutor(jobs) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(k)))


#: Settings of the families in the comparison (fixed values).
FAMILIES = {"rf": {"trees": 100, "depth": 6}, "extra": {"trees": 100, "depth": 6}, "gbt": {"rounds": 100}}


def experiments(df: DataFrame, manifests: dict[str, tuple[list[str], list[str]]], label: str, key: str = "event_id", families: dict[str, dict] = FAMILIES, k: int = 5) -> DataFrame:
    """Out-of-fold predictions (experiment, model_name, key, label, cv_fold, predicted_class) of each family on each manifest's columns, all over the same folds.

    Weights, medians and categories of a fold's rows depend on no manifest or family, so they are worked out once for all, unless a column is numeric in one manifest and not in another.
    """
    folded = materialize(folds(df, label, key, k))
    numbers, texts = ([*dict.fromkeys(c for m in manifests.values() for c in m[i])] for i in (0, 1))
    shared = not set(numbers) & set(texts)

    def first_steps(i: int) -> tuple[DataFrame, PipelineModel]:
        rows = weighted(folded.filter(F.col("cv_fold") != i), numbers, texts, label)
        return rows, Pipeline(stages=stages(numbers, texts, label, None)[:-1]).fit(spread(rows))

    with ThreadPoolExecutor(k) as pool:
        ready = [*pool.map(first_steps, range(k))] if shared else None
    parts = []
    for name, (numeric, categorical) in manifests.items():
        for family, how in families.items():
            oof = cross_validate(folded, numeric, categorical, label, key, model=family, k=k, ready=ready, also=[c for c in numbers if c not in numeric] if shared else None, **how)
            parts.append(oof.select(F.lit(name).alias("experiment"), F.lit(family).alias("model_name"), *oof.columns))
    return reduce(DataFrame.unionByName, parts)


def compared(oof: DataFrame, label: str, baseline: str, wanted: str = "Industrial Thermal Activity") -> DataFrame:
    """A row for each experiment and family from its out-of-fold rows: summary metrics, their spread over the folds, those of the class ``wanted``, differences to the
    same family on ``baseline``, and which one is selected: by macro F1, then balanced accuracy, then recall of ``wanted``."""
    by = ["experiment", "model_name"]
    whole = summary_metrics(oof, label, "predicted_class", by)
    spread_of = summary_metrics(oof, label, "predicted_class", [*by, "cv_fold"]).groupBy(*by).agg(F.round(F.avg("macro_f1"), 6).alias("macro_f1_cv_mean"), F.round(F.stddev_samp("macro_f1"), 6).alias("macro_f1_cv_std"))
    is_, said = F.col(label) == wanted, F.col("predicted_class") == wanted
    one = oof.groupBy(*by).agg(F.count_if(is_ & said).alias("tp"), F.count_if(is_).alias("s"), F.count_if(said).alias("q"))
    share = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    one = one.select(*by, share(F.col("tp"), F.col("s")).alias("industrial_recall"), share(F.col("tp"), F.col("q")).alias("industrial_precision"), share(2.0 * F.col("tp"), F.col("s") + F.col("q")).alias("industrial_f1"))
    results = compared_to(whole.join(spread_of, by).join(one, by), baseline, column="experiment")
    best = best_model(results).select(*by, F.lit(True).alias("selected"))
    return results.join(F.broadcast(best), by, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def confusion(df: DataFrame, label: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row per true class, one column per predicted class, fixed order."""
    base = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], "class_no int, true_class string")
    counts = df.groupBy(F.col(label).alias("true_class")).agg(*(F.count_if(F.col(predicted) == c).alias(f"pred_{i}") for i, c in enumerate(classes)))
    return base.join(counts, "true_class", "left").fillna(0)


def class_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined."""
    hits = df.filter(F.col(label) == F.col(predicted)).groupBy(F.col(label).alias("c")).agg(F.count("*").alias("tp"))
    true, said = (df.groupBy(F.col(c).alias("c")).agg(F.count("*").alias(n)) for c, n in ((label, "support"), (predicted, "predicted")))
    x = true.join(said, "c", "full").join(hits, "c", "left").fillna(0)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted"))
    return x.select(F.col("c").alias("class"), "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def summary_metrics(df: DataFrame, label: str, predicted: str, by: str | list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1, over all or by fold or other columns."""
    keys = [by] if isinstance(by, str) else by or []
    cls = df.select(*keys, F.explode(F.array_distinct(F.array(label, predicted))).alias("c"), F.col(label).alias("y"), F.col(predicted).alias("p"))
    per = cls.groupBy(*keys, "c").agg(F.count_if((F.col("y") == F.col("c")) & (F.col("p") == F.col("c"))).alias("tp"), F.count_if(F.col("y") == F.col("c")).alias("s"), F.count_if(F.col("p") == F.col("c")).alias("q"))
    f1, recall = 2.0 * F.col("tp") / (F.col("s") + F.col("q")), F.col("tp") / F.nullif(F.col("s"), F.lit(0))
    return per.groupBy(*keys).agg(F.round(F.sum("tp") / F.sum("s"), 6).alias("accuracy"), F.round(F.avg(recall), 6).alias("balanced_accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"))


def fold_spread(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """A33."""
    return metrics.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def best_model(results: DataFrame, order: tuple[str, ...] = ("macro_f1", "balanced_accuracy", "industrial_recall")) -> DataFrame:
    """K7: ties by name."""
    return results.orderBy(*(F.desc(c) for c in order), "model_name").limit(1)


def compared_to(results: DataFrame, baseline: str, metrics: tuple[str, ...] = ("macro_f1", "balanced_accuracy"), column: str = "features") -> DataFrame:
    """Differences to the baseline feature set of the same model."""
    b = results.filter(F.col(column) == baseline).select("model_name", *(F.col(m).alias(f"_{m}") for m in metrics))
    return results.join(b, "model_name", "left").withColumns({f"{m}_delta": F.round(F.col(m) - F.col(f"_{m}"), 6) for m in metrics}).drop(*(f"_{m}" for m in metrics))


def importances(fitted: PipelineModel, frame: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` features of a forest with the names of one-hot columns."""
    attrs = [a for group in frame.schema["_features"].metadata["ml_attr"]["attrs"].values() for a in group]
    values = fitted.stages[-1].featureImportances.toArray()
    rows = [(a["name"], float(values[a["idx"]])) for a in attrs]
    return frame.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def errors(oof: DataFrame, features: DataFrame, label: str, key: str = "event_id") -> DataFrame:
    """Wrong out-of-fold predictions with the features that explain them."""
    wrong = oof.filter(F.col(label) != F.col("predicted_class"))
    return wrong.join(features.drop(label), key, "left")


def argmax_class(columns: list[str], names: list[str]) -> Column:
    """Q6: the name of the largest column, the first of equals."""
    return F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(F.array(*columns), F.greatest(*columns)).cast("int"))
