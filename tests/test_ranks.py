"""Ranks and quantiles of large groups against plain Python."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from emberline.operators.ranks import exact_quantiles, ranks_within


def test_ranks_within_groups(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(7)
    got = {x.k: (x["rank"], x.n) for x in ranks_within(df, ["g"], [F.desc("v"), F.asc("k")], total="n").collect()}
    groups = defaultdict(list)
    for k, g, v in rows:
        groups[g].append((-v, k))
    want = {k: (i + 1, len(own)) for own in groups.values() for i, (_, k) in enumerate(sorted(own))}
    assert got == want
    whole = {x.k: x["rank"] for x in ranks_within(df, [], [F.asc("v"), F.asc("k")]).collect()}
    assert whole == {k: i + 1 for i, (_, k) in enumerate(sorted((v, k) for k, _, v in rows))}


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(2)
    rows = [("a", float(x)) for x in r.normal(size=301)] + [("b", 5.0)] * 200 + [("b", float(x)) for x in range(100)] + [("c", 1.5), ("d", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = {x.g: x.quantiles for x in exact_quantiles(df, "v", shares, ["g"]).collect()}
    own = defaultdict(list)
    for g, v in rows:
        if v is not None:
            own[g].append(v)
    assert got.keys() == own.keys() and all(np.allclose(got[g], np.quantile(own[g], shares)) for g in own)
    assert np.allclose(exact_quantiles(df, "v", shares).first()["quantiles"], np.quantile([v for _, v in rows if v is not None], shares))
    assert exact_quantiles(df.limit(0), "v", shares).first()["quantiles"] == [None] * 5 and exact_quantiles(df.limit(0), "v", shares, ["g"]).count() == 0


def test_no_task_holds_a_class(spark):
    import __spark_entry__ as entry

    for name in ("w8_a9_folds", "k13_holdout"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x and "row_number" in x]
        assert windows and all("_part" in x for x in windows)
    plan = entry.queries()["k5_s16_extremes_per_class"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after each shuffle
