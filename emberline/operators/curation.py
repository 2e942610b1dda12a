"""Candidate scores, rankings and review batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import labels as lb
from emberline.operators.ranks import exact_quantiles, ranks_within
from emberline.sources.shared import shared_folder, union_all

#: Rare land covers, and below the weights, quotas and budgets of the published selections.
RARE_COVERS = ("Mangroves", "Permanent water bodies", "Bare/sparse vegetation")
SEED = 42


def candidate_score(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Weighted score of power, proximity, persistence and land cover, between 0 and 1."""
    filled = df.withColumns({"_f": F.coalesce("frp", F.lit(0.0)), "_g": F.coalesce(F.col("grid_count").cast("double"), F.lit(1.0))})
    span = filled.agg(F.min("_f").alias("_f0"), F.max("_f").alias("_f1"), F.min("_g").alias("_g0"), F.max("_g").alias("_g1"))
    score = (
        0.30 * lb.minmax("_f", "_f0", "_f1") + 0.35 * lb.proximity("distance_to_higher_relevance_m") + 0.10 * lb.proximity("distance_to_facility_m")
        + 0.15 * lb.minmax("_g", "_g0", "_g1") + lb.landcover_bonus("landcover_class")
    )
    out = filled.crossJoin(F.broadcast(span)).withColumn("candidate_priority_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return out.drop("_f", "_g", "_f0", "_f1", "_g0", "_g1")


def published_score(df: DataFrame) -> DataFrame:
    """The published weights 30/25/20/15/10 with its tier; needs minmax-able log_frp and brightness_difference, coverage, tier and distances."""
    span = df.agg(*(f(c).alias(f"_{c}_{n}") for c in ("log_frp", "brightness_difference", "grid_active_days") for n, f in (("lo", F.min), ("hi", F.max))))
    x = df.crossJoin(F.broadcast(span))
    part = lambda c: F.coalesce(lb.minmax(c, f"_{c}_lo", f"_{c}_hi"), F.lit(0.0))
    tier = F.when(F.col("nearest_tier") == "HIGHER_RELEVANCE", 1.0).when(F.col("nearest_tier") == "GENERAL_CONTEXT", 0.5).otherwise(0.3)
    context = F.when(F.col("coverage") == "COVERED", 0.6 * lb.proximity("distance_to_facility_m") + 0.4 * tier).otherwise(0.4)
    thermal = (part("log_frp") + part("brightness_difference")) / 2
    season = F.coalesce(F.col("is_stubble_burning_season"), F.lit(0)).cast("double")
    score = 0.30 * context + 0.25 * thermal + 0.20 * part("grid_active_days") + 0.15 * lb.proximity("distance_to_higher_relevance_m") + 0.10 * season
    return x.withColumn("published_score", F.round(score, 9)).withColumn("candidate_priority", lb.published_tier("published_score")).select(*df.columns, "published_score", "candidate_priority")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense unique ranks over a whole table without bringing it to one task; ``order`` must end with a unique key."""
    return ranks_within(df, [], order, name)


def seeded_order(key: str = "event_id", seed: int = SEED) -> Column:
    """A reproducible shuffle: order by a hash of the key."""
    return F.xxhash64(F.col(key), F.lit(seed))


def pools(df: DataFrame, key: str = "event_id", names: str = "ABCDEFG") -> DataFrame:
    """(key, stratum) of the seven pools, or those named, each row in the first that takes it.

    Pools A-C take the best by score or power, D-F seeded samples by land cover, G of ambiguous rows.
    """
    far = F.coalesce(F.col("distance_to_facility_m"), F.lit(999_999.0))
    median = exact_quantiles(df, "frp", [0.5]).first()["quantiles"][0] or 0.0
    best, power, shuffled = [F.desc("candidate_priority_score"), F.asc(key)], [F.desc("frp"), F.asc(key)], [seeded_order(key), F.asc(key)]
    takes = [
        ("A", F.coalesce(F.col("distance_to_higher_relevance_m"), F.lit(999_999.0)) <= 2000, best, 25), ("B", far <= 2000, best, 15), ("C", F.lit(True), power, 20),
        ("D", F.col("landcover_class") == "Built-up", shuffled, 10), ("E", F.col("landcover_class").isin("Cropland", "Grassland"), shuffled, 10),
        ("F", F.col("landcover_class").isin("Tree cover", "Shrubland"), shuffled, 8), ("G", F.col("frp").between(median * 0.5, median * 2.0) & (far > 2000) & (far <= 10_000), shuffled, 8),
    ]
    parts = [df.filter(where).orderBy(*order).limit(n).select(key, F.lit(name).alias("stratum")) for name, where, order, n in takes if name in names]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min("stratum").alias("stratum"))


def geographic_best(df: DataFrame, key: str = "event_id") -> DataFrame:
    """K4: the best row of each latitude and longitude quintile (right-closed, equal edges dropped)."""
    found = {c: exact_quantiles(df, c, [0.2, 0.4, 0.6, 0.8]).first() for c in ("latitude", "longitude")}
    edges = {c: sorted({e for e in r["quantiles"] if e is not None}) for c, r in found.items()}
    bucket = lambda c: reduce(lambda a, b: a + b, (F.when(F.col(c) > e, 1).otherwise(0) for e in edges[c]), F.lit(0))
    best = df.groupBy(bucket("latitude").alias("_a"), bucket("longitude").alias("_o")).agg(F.min(F.struct((-F.col("candidate_priority_score")).alias("s"), F.col(key).alias("k"))).alias("_b"))
    return best.select(F.col("_b.k").alias(key), F.lit("H").alias("stratum"), (-F.col("_b.s")).alias("candidate_priority_score"))


def diverse_batch(df: DataFrame, target: int = 100, key: str = "event_id") -> DataFrame:
    """Pools, then quintile cells while the batch isn't full, then the global ranking up to ``target`` rows; (key, stratum)."""
    batch = pools(df, key)
    room = max(0, target - batch.count())
    cells = geographic_best(df, key).join(batch, key, "left_anti").orderBy(F.desc("candidate_priority_score"), key).limit(room).select(key, "stratum")
    batch = batch.unionByName(cells)
    room = max(0, target - batch.count())
    rest = df.join(batch, key, "left_anti").orderBy(F.desc("candidate_priority_score"), key).limit(room).select(key, F.lit("TOP-UP").alias("stratum"))
    return batch.unionByName(rest)


def extremes_per_class(df: DataFrame, label: str = "predicted_class", score: str = "max_probability", key: str = "event_id", top: int = 15, bottom: int = 10) -> DataFrame:
    """The surest and the least sure rows of each class, each row once, with the ranks for which it was taken."""
    w = Window.partitionBy(label)
    ends = []
    for name, order, n in (("rank_down", F.desc(score), top), ("rank_up", F.asc(score), bottom)):  # each task sends so many rows of a class at most
        ends.append(df.withColumn(name, F.row_number().over(w.orderBy(order, key))).filter(F.col(name) <= n))
    rows = union_all(ends)
    return rows.groupBy(*df.columns).agg(F.max("rank_down").alias("rank_down"), F.max("rank_up").alias("rank_up"))


def representatives(df: DataFrame, n: int = 10, key: str = "event_id") -> DataFrame:
    """K9: (key, pick) of one row per tier and land cover, a further HIGH one by power, filled to ``n`` in key order; spatial duplicates are left out."""
    rules = [("HIGH", c) for c in ("Built-up", "Cropland", "Tree cover")] + [("MEDIUM", c) for c in ("Built-up", "Cropland", "Tree cover", "Shrubland")] + [("LOW", c) for c in ("Cropland", "Shrubland")]
    order = F.create_map(*(F.lit(x) for i, (t, c) in enumerate(rules) for x in (f"{t}|{c}", i if i < 3 else i + 1)))
    own = df.filter(~F.coalesce("is_spatial_duplicate", F.lit(False)))
    picks = own.withColumn("pick", F.element_at(order, F.concat_ws("|", "candidate_priority", "landcover_class"))).filter("pick is not null")
    picks = picks.groupBy("pick").agg(F.min(key).alias(key))
    extra = own.filter("candidate_priority = 'HIGH'").join(picks, key, "left_anti").orderBy(F.desc_nulls_last("frp"), key).limit(1).select(F.lit(3).alias("pick"), key)
    chosen = picks.select("pick", key).unionByName(extra)
    room = max(0, n - chosen.count())
    fill = own.join(chosen, key, "left_anti").orderBy(key).limit(room).select(F.lit(99).alias("pick"), key)
    return chosen.unionByName(fill).orderBy("pick", key).limit(n)


def strata_batch(df: DataFrame, rules: list[tuple[str, Column, int]], score: str = "published_score", key: str = "event_id") -> DataFrame:
    """Each row belongs to the first stratum whose condition holds; the best of each up to its budget, with a running number by stratum and rank."""
    chain = None
    for i, (_, where, _) in enumerate(rules):
        chain = F.when(where, i) if chain is None else chain.when(where, i)
    w = Window.partitionBy("stratum_no").orderBy(F.desc(score), key)
    budget = F.element_at(F.array(*(F.lit(n) for *_, n in rules)), F.col("stratum_no") + 1)
    picked = df.withColumn("stratum_no", chain).filter("stratum_no is not null").withColumn("stratum_rank", F.row_number().over(w))
    most = max((n for *_, n in rules), default=0)  # a plain number, so that each task sends so many rows of a stratum at most
    picked = picked.filter(F.col("stratum_rank") <= most).filter(F.col("stratum_rank") <= budget)
    names = F.element_at(F.array(*(F.lit(n) for n, *_ in rules)), F.col("stratum_no") + 1)
    number = F.row_number().over(Window.orderBy("stratum_no", "stratum_rank"))  # at most the sum of the budgets
    return picked.withColumns({"stratum": names, "selection_no": number})


def default_strata() -> list[tuple[str, Column, int]]:
    """The ten strata and budgets of the published batch."""
    d, f, a = F.col("distance_to_facility_m"), F.col("frp"), F.col("grid_active_days")
    return [
        ("facility within 500 m", d <= 500, 12), ("facility within 1 km", d <= 1000, 12), ("facility within 2 km", d <= 2000, 8), ("high tier", F.col("candidate_priority") == "HIGH", 10),
        ("failed tile", F.col("coverage") == "FAILED_TILE", 8), ("medium tier", F.col("candidate_priority") == "MEDIUM", 20), ("high power", f >= 5, 10), ("persistent", a >= 3, 10),
        ("low power", f < 1, 5), ("remote", d > 10_000, 5),
    ]


def greedy_diverse(df: DataFrame, quotas: dict[str, int], total: int = 50, key: str = "event_id", every: int = 10) -> DataFrame:
    """(key, selection_order) of a greedy choice that keeps events apart in space, time, power, land cover and persistence.

    Inherently one pick after another: ``total`` rounds, each one aggregation over the candidates.  What a candidate needs to know of the picks so far
    (nearest distance, nearest power, near-duplicate flag) is kept in columns that each pick updates; counts by category are small and stay
    on the driver.  Every ``every`` rounds the columns are checkpointed.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    cats = ("landcover_class", "month", "coverage", "persistent_location_flag")
    c = df.withColumns({"month": F.date_format("acq_date", "yyyy-MM"), "day": F.datediff("acq_date", F.lit("2024-01-01").cast("date"))})
    c = c.select(key, "latitude", "longitude", "frp", "day", *cats, "candidate_priority", F.coalesce("is_spatial_duplicate", F.lit(False)).alias("dup"), F.lit(1e9).alias("km"), F.lit(1e9).alias("gap"), F.lit(False).alias("close")).checkpoint()
    counts: dict[str, dict] = {x: {} for x in cats}
    picked: list = []

    def take(row) -> None:
        nonlocal c
        picked.append(row[key])
        for x in cats:
            counts[x][row[x]] = counts[x].get(row[x], 0) + 1
        dy, dx = (F.col("latitude") - row["latitude"]) * 111.0, (F.col("longitude") - row["longitude"]) * 108.0
        km = F.sqrt(dy * dy + dx * dx)
        c = c.filter(F.col(key) != row[key]).withColumns({"close": F.col("close") | ((km < 3.0) & (F.abs(F.col("day") - row["day"]) < 3)), "km": F.least("km", km), "gap": F.least("gap", F.abs(F.col("frp") - row["frp"]))})
        if len(picked) % every == 0:
            c = c.checkpoint()

    def seen(x: str, none: float, some: float) -> Column:
        chain = F.lit(none)
        for value, n in counts[x].items():
            chain = F.when(F.col(x).eqNullSafe(F.lit(value)), some / (1.0 + n)).otherwise(chain)
        return chain

    def best(where: Column):
        score = F.lit(100.0) if not picked else (
            seen("landcover_class", 40.0, 15.0) + 10.0 * F.least(F.col("km") / 50.0, F.lit(2.0)) + seen("month", 8.0, 8.0) + seen("coverage", 5.0, 5.0) + seen("persistent_location_flag", 5.0, 5.0)
            + 4.0 * F.least(F.col("gap") / 2.0, F.lit(2.0)) + F.when(F.col("dup"), -5.0).otherwise(5.0)
        )
        open_ = c.filter(where & (~F.col("close") | F.col("landcover_class").isin(*RARE_COVERS)))
        return open_.orderBy(F.desc(score), key).limit(1).first()

    for cover, n in zip(RARE_COVERS, (1, 1, 2), strict=True):
        for row in c.filter(F.col("landcover_class") == cover).orderBy(key).limit(n).collect():
            if len(picked) < total:
                take(row)
    tiers = {r[key]: r["candidate_priority"] for r in df.filter(F.col(key).isin(picked)).select(key, "candidate_priority").collect()}
    for tier, quota in quotas.items():
        for _ in range(quota - sum(t == tier for t in tiers.values())):
            if len(picked) >= total or (row := best(F.col("candidate_priority") == tier)) is None:
                break
            take(row)
    while len(picked) < total and (row := best(F.lit(True))) is not None:
        take(row)
    kind = dict(df.dtypes)[key]
    return df.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(picked)], f"{key} {kind}, selection_order int")
