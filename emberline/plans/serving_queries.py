"""Queries over curated and served tables: scores, ranks, batches, review labels, dashboard, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import labels as lb
from emberline.operators import curation, features, quality, report, serve, spatial
from emberline.plans.detection_queries import CELLS, CLEAN, COVER, DAYS, LAND, near_sql, celled, clean, contextual, haversine_sql, with_facility
from emberline.plans.registry import Tables, query
from emberline.sources.shared import materialize

CLASS_SQL = ("Agricultural Burning", "Industrial Thermal Activity", "Natural / Wildfire / Other")
PROBS = ("p_agricultural", "p_industrial", "p_natural")
HR = ", hr AS (SELECT event_id, MIN(d_hr) AS distance_m FROM (SELECT d.event_id, " + near_sql().split("f.relevance_tier, ")[1].split(" AS distance_m")[0] + " AS d_hr FROM clean d CROSS JOIN facilities f WHERE f.relevance_tier = 'HIGHER_RELEVANCE') GROUP BY event_id)"
SCORE = CLEAN + near_sql() + HR + LAND + """, g AS (SELECT event_id, CAST(COUNT(*) OVER (PARTITION BY ROUND_EVEN(latitude / CAST(0.01 AS DOUBLE), 0), ROUND_EVEN(longitude / CAST(0.01 AS DOUBLE), 0)) AS DOUBLE) AS gc FROM clean),
  parts AS (SELECT d.event_id, d.frp, d.acq_date, d.latitude, d.longitude, g.gc, n.distance_m AS d_any, h.distance_m AS d_hr, l.landcover_class FROM clean d JOIN g ON g.event_id = d.event_id LEFT JOIN near n ON n.event_id = d.event_id LEFT JOIN hr h ON h.event_id = d.event_id JOIN landed l ON l.event_id = d.event_id),
  span AS (SELECT MIN(frp) AS f0, MAX(frp) AS f1, MIN(gc) AS g0, MAX(gc) AS g1 FROM parts),
  scores AS (SELECT p.*, GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), CAST(0.30 AS DOUBLE) * ((frp - f0) / (f1 - f0 + CAST(1e-9 AS DOUBLE))) + CAST(0.35 AS DOUBLE) * (1 - LEAST(COALESCE(d_hr, 50000), CAST(50000 AS DOUBLE)) / 50000) + CAST(0.10 AS DOUBLE) * (1 - LEAST(COALESCE(d_any, 50000), CAST(50000 AS DOUBLE)) / 50000)
    + CAST(0.15 AS DOUBLE) * ((gc - g0) / (g1 - g0 + CAST(1e-9 AS DOUBLE))) + CAST(CASE landcover_class WHEN 'Built-up' THEN 0.10 WHEN 'Shrubland' THEN 0.05 WHEN 'Grassland' THEN 0.05 WHEN 'Cropland' THEN 0.07 WHEN 'Tree cover' THEN 0.03 ELSE 0 END AS DOUBLE))) AS score FROM parts p CROSS JOIN span)"""  # fmt: skip


def scored(t: Tables) -> DataFrame:
    """Clean detections with their candidate score."""
    out = features.rows_per_rounded_cell(features.sample_landcover(with_facility(t), t("landcover_cells")))
    return materialize(curation.candidate_score(materialize(out)))


def dashboard(t: Tables) -> DataFrame:
    """Events with predictions, tiers and flags as the dashboard serves them."""
    p = t("predictions").withColumns({"max_probability": F.round(F.greatest(*PROBS), 4), "ml_confidence": lb.confidence_tier(F.greatest(*PROBS))})
    frp = F.when(F.col("event_id") % 97 != 0, F.col("frp"))
    d = t("detections").select("event_id", "latitude", "longitude", frp.alias("frp"), F.col("confidence").alias("firms_confidence"), (F.col("event_id") % 3 == 0).cast("int").alias("persistent_location_flag"))
    return serve.with_predictions(d, p)


DASH = """, dash AS (SELECT d.event_id, CASE WHEN d.event_id % 97 <> 0 THEN d.frp END AS frp, d.confidence AS firms_confidence, CAST(CASE WHEN d.event_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS persistent_location_flag, p.predicted_class, ROUND(GREATEST(p_agricultural, p_industrial, p_natural), 4) AS max_probability,
  CASE WHEN ROUND(GREATEST(p_agricultural, p_industrial, p_natural), 4) >= 0.75 THEN 'HIGH' WHEN ROUND(GREATEST(p_agricultural, p_industrial, p_natural), 4) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS ml_confidence FROM detections d LEFT JOIN predictions p ON d.event_id = p.event_id)"""
FACETS = serve.Facets({"predicted_class": CLASS_SQL[:2], "ml_confidence": ("HIGH", "MEDIUM"), "firms_confidence": ()}, True, 1.0, 20.0)
FACET_SQL = " WHERE predicted_class IN ('Agricultural Burning', 'Industrial Thermal Activity') AND ml_confidence IN ('HIGH', 'MEDIUM') AND persistent_location_flag = 1 AND NOT COALESCE(frp < 1 OR frp > 20, FALSE)"


# ------------------------------------------------------------- scores, ranks, batches
@query("m34_m49_m50_candidate_score", "detections facilities landcover_cells", SCORE + " SELECT event_id, ROUND(score, 6) AS score FROM scores")
def _(t):
    return scored(t).select("event_id", F.round("candidate_priority_score", 6).alias("score"))


@query("w2_global_rank", "detections facilities landcover_cells", SCORE + " SELECT event_id, ROW_NUMBER() OVER (ORDER BY ROUND(score, 6) DESC, event_id) AS rank FROM scores")
def _(t):
    x = scored(t).select("event_id", F.round("candidate_priority_score", 6).alias("s"))
    return curation.global_rank(x, [F.desc("s"), F.asc("event_id")]).select("event_id", "rank")


@query("k1_sorted_events", "detections", CLEAN + " SELECT event_id, acq_date FROM clean ORDER BY acq_date, event_id")
def _(t):
    return clean(t).select("event_id", "acq_date").orderBy("acq_date", "event_id")


@query("k2_top_by_score", "detections facilities landcover_cells", SCORE + " SELECT event_id, ROUND(score, 6) AS score FROM scores WHERE d_hr <= 2000 ORDER BY ROUND(score, 6) DESC, event_id LIMIT 25")
def _(t):
    x = scored(t).filter("distance_to_higher_relevance_m <= 2000").select("event_id", F.round("candidate_priority_score", 6).alias("score"))
    return x.orderBy(F.desc("score"), "event_id").limit(25)


@query("k3_u2_pools")
def _(t):
    return curation.pools(scored(t))


@query("k3_best_pools", "detections facilities landcover_cells", SCORE + """, a AS (SELECT event_id FROM scores WHERE COALESCE(d_hr, 999999) <= 2000 ORDER BY ROUND(score, 6) DESC, event_id LIMIT 25), b AS (SELECT event_id FROM scores WHERE COALESCE(d_any, 999999) <= 2000 ORDER BY ROUND(score, 6) DESC, event_id LIMIT 15),
  c AS (SELECT event_id FROM scores ORDER BY frp DESC, event_id LIMIT 20) SELECT event_id, MIN(s) AS stratum FROM (SELECT event_id, 'A' AS s FROM a UNION ALL SELECT event_id, 'B' FROM b UNION ALL SELECT event_id, 'C' FROM c) GROUP BY event_id""")  # fmt: skip
def _(t):
    return curation.pools(scored(t).withColumn("candidate_priority_score", F.round("candidate_priority_score", 6)), names="ABC")


@query("k4_quintile_best", "detections facilities landcover_cells", SCORE + """, q AS (SELECT QUANTILE_CONT(latitude, [0.2, 0.4, 0.6, 0.8]) AS a, QUANTILE_CONT(longitude, [0.2, 0.4, 0.6, 0.8]) AS o FROM scores),
  b AS (SELECT event_id, ROUND(score, 6) AS s, (latitude > q.a[1])::INT + (latitude > q.a[2])::INT + (latitude > q.a[3])::INT + (latitude > q.a[4])::INT AS y, (longitude > q.o[1])::INT + (longitude > q.o[2])::INT + (longitude > q.o[3])::INT + (longitude > q.o[4])::INT AS x FROM scores CROSS JOIN q)
  SELECT event_id FROM (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY y, x ORDER BY s DESC, event_id) AS r FROM b) WHERE r = 1""")  # fmt: skip
def _(t):
    x = scored(t).withColumn("candidate_priority_score", F.round("candidate_priority_score", 6))
    return curation.geographic_best(x).select("event_id")


@query("k6_diverse_batch")
def _(t):
    return curation.diverse_batch(scored(t))


@query("k5_s16_extremes_per_class", "detections predictions", DASH + """ SELECT event_id, predicted_class FROM (SELECT event_id, predicted_class, ROW_NUMBER() OVER (PARTITION BY predicted_class ORDER BY max_probability DESC, event_id) AS a, ROW_NUMBER() OVER (PARTITION BY predicted_class ORDER BY max_probability, event_id) AS b FROM dash) WHERE a <= 15 OR b <= 10""")
def _(t):
    return curation.extremes_per_class(dashboard(t)).select("event_id", "predicted_class")


def published(t: Tables) -> DataFrame:
    """Events with the published score and tier, and spatial duplicates marked."""
    x = materialize(contextual(t)).withColumn("nearest_tier", F.col("nearest_relevance_tier"))
    return materialize(spatial.spatial_duplicates(materialize(curation.published_score(x)), "published_score"))


PUBLISHED = CELLS + DAYS + near_sql() + HR + COVER + """, base AS (SELECT c.event_id, c.latitude, c.longitude, c.acq_date, c.frp, LN(1 + GREATEST(c.frp, 0)) AS lf, c.brightness - c.bright_t31 AS bd, CAST(d.active AS DOUBLE) AS ad, n.distance_m AS d_any, n.relevance_tier AS tier, h.distance_m AS d_hr, v.coverage, CASE WHEN EXTRACT(MONTH FROM c.acq_date) IN (4, 5, 10, 11) THEN 1::DOUBLE ELSE 0::DOUBLE END AS season
  FROM celled c JOIN days d ON c.cell_y = d.cell_y AND c.cell_x = d.cell_x AND EXTRACT(YEAR FROM c.acq_date) = d.y JOIN near n ON n.event_id = c.event_id LEFT JOIN hr h ON h.event_id = c.event_id JOIN covered v ON v.event_id = c.event_id),
  ranges AS (SELECT MIN(lf) AS l0, MAX(lf) AS l1, MIN(bd) AS b0, MAX(bd) AS b1, MIN(ad) AS a0, MAX(ad) AS a1 FROM base),
  pub0 AS (SELECT b.*, ROUND(0.30::DOUBLE * CASE WHEN coverage = 'COVERED' THEN 0.6::DOUBLE * (1 - LEAST(COALESCE(d_any, 50000), 50000::DOUBLE) / 50000) + 0.4::DOUBLE * CASE tier WHEN 'HIGHER_RELEVANCE' THEN 1::DOUBLE WHEN 'GENERAL_CONTEXT' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END ELSE 0.4::DOUBLE END
    + 0.25::DOUBLE * ((COALESCE((lf - l0) / (l1 - l0 + 1e-9::DOUBLE), 0) + COALESCE((bd - b0) / (b1 - b0 + 1e-9::DOUBLE), 0)) / 2) + 0.20::DOUBLE * COALESCE((ad - a0) / (a1 - a0 + 1e-9::DOUBLE), 0) + 0.15::DOUBLE * (1 - LEAST(COALESCE(d_hr, 50000), 50000::DOUBLE) / 50000) + 0.10::DOUBLE * season, 9) AS published_score FROM base b CROSS JOIN ranges),
  pub1 AS (SELECT *, CASE WHEN published_score >= 0.5 THEN 'HIGH' WHEN published_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS candidate_priority FROM pub0),
  pub AS (SELECT a.*, EXISTS (SELECT 1 FROM pub1 b WHERE b.acq_date = a.acq_date AND b.event_id <> a.event_id AND (b.published_score > a.published_score OR (b.published_score = a.published_score AND b.event_id < a.event_id)) AND ABS(a.latitude - b.latitude) < 0.06 AND """ + haversine_sql("a", "b") + """ <= 5500) AS dup FROM pub1 a)"""  # fmt: skip


@query("m35_published_score", "detections facilities tiles", PUBLISHED + " SELECT event_id, published_score, candidate_priority, dup AS is_spatial_duplicate FROM pub")
def _(t):
    return published(t).select("event_id", "published_score", "candidate_priority", "is_spatial_duplicate")


PICKS = " ".join(f"WHEN candidate_priority = '{tier}' AND landcover_class = '{cover}' THEN {n}" for n, tier, cover in ((0, "HIGH", "Built-up"), (1, "HIGH", "Cropland"), (2, "HIGH", "Tree cover"), (4, "MEDIUM", "Built-up"), (5, "MEDIUM", "Cropland"), (6, "MEDIUM", "Tree cover"), (7, "MEDIUM", "Shrubland"), (8, "LOW", "Cropland"), (9, "LOW", "Shrubland")))


@query("k9_representatives", "detections facilities tiles landcover_cells", PUBLISHED + LAND + f""", own AS (SELECT p.event_id, p.frp, p.candidate_priority, l.landcover_class FROM pub p JOIN landed l ON l.event_id = p.event_id WHERE NOT p.dup),
  picks AS (SELECT pick, MIN(event_id) AS event_id FROM (SELECT event_id, CASE {PICKS} END AS pick FROM own) WHERE pick IS NOT NULL GROUP BY pick),
  extra AS (SELECT 3 AS pick, event_id FROM own WHERE candidate_priority = 'HIGH' AND event_id NOT IN (SELECT event_id FROM picks) ORDER BY frp DESC NULLS LAST, event_id LIMIT 1), chosen AS (SELECT pick, event_id FROM picks UNION ALL SELECT pick, event_id FROM extra),
  spare AS (SELECT 99 AS pick, event_id, ROW_NUMBER() OVER (ORDER BY event_id) AS r FROM own WHERE event_id NOT IN (SELECT event_id FROM chosen))
  SELECT CAST(pick AS INTEGER) AS pick, event_id FROM chosen UNION ALL SELECT CAST(pick AS INTEGER), event_id FROM spare WHERE r <= 10 - (SELECT COUNT(*) FROM chosen)""")  # fmt: skip
def _(t):
    return curation.representatives(published(t))


STRATA = (("d_any <= 500", "facility within 500 m", 12), ("d_any <= 1000", "facility within 1 km", 12), ("d_any <= 2000", "facility within 2 km", 8), ("candidate_priority = 'HIGH'", "high tier", 10), ("coverage = 'FAILED_TILE'", "failed tile", 8), ("candidate_priority = 'MEDIUM'", "medium tier", 20), ("frp >= 5", "high power", 10), ("ad >= 3", "persistent", 10), ("frp < 1", "low power", 5), ("d_any > 10000", "remote", 5))


@query("k11_w6_strata_batch", "detections facilities tiles", PUBLISHED + ", s AS (SELECT event_id, published_score, CASE " + " ".join(f"WHEN {w} THEN {i}" for i, (w, _, _) in enumerate(STRATA)) + " END AS no FROM pub), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY no ORDER BY published_score DESC, event_id) AS r FROM s WHERE no IS NOT NULL), k AS (SELECT * FROM r WHERE r <= CASE no "
  + " ".join(f"WHEN {i} THEN {n}" for i, (_, _, n) in enumerate(STRATA)) + " END) SELECT event_id, CASE no " + " ".join(f"WHEN {i} THEN '{n}'" for i, (_, n, _) in enumerate(STRATA)) + " END AS stratum, CAST(ROW_NUMBER() OVER (ORDER BY no, r) AS INTEGER) AS selection_no FROM k")
def _(t):
    return curation.strata_batch(published(t), curation.default_strata()).select("event_id", "stratum", "selection_no")


@query("k10_greedy_diverse")
def _(t):
    return curation.greedy_diverse(published(t), {"HIGH": 20, "MEDIUM": 20, "LOW": 10}, 50)


@query("m36_rationale", "detections facilities landcover_cells", CELLS + DAYS + near_sql() + LAND + """ SELECT c.event_id, CONCAT_WS('; ', CASE WHEN c.frp >= 5 THEN 'HIGH' ELSE 'LOW' END || ' priority', CASE WHEN n.distance_m <= 2000 THEN 'industrial facility within 2 km' END, CASE WHEN c.frp >= 5 THEN 'high radiative power' END, CASE WHEN d.active >= 3 THEN 'persistent location' END, CASE WHEN l.landcover_class <> 'Unknown' THEN 'land cover: ' || l.landcover_class END) AS rationale
  FROM celled c JOIN near n ON n.event_id = c.event_id JOIN landed l ON l.event_id = c.event_id JOIN days d ON d.cell_y = c.cell_y AND d.cell_x = c.cell_x AND d.y = EXTRACT(YEAR FROM c.acq_date)""")  # fmt: skip
def _(t):
    from emberline.functions import thermal

    x = features.sample_landcover(with_facility(t), t("landcover_cells")).withColumns({"cell_y": thermal.cell_floor("latitude"), "cell_x": thermal.cell_floor("longitude"), "tier": F.when(F.col("frp") >= 5, "HIGH").otherwise("LOW")})
    x = features.grid_persistence(x)
    return x.select("event_id", lb.rationale("tier", "distance_to_facility_m", "frp", "grid_active_days", "landcover_class").alias("rationale"))


# ------------------------------------------------------------- review labels
_L = "TRIM(COALESCE(raw_label, 'None'))"
LABEL = f"""CASE {_L} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lb.ANNOTATIONS.items())} ELSE 'REVIEW_REQUIRED' END"""
REVIEWED = f""", reviewed AS (SELECT d.event_id, r.raw_label, CASE WHEN r.event_id IS NOT NULL THEN {LABEL} END AS reviewed_class FROM detections d LEFT JOIN reviewer_labels r ON d.event_id = r.event_id)"""
TARGET = "CASE " + " ".join(f"WHEN reviewed_class = '{k}' THEN '{v}'" for k, v in lb.TARGETS.items()) + " END"


@query("m27_annotations", "reviewer_labels", f""" SELECT event_id, {LABEL} AS label, {LABEL} <> 'REVIEW_REQUIRED' AS unambiguous, CASE WHEN {LABEL} <> 'REVIEW_REQUIRED' THEN 'direct match' WHEN (LOWER({_L}) LIKE '%possible%' OR LOWER({_L}) LIKE '%buring%') AND (LOWER({_L}) LIKE '%agricultural%' OR LOWER({_L}) LIKE '%argricultural%') THEN 'possible agricultural burning'
  WHEN (LOWER({_L}) LIKE '%possible%' OR LOWER({_L}) LIKE '%buring%') AND LOWER({_L}) LIKE '%forest%' THEN 'possible forest fire' WHEN LOWER({_L}) LIKE '%thermal anomaly%' THEN 'thermal anomaly at a facility, fire or operation unresolved' WHEN {_L} = 'Industrial Facility' THEN 'facility named, status not given'
  WHEN LOWER({_L}) LIKE '%scrub%' OR LOWER({_L}) LIKE '%brush%' THEN 'brush or scrub burning fits several classes' ELSE 'unrecognized annotation: ' || {_L} END AS reason FROM reviewer_labels""")  # fmt: skip
def _(t):
    return t("reviewer_labels").withColumn("l", lb.normalize_annotation("raw_label")).select("event_id", "l.*")


def reviewed(t: Tables) -> DataFrame:
    return serve.with_review(t("detections").select("event_id", "frp"), t("reviewer_labels"))


@query("j17_j18_review_merge", "detections reviewer_labels", REVIEWED + """ SELECT event_id, reviewed_class, reviewed_class IS NOT NULL AS has_review, CASE WHEN reviewed_class IS NULL THEN 'UNREVIEWED' WHEN reviewed_class = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED' ELSE 'REVIEWED' END AS review_status, COALESCE(reviewed_class <> 'REVIEW_REQUIRED', FALSE) AS ml_training_eligible FROM reviewed""")
def _(t):
    return reviewed(t).select("event_id", "reviewed_class", "has_review", "review_status", "ml_training_eligible")


@query("p19_l16_m28_cohort", "detections reviewer_labels", REVIEWED + f" SELECT event_id, {TARGET} AS target_class FROM reviewed WHERE reviewed_class <> 'REVIEW_REQUIRED'")
def _(t):
    return serve.training_cohort(reviewed(t)).select("event_id", lb.target_class("reviewed_class").alias("target_class"))


@query("a24_label_distribution", "detections reviewer_labels", REVIEWED + ", x AS (SELECT reviewed_class AS value, COUNT(*) AS n FROM reviewed WHERE reviewed_class IS NOT NULL GROUP BY 1) SELECT value, n, ROUND(100.0 * n / CAST(SUM(n) OVER () AS DOUBLE), 4) AS pct FROM x")
def _(t):
    return report.frequencies(reviewed(t).filter("has_review"), "reviewed_class")


@query("a23_review_profile", "detections reviewer_labels", REVIEWED + " SELECT COUNT(*) AS rows, COUNT(DISTINCT event_id) AS distinct_ids, COUNT(event_id) - COUNT(DISTINCT event_id) AS duplicate_ids, COUNT(*) - COUNT(event_id) AS missing_ids, COUNT(reviewed_class) AS labelled FROM reviewed")
def _(t):
    return report.dataset_profile(reviewed(t), flags={"labelled": F.col("reviewed_class").isNotNull()})


@query("a25_imbalance", "detections reviewer_labels", REVIEWED + f", c AS (SELECT {TARGET} AS k, COUNT(*) AS n FROM reviewed WHERE reviewed_class <> 'REVIEW_REQUIRED' GROUP BY 1) SELECT MAX(n) AS largest, MIN(n) AS smallest, ROUND(MAX(n) / CAST(MIN(n) AS DOUBLE), 6) AS ratio FROM c WHERE k IS NOT NULL")
def _(t):
    return report.imbalance(serve.training_cohort(reviewed(t)).withColumn("k", lb.target_class("reviewed_class")), "k")


# ------------------------------------------------------------- dashboard
@query("j19_m42_predictions_merge", "detections predictions", DASH + " SELECT event_id, predicted_class, max_probability, ml_confidence FROM dash")
def _(t):
    return dashboard(t).select("event_id", "predicted_class", "max_probability", "ml_confidence")


@query("p11_facet_filter", "detections predictions", DASH + " SELECT event_id, frp FROM dash" + FACET_SQL)
def _(t):
    return serve.facet_filter(dashboard(t), FACETS).select("event_id", "frp")


KPI = """ SELECT COUNT(*) AS total, COUNT(CASE WHEN predicted_class = 'Agricultural Burning' THEN 1 END) AS agricultural, COUNT(CASE WHEN predicted_class = 'Industrial Thermal Activity' THEN 1 END) AS industrial, COUNT(CASE WHEN predicted_class = 'Natural / Wildfire / Other' THEN 1 END) AS "natural",
  COUNT(CASE WHEN ml_confidence = 'HIGH' THEN 1 END) AS high_confidence, COALESCE(ROUND(SUM(COALESCE(frp, 0)) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE), 2), 0) AS avg_frp FROM dash"""


@query("a19_kpis", "detections predictions", DASH + KPI + FACET_SQL)
def _(t):
    return serve.kpis(serve.facet_filter(dashboard(t), FACETS))


@query("s17_point_lookup", "detections predictions", DASH + " SELECT event_id, ml_confidence FROM dash WHERE event_id % 500 = 7")
def _(t):
    d = dashboard(t)
    found, _missing = serve.lookup(d, d.filter("event_id % 500 = 7"))
    return found.select("event_id", "ml_confidence")


@query("p14_s18_dashboard_parse", "detections predictions", DASH + """, raw AS (SELECT d.event_id, d.latitude, d.longitude, d.event_id % 13 AS k, s.predicted_class, d.frp FROM detections d JOIN dash s ON d.event_id = s.event_id)
  SELECT CASE WHEN k = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN k = 1 THEN NULL ELSE latitude END AS latitude, CASE WHEN k = 2 THEN NULL ELSE frp END AS frp, CASE WHEN k = 3 THEN NULL WHEN k = 4 THEN NULL ELSE 'Plant ' || k END AS nearest_facility_name, k IN (5, 6) AS has_human_validation,
  CASE WHEN k = 0 THEN 'missing event_id' WHEN k = 1 THEN 'invalid coordinates' WHEN latitude < 8 OR latitude > 14 OR longitude < 76 OR longitude > 81.5 THEN 'coordinates out of bounds' WHEN k = 7 THEN 'invalid predicted_class' WHEN k = 2 THEN 'missing frp' END AS reject_reason FROM raw""")  # fmt: skip
def _(t):
    x = t("detections").join(dashboard(t).select("event_id", "predicted_class"), "event_id").withColumn("k", F.col("event_id") % 13)
    k, text = F.col("k"), lambda c: F.col(c).cast("string")
    raw = x.select(
        F.when(k == 0, " ").otherwise(text("event_id")).alias("event_id"), F.when(k == 1, "abc").otherwise(text("latitude")).alias("latitude"), text("longitude").alias("longitude"), F.when(k == 2, "N/A").otherwise(text("frp")).alias("frp"),
        F.when(k == 7, "Volcano").otherwise(F.col("predicted_class")).alias("predicted_class"), F.lit("").alias("firms_confidence"), F.lit(None).cast("string").alias("ml_confidence"), F.lit("").alias("landcover_class"), F.lit("").alias("nearest_facility_tier"),
        F.when(k == 3, "NaN").when(k == 4, " none ").otherwise(F.concat(F.lit(" Plant "), k)).alias("nearest_facility_name"), F.lit("1").alias("persistent_location_flag"), F.when(k == 5, "Yes").when(k == 6, "1").otherwise("no").alias("has_human_validation"), F.lit("N/A").alias("s2_dnbr_mean"),
    )
    return quality.parse_dashboard(raw).select("event_id", "latitude", "frp", "nearest_facility_name", "has_human_validation", "reject_reason")


@query("p15_p16_p17_contract", "detections", "SELECT event_id AS id, frp, 'v1' AS model_version FROM detections")
def _(t):
    x = serve.provenance(t("detections").withColumn("raw_label", F.lit("x")), {"event_id": "id"}, {"model_version": "v1"}, ("raw_label",))
    return quality.contract(x, ["id", "frp", "model_version"])


@query("s13_geojson", "detections", CLEAN + """ SELECT COUNT(*) AS features, COUNT(CASE WHEN event_id % 2 = 0 THEN 1 END) AS even FROM clean""")
def _(t):
    from emberline.sources.files import geojson_lines

    lines = geojson_lines(clean(t).select("event_id", "latitude", "longitude", "frp"))
    p = F.from_json("value", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<event_id:long,frp:double>")
    back = lines.select(p.alias("f")).filter("f.type = 'Feature' and size(f.geometry.coordinates) = 2")
    return back.agg(F.count("*").alias("features"), F.count_if(F.col("f.properties.event_id") % 2 == 0).alias("even"))


# ------------------------------------------------------------- audits
@query("j26_parity", "predictions", "SELECT COUNT(*) AS compared, COUNT(CASE WHEN event_id % 50 = 0 AND predicted_class <> 'Agricultural Burning' THEN 1 END) AS differing, ROUND(COUNT(CASE WHEN event_id % 50 = 0 AND predicted_class <> 'Agricultural Burning' THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) AS rate FROM predictions")
def _(t):
    p = t("predictions")
    return serve.parity(p, p.withColumn("predicted_class", F.when(F.col("event_id") % 50 == 0, "Agricultural Burning").otherwise(F.col("predicted_class"))))


@query("u3_q2_id_differences", "detections", "SELECT event_id, 'left only' AS side FROM detections WHERE event_id % 100 = 1 UNION ALL SELECT -event_id, 'right only' FROM detections WHERE event_id % 100 = 2")
def _(t):
    ids = t("detections").select("event_id")
    right = ids.filter("event_id % 100 <> 1").union(ids.filter("event_id % 100 = 2").select((-F.col("event_id")).alias("event_id")))
    return quality.id_differences(ids, right)


@query("q1_q4_expectations", "detections", "SELECT 'row_count' AS name, COUNT(*) AS observed, (SELECT COUNT(*) FROM events) AS expected, COUNT(*) = (SELECT COUNT(*) FROM events) AS passed FROM detections UNION ALL SELECT 'duplicate_keys', COUNT(event_id) - COUNT(DISTINCT event_id), 0, COUNT(event_id) = COUNT(DISTINCT event_id) FROM detections UNION ALL SELECT 'missing_keys', COUNT(*) - COUNT(event_id), 0, COUNT(*) = COUNT(event_id) FROM detections UNION ALL SELECT 'null_brightness', COUNT(*) - COUNT(brightness), 0, COUNT(*) = COUNT(brightness) FROM detections")
def _(t):
    return quality.expectations(t("detections"), "event_id", t("events").count(), ("brightness",))


@query("q3_q7_preserved_fields", "detections", "SELECT 'frp' AS field, COUNT(*) AS compared, COUNT(CASE WHEN event_id % 10 = 0 THEN 1 END) AS differing, MAX(CASE WHEN event_id % 10 = 0 THEN ABS(frp - (frp + 1)) ELSE 0 END) AS largest FROM detections UNION ALL SELECT 'daynight', COUNT(*), 0, NULL FROM detections")
def _(t):
    d = t("detections").select("event_id", "frp", "daynight")
    return quality.preserved_fields(d, d.withColumn("frp", F.when(F.col("event_id") % 10 == 0, F.col("frp") + 1).otherwise(F.col("frp"))), "event_id", ["frp", "daynight"])


@query("q5_q6_probability_audit", "predictions", "SELECT COUNT(*) AS rows, COUNT(CASE WHEN ABS(p_agricultural + p_industrial + p_natural - 1) > 0.001 THEN 1 END) AS bad_sums, " + ", ".join(f"COUNT(*) - COUNT({c}) AS {c}_nulls, COUNT(CASE WHEN {c} < 0 OR {c} > 1 THEN 1 END) AS {c}_out_of_range, ROUND(MIN({c}), 9) AS {c}_min, ROUND(MAX({c}), 9) AS {c}_max" for c in PROBS) + ", COUNT(CASE WHEN predicted_class <> CASE WHEN p_agricultural >= p_industrial AND p_agricultural >= p_natural THEN 'Agricultural Burning' WHEN p_industrial >= p_natural THEN 'Industrial Thermal Activity' ELSE 'Natural / Wildfire / Other' END THEN 1 END) AS argmax_mismatches FROM predictions")
def _(t):
    return quality.probability_audit(t("predictions"), list(PROBS), "predicted_class", CLASS_SQL)


@query("q9_fingerprint")
def _(t):
    return quality.fingerprint(t("detections"))


@query("q11_binary_columns", "detections predictions", DASH + " SELECT 'persistent_location_flag' AS field, COUNT(CASE WHEN persistent_location_flag NOT IN (0, 1) THEN 1 END) AS other_values FROM dash")
def _(t):
    return quality.binary_only(dashboard(t), ["persistent_location_flag"])


@query("l15_invalid_fields", "detections", "SELECT event_id, CASE WHEN brightness IS NULL AND daynight = 'D' THEN 'brightness' WHEN brightness IS NULL THEN 'brightness,daynight' WHEN daynight = 'D' THEN '' ELSE 'daynight' END AS bad FROM detections")
def _(t):
    x = t("detections").select("event_id", F.col("brightness").cast("string").alias("brightness"), F.col("acq_time").cast("string").alias("acq_time"), "daynight")
    return quality.invalid_fields(x, ["brightness"], ["acq_time"], {"daynight": ("D",)}).select("event_id", F.concat_ws(",", "invalid_fields").alias("bad"))
