"""Queries over image evidence: matching, pixels, change, status, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.labels import error_category
from emberline.operators import evidence, quality, recovery
from emberline.plans.detection_queries import CLEAN, clean
from emberline.plans.registry import Tables, query

PLACED = CLEAN + """, placed AS (SELECT event_id, acq_date, CAST(event_id % 25 AS INTEGER) AS tile_no FROM clean)"""
MATCH = PLACED + """, cand AS (SELECT p.event_id, CASE WHEN c.image_date < p.acq_date THEN 'pre' ELSE 'post' END AS timing, c.product_id, c.image_date, c.cloud_cover, CAST(c.image_date - p.acq_date AS INTEGER) AS days, COALESCE(c.cloud_cover <= 20, TRUE) AS usable
    FROM placed p JOIN catalogue c ON p.tile_no = c.tile_no AND ABS(c.image_date - p.acq_date) BETWEEN 1 AND 15),
  best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id, timing ORDER BY ABS(days), COALESCE(cloud_cover, 999), image_date DESC, product_id) AS r FROM cand WHERE usable) WHERE r = 1),
  counts AS (SELECT event_id, timing, COUNT(*) AS candidates, COUNT(CASE WHEN usable THEN 1 END) AS usable, MIN(cloud_cover) AS lowest_cloud FROM cand GROUP BY 1, 2),
  slots AS (SELECT event_id, timing FROM placed CROSS JOIN (VALUES ('pre'), ('post')) v(timing)),
  matched AS (SELECT s.event_id, s.timing, COALESCE(n.candidates, 0) AS candidates, COALESCE(n.usable, 0) AS usable, n.lowest_cloud, b.product_id, b.image_date, b.cloud_cover, b.days,
    CASE WHEN b.product_id IS NOT NULL THEN 'MATCHED' WHEN n.candidates > 0 THEN 'CLOUD_REJECTED' ELSE 'MISSING_PRODUCT' END AS status
    FROM slots s LEFT JOIN counts n ON s.event_id = n.event_id AND s.timing = n.timing LEFT JOIN best b ON s.event_id = b.event_id AND s.timing = b.timing)"""
VALID = "scl IN (4, 5, 6) AND b04 IS NOT NULL AND b08 IS NOT NULL AND b11 IS NOT NULL AND b12 IS NOT NULL"
SPECTRAL = f""", px AS (SELECT event_id, timing, {VALID} AS ok, b04, b08, b11, b12, CASE WHEN ABS(b08 + b04) > 1e-6 THEN (b08 - b04) / (b08 + b04) END AS ndvi, CASE WHEN ABS(b08 + b12) > 1e-6 THEN (b08 - b12) / (b08 + b12) END AS nbr,
    CASE WHEN ABS(b08 + b11) > 1e-6 THEN (b08 - b11) / (b08 + b11) END AS ndwi, CASE WHEN ABS(b11) > 1e-6 THEN b12 / b11 END AS swir_ratio FROM pixels),
  feat AS (SELECT event_id, timing, COUNT(*) AS total_pixels, COUNT(CASE WHEN ok THEN 1 END) AS valid_pixels, ROUND(100.0 * COUNT(CASE WHEN ok THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 2) AS valid_pct,
    {", ".join(f"AVG(CASE WHEN ok THEN {c} END) AS {c}_mean, MEDIAN(CASE WHEN ok THEN {c} END) AS {c}_median, STDDEV_POP(CASE WHEN ok THEN {c} END) AS {c}_std, MIN(CASE WHEN ok THEN {c} END) AS {c}_min, MAX(CASE WHEN ok THEN {c} END) AS {c}_max" for c in ("ndvi", "nbr", "ndwi", "swir_ratio"))},
    AVG(CASE WHEN ok THEN b04 END) AS b04_mean, MEDIAN(CASE WHEN ok THEN b12 END) AS b12_median, CASE WHEN COUNT(CASE WHEN ok THEN 1 END) > 0 THEN 'SUCCESS' ELSE 'ALL_PIXELS_MASKED' END AS feature_status FROM px GROUP BY event_id, timing)"""
SCL = """, scl AS (SELECT event_id, timing, COUNT(scl) AS total_pixels, COUNT(CASE WHEN scl IN (4, 5, 6) THEN 1 END) AS valid_surface_pixels, COUNT(CASE WHEN scl IN (8, 9, 10) THEN 1 END) AS cloud_pixels, COUNT(CASE WHEN scl = 3 THEN 1 END) AS cloud_shadow_pixels, COUNT(CASE WHEN scl = 0 THEN 1 END) AS nodata_pixels,
    COUNT(CASE WHEN scl = 7 THEN 1 END) AS unclassified_pixels, COUNT(CASE WHEN scl = 2 THEN 1 END) AS dark_area_pixels, COUNT(CASE WHEN scl IN (1, 11) THEN 1 END) AS other_invalid_pixels FROM pixels GROUP BY event_id, timing),
  usable AS (SELECT *, CASE WHEN total_pixels = 0 THEN 'EMPTY_AOI' WHEN 100.0 * cloud_pixels / CAST(total_pixels AS DOUBLE) > 20 THEN 'REJECTED_LOCAL_CLOUD' WHEN 100.0 * valid_surface_pixels / CAST(total_pixels AS DOUBLE) >= 70 THEN 'USABLE'
    WHEN 100.0 * cloud_shadow_pixels / CAST(total_pixels AS DOUBLE) > 20 THEN 'REJECTED_CLOUD_SHADOW' WHEN 100.0 * nodata_pixels / CAST(total_pixels AS DOUBLE) > 20 THEN 'REJECTED_NODATA' ELSE 'REJECTED_LOW_VALID_SURFACE' END AS usability_status FROM scl)"""
STATUS = SCL + """, obs AS (SELECT event_id, MAX(CASE WHEN timing = 'pre' THEN st END) AS pre_status, MAX(CASE WHEN timing = 'post' THEN st END) AS post_status FROM
    (SELECT event_id, timing, CASE WHEN usability_status = 'USABLE' THEN 'REAL_CDSE_SUCCESS' WHEN usability_status IN ('REJECTED_LOCAL_CLOUD', 'REJECTED_CLOUD_SHADOW') THEN 'CLOUD_REJECTED' WHEN usability_status = 'REJECTED_NODATA' THEN 'PROCESSING_API_ERROR' ELSE 'MISSING_PRODUCT' END AS st FROM usable) GROUP BY event_id),
  overall AS (SELECT *, CASE WHEN pre_status = 'REAL_CDSE_SUCCESS' AND post_status = 'REAL_CDSE_SUCCESS' THEN 'REAL_CDSE_SUCCESS' WHEN pre_status = 'REAL_CDSE_SUCCESS' THEN 'PARTIAL_PRE_ONLY' WHEN post_status = 'REAL_CDSE_SUCCESS' THEN 'PARTIAL_POST_ONLY'
    WHEN pre_status = 'CLOUD_REJECTED' OR post_status = 'CLOUD_REJECTED' THEN 'CLOUD_REJECTED' WHEN pre_status = 'MISSING_PRODUCT' AND post_status = 'MISSING_PRODUCT' THEN 'MISSING_PRODUCT' WHEN pre_status = 'PROCESSING_API_ERROR' OR post_status = 'PROCESSING_API_ERROR' THEN 'PROCESSING_API_ERROR' ELSE 'PROCESSING_FAILED' END AS processing_status FROM obs)"""


def _matched(t: Tables) -> DataFrame:
    events = clean(t).withColumn("tile_no", (F.col("event_id") % 25).cast("int"))
    return evidence.match_images(events, t("catalogue"))


def statuses(t: Tables) -> DataFrame:
    """Events with the status of both observations and of the whole."""
    u = F.col("usability_status")
    st = F.when(u == "USABLE", "REAL_CDSE_SUCCESS").when(u.isin("REJECTED_LOCAL_CLOUD", "REJECTED_CLOUD_SHADOW"), "CLOUD_REJECTED").when(u == "REJECTED_NODATA", "PROCESSING_API_ERROR").otherwise("MISSING_PRODUCT")
    wide = evidence.pre_post(evidence.scl_quality(t("pixels")).withColumn("status", st), ["status"])
    return wide.withColumn("processing_status", evidence.overall_status(F.col("pre_status"), F.col("post_status")))


@query("j12_j13_image_match", "detections catalogue", MATCH + " SELECT event_id, timing, candidates, usable, product_id, image_date, cloud_cover, days, status FROM matched")
def _(t):
    return _matched(t).select("event_id", "timing", "candidates", "usable", "product_id", "image_date", "cloud_cover", "days", "status")


@query("j14_m52_match_reasons", "detections catalogue", MATCH + """ SELECT event_id, timing, CASE WHEN product_id IS NOT NULL THEN printf('%+d days, cloud ', days) || COALESCE(printf('%.1f%%', cloud_cover), 'unknown') || printf(', 1 of %d usable', usable)
  WHEN candidates > 0 THEN printf('%d candidates, lowest cloud %.1f%%', candidates, lowest_cloud) ELSE 'no image in the window' END AS reason FROM matched""")  # fmt: skip
def _(t):
    return _matched(t).select("event_id", "timing", "reason")


@query("m40_m47_m48_windows", "detections", CLEAN + " SELECT event_id, acq_date - 15 AS pre_from, acq_date - 1 AS pre_to, acq_date + 1 AS post_from, acq_date + 15 AS post_to, CAST(DATE '2024-01-20' - acq_date AS INTEGER) AS signed_days FROM clean")
def _(t):
    x = clean(t).withColumn("d", evidence.parse_date(F.concat(F.col("acq_date").cast("string"), F.lit("T10:00:00Z"))))
    return x.select("event_id", F.date_sub("d", 15).alias("pre_from"), F.date_sub("d", 1).alias("pre_to"), F.date_add("d", 1).alias("post_from"), F.date_add("d", 15).alias("post_to"), F.datediff(F.lit("2024-01-20").cast("date"), "d").alias("signed_days"))


@query("s10_catalogue_parse", "catalogue", "SELECT CAST(product_id AS VARCHAR) AS product_id, 'T' || LPAD(CAST(tile_no AS VARCHAR), 5, '0') AS tile_id, cloud_cover FROM catalogue")
def _(t):
    tile = F.concat(F.lit("T"), F.lpad(F.col("tile_no").cast("string"), 5, "0"))
    attribute = F.when(F.col("cloud_cover").isNull(), F.array().cast("array<struct<Name:string,Value:string>>")).otherwise(F.array(F.struct(F.lit("cloudCover").alias("Name"), F.col("cloud_cover").cast("string").alias("Value"))))
    raw = t("catalogue").select(F.to_json(F.struct(F.col("product_id").cast("string").alias("Id"), F.concat(F.lit("S2A_MSIL2A_"), tile, F.lit("_X")).alias("Name"), F.struct(F.col("image_date").cast("string").alias("Start")).alias("ContentDate"), attribute.alias("Attributes"))).alias("value"))
    return evidence.parse_products(raw).select("product_id", "tile_id", "cloud_cover")


@query("s11_patch_to_pixels", "pixels", "SELECT event_id, timing, COUNT(*) AS pixels, CAST(SUM(b04) AS BIGINT) AS b04 FROM pixels GROUP BY 1, 2")
def _(t):
    p = F.sort_array(F.collect_list(F.struct("px_a", "px_b", "scl", "b04", "b08", "b11", "b12")))
    patches = t("pixels").groupBy("event_id", "timing").agg(p.alias("p"))
    patches = patches.select("event_id", "timing", *(F.col(f"p.{b}").alias(b) for b in ("scl", "b04", "b08", "b11", "b12")))
    return evidence.patch_to_pixels(patches).groupBy("event_id", "timing").agg(F.count("*").alias("pixels"), F.sum("b04").cast("long").alias("b04"))


@query("a15_m37_scl_quality", "pixels", SCL + " SELECT event_id, timing, total_pixels, valid_surface_pixels, cloud_pixels, cloud_shadow_pixels, nodata_pixels, unclassified_pixels, dark_area_pixels, other_invalid_pixels, usability_status FROM usable")
def _(t):
    return evidence.scl_quality(t("pixels")).select("event_id", "timing", "total_pixels", *(f"{k}_pixels" for k in ("valid_surface", "cloud", "cloud_shadow", "nodata", "unclassified", "dark_area", "other_invalid")), "usability_status")


@query("m38_m39_pixel_indices", "pixels", SPECTRAL + " SELECT event_id, timing, COUNT(CASE WHEN ok THEN 1 END) AS valid, ROUND(MIN(ndvi), 9) AS low_ndvi, ROUND(MAX(swir_ratio), 9) AS top_swir FROM px GROUP BY 1, 2")
def _(t):
    x = evidence.pixel_indices(t("pixels")).withColumn("ok", evidence.valid_pixel())
    return x.groupBy("event_id", "timing").agg(F.count_if("ok").alias("valid"), F.round(F.min("ndvi"), 9).alias("low_ndvi"), F.round(F.max("swir_ratio"), 9).alias("top_swir"))


@query("a16_a18_spectral_statistics", "pixels", SPECTRAL + """ SELECT event_id, timing, total_pixels, valid_pixels, valid_pct, feature_status, """ + ", ".join(f"ROUND({c}_{s}, 6) AS {c}_{s}" for c in ("ndvi", "nbr", "ndwi", "swir_ratio") for s in ("mean", "median", "std", "min", "max")) + ", ROUND(b04_mean, 6) AS b04_mean, b12_median FROM feat")
def _(t):
    x = evidence.spectral_features(t("pixels"))
    return x.select("event_id", "timing", "total_pixels", "valid_pixels", "valid_pct", "feature_status", *(F.round(f"{c}_{s}", 6).alias(f"{c}_{s}") for c in ("ndvi", "nbr", "ndwi", "swir_ratio") for s in ("mean", "median", "std", "min", "max")), F.round("b04_mean", 6).alias("b04_mean"), "b12_median")


@query("j15_m26_change", "pixels", SPECTRAL + """, w AS (SELECT event_id, MAX(CASE WHEN timing = 'pre' THEN valid_pixels END) AS pv, MAX(CASE WHEN timing = 'post' THEN valid_pixels END) AS qv, MAX(CASE WHEN timing = 'pre' THEN valid_pct END) AS pp, MAX(CASE WHEN timing = 'post' THEN valid_pct END) AS qp,
    MAX(CASE WHEN timing = 'pre' THEN nbr_mean END) AS pn, MAX(CASE WHEN timing = 'post' THEN nbr_mean END) AS qn, MAX(CASE WHEN timing = 'pre' THEN ndvi_median END) AS pd, MAX(CASE WHEN timing = 'post' THEN ndvi_median END) AS qd FROM feat GROUP BY event_id),
  s AS (SELECT *, CASE WHEN pv IS NULL AND qv IS NULL THEN 'INVALID_INPUT' WHEN COALESCE(pv, 0) = 0 AND COALESCE(qv, 0) = 0 THEN 'MISSING_BOTH' WHEN COALESCE(pv, 0) = 0 THEN 'MISSING_PRE' WHEN COALESCE(qv, 0) = 0 THEN 'MISSING_POST' WHEN pp < 40 OR qp < 40 THEN 'INSUFFICIENT_VALID_DATA' ELSE 'SUCCESS' END AS change_status FROM w)
  SELECT event_id, change_status, ROUND(CASE WHEN change_status = 'SUCCESS' THEN qn - pn END, 6) AS dnbr_mean, ROUND(CASE WHEN change_status = 'SUCCESS' THEN ABS(qd - pd) END, 6) AS abs_dndvi_median FROM s""")  # fmt: skip
def _(t):
    cols = ["feature_status", "valid_pixels", "valid_pct", *(f"{c}_{s}" for c in ("ndvi", "nbr", "ndwi", "swir_ratio") for s in ("mean", "median"))]
    x = evidence.change_features(evidence.pre_post(evidence.spectral_features(t("pixels")), cols), 40.0)
    return x.select("event_id", "change_status", F.round("dnbr_mean", 6).alias("dnbr_mean"), F.round("abs_dndvi_median", 6).alias("abs_dndvi_median"))


@query("p20_prefixed_features", "pixels", SPECTRAL + " SELECT event_id, MAX(CASE WHEN timing = 'pre' THEN valid_pixels END) AS pre_valid_pixels, MAX(CASE WHEN timing = 'post' THEN valid_pixels END) AS post_valid_pixels, MAX(CASE WHEN timing = 'pre' THEN feature_status END) AS pre_feature_status, MAX(CASE WHEN timing = 'post' THEN feature_status END) AS post_feature_status FROM feat GROUP BY event_id")
def _(t):
    return evidence.pre_post(evidence.spectral_features(t("pixels")), ["valid_pixels", "feature_status"])


@query("m24_m25_event_status", "pixels", STATUS + " SELECT event_id, pre_status, post_status, processing_status, CASE WHEN processing_status IN ('CLOUD_REJECTED', 'MISSING_PRODUCT', 'PROCESSING_API_ERROR', 'PROCESSING_FAILED') THEN processing_status ELSE '' END AS error_category FROM overall")
def _(t):
    return statuses(t).withColumn("error_category", error_category("processing_status"))


@query("a20_a21_run_metrics", "pixels", STATUS + """ SELECT COUNT(*) AS events, COUNT(CASE WHEN processing_status = 'REAL_CDSE_SUCCESS' THEN 1 END) AS both, COUNT(CASE WHEN processing_status = 'PARTIAL_PRE_ONLY' THEN 1 END) AS pre_only, COUNT(CASE WHEN processing_status = 'PARTIAL_POST_ONLY' THEN 1 END) AS post_only,
  COUNT(CASE WHEN processing_status = 'CLOUD_REJECTED' THEN 1 END) AS cloud_rejected, COUNT(CASE WHEN processing_status = 'MISSING_PRODUCT' THEN 1 END) AS missing, COUNT(CASE WHEN COALESCE(pre_status, '') <> 'REAL_CDSE_SUCCESS' THEN 1 END) AS without_pre, COUNT(CASE WHEN COALESCE(post_status, '') <> 'REAL_CDSE_SUCCESS' THEN 1 END) AS without_post,
  ROUND(100.0 * CAST(2 * COUNT(CASE WHEN processing_status = 'REAL_CDSE_SUCCESS' THEN 1 END) + COUNT(CASE WHEN processing_status IN ('PARTIAL_PRE_ONLY', 'PARTIAL_POST_ONLY') THEN 1 END) AS DOUBLE) / CAST(2 * COUNT(*) AS DOUBLE), 2) AS observation_coverage_pct FROM overall""")  # fmt: skip
def _(t):
    return evidence.evidence_metrics(statuses(t))


@query("s15_manifest", "pixels", STATUS + " SELECT event_id, processing_status, pre_status, post_status, CAST(CASE WHEN pre_status = 'REAL_CDSE_SUCCESS' OR post_status = 'REAL_CDSE_SUCCESS' THEN 1 ELSE 0 END AS INTEGER) AS is_real, CASE WHEN processing_status IN ('CLOUD_REJECTED', 'MISSING_PRODUCT', 'PROCESSING_API_ERROR', 'PROCESSING_FAILED') THEN processing_status ELSE '' END AS error_category FROM overall")
def _(t):
    return recovery.manifest(statuses(t))


@query("j21_u6_resume", "pixels", STATUS + " SELECT event_id FROM overall WHERE processing_status <> 'REAL_CDSE_SUCCESS' AND event_id % 3 <> 0")
def _(t):
    s = statuses(t)
    done = recovery.completed_ids(s.filter("processing_status = 'REAL_CDSE_SUCCESS'"), s.filter("event_id % 3 = 0").select("event_id", F.col("processing_status").alias("status")))
    return recovery.to_process(s, done).select("event_id")


@query("j22_upsert", "pixels", STATUS + " SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'REAL_CDSE_SUCCESS' ELSE pre_status END AS pre_status, post_status FROM overall")
def _(t):
    s = statuses(t).select("event_id", "pre_status", "post_status")
    fixed = s.filter("event_id % 5 = 0").select("event_id", F.lit("REAL_CDSE_SUCCESS").alias("pre_status"), F.lit(None).cast("string").alias("post_status"))
    return recovery.upsert(s, fixed)


RETRY = STATUS + """, retry AS (SELECT event_id, CASE WHEN p AND q THEN 'both' WHEN p THEN 'pre' ELSE 'post' END AS "window", CONCAT_WS('; ', CASE WHEN p THEN 'pre: ' || pre_status END, CASE WHEN q THEN 'post: ' || post_status END) AS reason
  FROM (SELECT *, COALESCE(pre_status = 'PROCESSING_API_ERROR', FALSE) AS p, COALESCE(post_status = 'PROCESSING_API_ERROR', FALSE) AS q FROM overall) WHERE p OR q)"""


@query("j23_retry_windows", "pixels", RETRY + ' SELECT event_id, "window", reason FROM retry')
def _(t):
    return recovery.retry_windows(statuses(t))


@query("a29_retry_counts", "pixels", RETRY + """ SELECT COUNT(CASE WHEN "window" = 'pre' THEN 1 END) AS pre_only, COUNT(CASE WHEN "window" = 'post' THEN 1 END) AS post_only, COUNT(CASE WHEN "window" = 'both' THEN 1 END) AS both, CAST(COALESCE(SUM(CASE WHEN "window" = 'both' THEN 2 ELSE 1 END), 0) AS BIGINT) AS windows FROM retry""")
def _(t):
    return recovery.retry_counts(recovery.retry_windows(statuses(t)))


@query("a30_recovery_matrix", "pixels", STATUS + ", r AS (SELECT pre_status AS status, 1 AS p, 0 AS q FROM overall UNION ALL SELECT post_status, 0, 1 FROM overall) SELECT status, CAST(SUM(p) AS BIGINT) AS pre, CAST(SUM(q) AS BIGINT) AS post FROM r GROUP BY status")
def _(t):
    return recovery.recovery_matrix(statuses(t))


@query("a28_error_signatures", "detections", """, m AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'Read timeout after ' || event_id WHEN event_id % 4 = 1 THEN 'HTTP 429 for ' || event_id END AS m FROM detections UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'HTTP 403' END FROM detections),
  k AS (SELECT CASE WHEN CONTAINS(LOWER(m), 'timeout') THEN 'timeout' WHEN CONTAINS(m, '429') THEN 'rate limit' WHEN CONTAINS(m, '401') OR CONTAINS(m, '403') THEN 'authorization' ELSE SUBSTRING(m, 1, 40) END AS signature FROM m WHERE m IS NOT NULL) SELECT signature, COUNT(*) AS n FROM k GROUP BY signature""")  # fmt: skip
def _(t):
    e = F.col("event_id")
    pre = F.when(e % 4 == 0, F.concat(F.lit("Read timeout after "), e)).when(e % 4 == 1, F.concat(F.lit("HTTP 429 for "), e))
    return recovery.error_signatures(t("detections").select(pre.alias("pre_error"), F.when(e % 3 == 0, "HTTP 403").alias("post_error")))


@query("q10_residual_status", "pixels", STATUS + " SELECT 'missing_keys' AS name, COUNT(CASE WHEN event_id IS NULL THEN 1 END) AS observed, 0::BIGINT AS expected, TRUE AS passed FROM overall UNION ALL SELECT 'duplicate_keys', COUNT(event_id) - COUNT(DISTINCT event_id), 0, TRUE FROM overall UNION ALL SELECT 'auth_required', COUNT(CASE WHEN processing_status = 'AUTH_REQUIRED' THEN 1 END), 0, TRUE FROM overall")
def _(t):
    return quality.expectations(statuses(t), "event_id", extra={"auth_required": F.col("processing_status") == "AUTH_REQUIRED"})
