"""Satellite image evidence: matching, pixel masks, spectral statistics, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.common import flag, number
from emberline.params import DEFAULTS, Params

INDICES = {"ndvi": ("b08", "b04"), "nbr": ("b08", "b12"), "ndwi": ("b08", "b11")}


def parse_products(raw: DataFrame) -> DataFrame:
    """Catalogue rows (json text in ``value``) to product_id, name, start, tile_id, cloud_cover; a missing attribute gives null."""
    kind = "Id string, Name string, ContentDate struct<Start:string>, Attributes array<struct<Name:string,Value:string>>"
    p = raw.select(F.from_json("value", kind).alias("p")).select("p.*")
    attribute = lambda n: F.get(F.filter("Attributes", lambda a: a.Name == n), 0)["Value"]
    tile = F.regexp_extract("Name", r"_(T[0-9A-Z]{5})_", 1)
    return p.select(F.col("Id").alias("product_id"), F.col("Name").alias("name"), F.col("ContentDate.Start").alias("start"), F.coalesce(F.nullif(tile, F.lit("")), attribute("tileId")).alias("tile_id"), number(attribute("cloudCover")).alias("cloud_cover"))


def parse_date(text: Column) -> Column:
    """The first ten characters as a date; null means INVALID_DATE."""
    return F.try_to_date(F.substring(text.cast("string"), 1, 10), "yyyy-MM-dd")


def match_images(events: DataFrame, catalogue: DataFrame, keys: tuple[str, ...] = ("tile_no",), params: Params = DEFAULTS) -> DataFrame:
    """For each event and timing the best image, or why there is none.

    The event's day belongs to neither window.  Images of the event's tile in the window count; those with more cloud than allowed are
    rejected, unknown cloud is allowed; the nearest day wins, then less cloud (unknown last), then the later date, then the smaller id.  Both sides are
    joined on tile and a block of days as long as the window, so a tile with a long history doesn't meet itself whole; events of one tile and day are matched once.
    """
    w, block = params.window_days, params.window_days + 1
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    ev = events.select(*keys, "acq_date").distinct().withColumn("_b", F.explode(F.array(*(F.floor(day("acq_date") / block) + d for d in (-1, 0, 1)))))
    images = catalogue.select(*keys, "product_id", "image_date", "cloud_cover").withColumn("_b", F.floor(day("image_date") / block))
    pairs = ev.join(images, [*keys, "_b"]).withColumn("days", F.datediff("image_date", "acq_date"))
    pairs = pairs.filter((F.abs("days") >= 1) & (F.abs("days") <= w)).withColumn("timing", F.when(F.col("days") < 0, "pre").otherwise("post"))
    usable = F.coalesce(F.col("cloud_cover") <= params.max_cloud_pct, F.lit(True))
    rank = F.struct(F.abs("days").alias("a"), F.coalesce("cloud_cover", F.lit(999.0)).alias("c"), F.negative(day("image_date")).alias("d"), F.col("product_id").alias("i"))
    best = pairs.groupBy(*keys, "acq_date", "timing").agg(
        F.count("*").alias("candidates"), F.count_if(usable).alias("usable"), F.min("cloud_cover").alias("lowest_cloud"),
        F.min_by(F.struct("product_id", "image_date", "cloud_cover", "days"), F.when(usable, rank)).alias("p"),
    )
    slots = events.select("event_id", *keys, "acq_date").withColumn("timing", F.explode(F.array(F.lit("pre"), F.lit("post"))))
    out = slots.join(best, [*keys, "acq_date", "timing"], "left").select("event_id", "timing", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("usable", F.lit(0)).alias("usable"), "lowest_cloud", "p.*")
    status = F.when(F.col("product_id").isNotNull(), "MATCHED").when(F.col("candidates") > 0, "CLOUD_REJECTED").otherwise("MISSING_PRODUCT")
    reason = (
        F.when(F.col("product_id").isNotNull(), F.concat(F.format_string("%+d days, cloud ", "days"), F.when(F.col("cloud_cover").isNull(), "unknown").otherwise(F.format_string("%.1f%%", "cloud_cover")), F.format_string(", 1 of %d usable", "usable")))
        .when(F.col("candidates") > 0, F.format_string("%d candidates, lowest cloud %.1f%%", "candidates", "lowest_cloud"))
        .otherwise("no image in the window")
    )
    return out.withColumns({"status": status, "reason": reason})


def scl_quality(pixels: DataFrame, keys: tuple[str, ...] = ("event_id", "timing"), params: Params = DEFAULTS) -> DataFrame:
    """Class counts of each patch and whether it is usable; the histogram is a map from class to count."""
    n = lambda *c: F.count_if(F.col("scl").isin(*c))
    groups = {"valid_surface": (4, 5, 6), "cloud": (8, 9, 10), "cloud_shadow": (3,), "nodata": (0,), "unclassified": (7,), "dark_area": (2,), "other_invalid": (1, 11)}
    out = pixels.groupBy(*keys).agg(F.count("scl").alias("total_pixels"), *(n(*c).alias(f"{k}_pixels") for k, c in groups.items()), *(n(c).alias(f"_scl{c}") for c in range(12)))
    out = out.withColumns({f"{k}_pct": F.coalesce(100.0 * F.col(f"{k}_pixels") / F.nullif(F.col("total_pixels"), F.lit(0)), F.lit(0.0)) for k in groups})
    verdict = (
        F.when(F.col("total_pixels") == 0, "EMPTY_AOI").when(F.col("cloud_pct") > params.max_cloud_pct, "REJECTED_LOCAL_CLOUD").when(F.col("valid_surface_pct") >= params.min_valid_pct, "USABLE")
        .when(F.col("cloud_shadow_pct") > 20, "REJECTED_CLOUD_SHADOW").when(F.col("nodata_pct") > 20, "REJECTED_NODATA").otherwise("REJECTED_LOW_VALID_SURFACE")
    )
    histogram = F.map_from_arrays(F.array(*(F.lit(c) for c in range(12))), F.array(*(F.col(f"_scl{c}") for c in range(12))))
    return out.withColumns({"usability_status": verdict, "histogram": histogram}).drop(*(f"_scl{c}" for c in range(12)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null where the denominator is nothing."""
    top, low = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.abs(low) > 1e-6, top / low)


def valid_pixel() -> Column:
    """Surface classes with four finite bands."""
    good = F.col("scl").isin(4, 5, 6)
    for b in ("b04", "b08", "b11", "b12"):
        good = good & F.col(b).isNotNull() & ~F.isnan(b) & (F.abs(b) != float("inf"))
    return F.coalesce(good, F.lit(False))


def pixel_indices(pixels: DataFrame) -> DataFrame:
    """NDVI, NBR, NDWI and the short-wave ratio of each pixel."""
    out = {k: ratio(F.col(a) - F.col(b), F.col(a) + F.col(b)) for k, (a, b) in INDICES.items()}
    return pixels.withColumns({**out, "swir_ratio": ratio("b12", "b11")})


def spectral_features(pixels: DataFrame, keys: tuple[str, ...] = ("event_id", "timing")) -> DataFrame:
    """Statistics of the indices and bands over the valid pixels of each patch, all in one aggregation.

    A patch without a valid pixel has status ALL_PIXELS_MASKED and null statistics.  Medians are exact.
    """
    x = pixel_indices(pixels.withColumn("_ok", valid_pixel()))
    over = lambda f, c: f(F.when(F.col("_ok"), F.col(c)))
    aggs = [F.count("*").alias("total_pixels"), F.count_if("_ok").alias("valid_pixels")]
    for c in (*INDICES, "swir_ratio"):
        aggs += [over(F.avg, c).alias(f"{c}_mean"), over(F.median, c).alias(f"{c}_median"), over(F.stddev_pop, c).alias(f"{c}_std"), over(F.min, c).alias(f"{c}_min"), over(F.max, c).alias(f"{c}_max"), over(F.count, c).alias(f"{c}_count")]
    for c in ("b04", "b08", "b11", "b12"):
        aggs += [over(F.avg, c).alias(f"{c}_mean"), over(F.median, c).alias(f"{c}_median"), over(F.stddev_pop, c).alias(f"{c}_std")]
    out = x.groupBy(*keys).agg(*aggs)
    return out.withColumns({"valid_pct": F.round(100.0 * F.col("valid_pixels") / F.col("total_pixels"), 2), "feature_status": F.when(F.col("valid_pixels") > 0, "SUCCESS").otherwise("ALL_PIXELS_MASKED")})


def patch_to_pixels(patches: DataFrame, keys: tuple[str, ...] = ("event_id", "timing"), bands: tuple[str, ...] = ("scl", "b04", "b08", "b11", "b12")) -> DataFrame:
    """Patches (one array per band) to a pixel table; patches with a missing, empty or unequal band give one row with the status and no pixel."""
    sizes = [F.size(b) for b in bands]
    missing, empty, unequal = F.lit(False), F.lit(False), F.lit(False)
    for b, s in zip(bands, sizes, strict=True):
        missing, empty, unequal = missing | F.col(b).isNull(), empty | (s == 0), unequal | (s != sizes[0])
    status = F.when(missing, "MISSING_BAND").when(empty, "EMPTY_PATCH").when(unequal, "DIMENSION_MISMATCH").otherwise("OK")
    zipped = F.when(F.col("patch_status") == "OK", F.arrays_zip(*bands))
    out = patches.withColumn("patch_status", status).select(*keys, "patch_status", F.posexplode_outer(zipped).alias("px", "p"))
    return out.select(*keys, "patch_status", "px", *(F.col(f"p.{b}").alias(b) for b in bands))


def pre_post(features: DataFrame, columns: list[str], key: str = "event_id") -> DataFrame:
    """Rows of the two timings side by side, pre_<c> and post_<c>, by one aggregation."""
    return features.groupBy(key).agg(*(F.max(F.when(F.col("timing") == t, F.col(c))).alias(f"{t}_{c}") for t in ("pre", "post") for c in columns))


def change_features(wide: DataFrame, least_valid_pct: float = 0.0) -> DataFrame:
    """Differences of post and pre (d<index>_<stat> and their sizes) with the status that says whether they can be trusted.

    Expects pre_/post_ feature_status, valid_pixels, valid_pct and mean and median of the four indices.  Differences are null unless the status is SUCCESS.
    """
    good = {t: F.coalesce((F.col(f"{t}_feature_status") == "SUCCESS") & (F.col(f"{t}_valid_pixels") > 0), F.lit(False)) for t in ("pre", "post")}
    gone = F.col("pre_feature_status").isNull() & F.col("post_feature_status").isNull()
    low = (F.coalesce("pre_valid_pct", F.lit(0.0)) < least_valid_pct) | (F.coalesce("post_valid_pct", F.lit(0.0)) < least_valid_pct)
    status = F.when(gone, "INVALID_INPUT").when(~good["pre"] & ~good["post"], "MISSING_BOTH").when(~good["pre"], "MISSING_PRE").when(~good["post"], "MISSING_POST").when(low, "INSUFFICIENT_VALID_DATA").otherwise("SUCCESS")
    out = wide.withColumn("change_status", status)
    for c in (*INDICES, "swir_ratio"):
        for s in ("mean", "median"):
            d = F.when(F.col("change_status") == "SUCCESS", F.col(f"post_{c}_{s}") - F.col(f"pre_{c}_{s}"))
            out = out.withColumns({f"d{c}_{s}": d, f"abs_d{c}_{s}": F.abs(d)})
    return out


def overall_status(pre: Column, post: Column) -> Column:
    """Status of an event from those of its two observations, first rule first."""
    ok, either = "REAL_CDSE_SUCCESS", lambda s: (pre == s) | (post == s)
    return (
        F.when((pre == ok) & (post == ok), ok)
        .when(pre == ok, "PARTIAL_PRE_ONLY")
        .when(post == ok, "PARTIAL_POST_ONLY")
        .when(either("AUTH_REQUIRED"), "AUTH_REQUIRED")
        .when(either("CLOUD_REJECTED"), "CLOUD_REJECTED")
        .when((pre == "MISSING_PRODUCT") & (post == "MISSING_PRODUCT"), "MISSING_PRODUCT")
        .when(either("PROCESSING_API_ERROR"), "PROCESSING_API_ERROR")
        .otherwise("PROCESSING_FAILED")
    )


def status_reason(pre: Column, post: Column, overall: Column) -> Column:
    """The reason that goes with the overall status."""
    return (
        F.when(overall == "REAL_CDSE_SUCCESS", "")
        .when(overall == "PARTIAL_PRE_ONLY", F.concat(F.lit("post unavailable: "), post))
        .when(overall == "PARTIAL_POST_ONLY", F.concat(F.lit("pre unavailable: "), pre))
        .when((overall == "CLOUD_REJECTED") & (pre == post), "both observations rejected for cloud")
        .when((overall == "MISSING_PRODUCT"), "neither observation in the catalogue")
        .otherwise(F.concat(F.lit("pre: "), pre, F.lit("; post: "), post))
    )


def evidence_metrics(events: DataFrame) -> DataFrame:
    """One row of counts over events with pre_status, post_status and processing_status."""
    ok = "REAL_CDSE_SUCCESS"
    both, pre, post = F.col("processing_status") == ok, F.col("processing_status") == "PARTIAL_PRE_ONLY", F.col("processing_status") == "PARTIAL_POST_ONLY"
    out = events.agg(
        F.count("*").alias("events"), F.count_if(both).alias("both"), F.count_if(pre).alias("pre_only"), F.count_if(post).alias("post_only"),
        F.count_if(F.col("processing_status") == "CLOUD_REJECTED").alias("cloud_rejected"), F.count_if(F.col("processing_status") == "MISSING_PRODUCT").alias("missing"),
        F.count_if(F.coalesce(F.col("pre_status") != ok, F.lit(True))).alias("without_pre"), F.count_if(F.coalesce(F.col("post_status") != ok, F.lit(True))).alias("without_post"),
    )
    return out.withColumn("observation_coverage_pct", F.coalesce(F.round(100.0 * (2 * F.col("both") + F.col("pre_only") + F.col("post_only")) / F.nullif(2 * F.col("events"), F.lit(0)), 2), F.lit(0.0)))


def latest_by(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """<c>_missing as 0/1."""
    return df.withColumns({f"{c}_missing": flag(F.col(c).isNull()) for c in columns})
