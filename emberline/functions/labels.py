"""Rule chains and code tables: facilities, land cover, labels, tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.common import col, flag, lookup
from emberline.params import DEFAULTS

#: Land-cover names by code (fixed values).
LANDCOVER = {10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 60: "Bare/sparse vegetation", 70: "Snow and ice", 80: "Permanent water bodies", 90: "Herbaceous wetland", 95: "Mangroves", 100: "Moss and lichen"}
#: Codes of facility types (fixed values).
FACILITY_CODES = {"Power Plant": 1, "Industrial Works": 2, "Manufacturing": 3, "Warehouse/Depot": 4, "Construction Materials": 5, "Port/Shipyard": 6, "Oil & Gas": 7, "Mining": 8, "Chemical": 9, "Other Industrial": 10}
#: Facility classes in order of precedence (fixed values): category, tier, type, then the tag values and parts of names that mean it.
FACILITY_RULES: list[tuple[str, str, str, dict[str, tuple[str, ...]], tuple[str, ...]]] = [
    ("Refinery / Petrochemical", "HIGHER_RELEVANCE", "Oil & Gas", {"man_made": ("refinery", "petroleum_refinery"), "industrial": ("refinery", "petrochemical", "petroleum")}, ("refinery", "petrochemical")),
    ("Power Plant", "HIGHER_RELEVANCE", "Power Plant", {"power": ("plant", "generator"), "industrial": ("power", "power_plant")}, ("power station", "thermal power", "power plant")),
    ("Substation & Electrical Infrastructure", "CAUTION_LOWER_RELEVANCE", "Other Industrial", {"power": ("substation",), "industrial": ("substation",)}, ()),
    ("Steel / Metallurgy", "HIGHER_RELEVANCE", "Manufacturing", {"industrial": ("steel", "metallurgy", "smelter", "foundry", "metal")}, ("steel", "iron", "metallurgy", "smelter", "foundry")),
    ("Cement & Construction Materials", "HIGHER_RELEVANCE", "Construction Materials", {"industrial": ("cement", "bricks", "lime", "concrete", "construction_materials")}, ("cement", "clinker")),
    ("Mining & Quarry", "HIGHER_RELEVANCE", "Mining", {"industrial": ("mine", "mining", "quarry"), "landuse": ("quarry",)}, ("quarry", "mine")),
    ("Oil, Gas & Chemical", "HIGHER_RELEVANCE", "Chemical", {"industrial": ("oil", "gas", "chemical", "chemicals", "petroleum", "fertilizer", "lng", "lpg")}, ("chemical", "fertilizer", " lpg ", " lng ", "petrochemical")),
    ("Manufacturing & Industrial Works", "HIGHER_RELEVANCE", "Industrial Works", {"man_made": ("works",), "industrial": ("factory", "manufacture", "manufacturing", "works")}, ("works", "factory")),
    ("Warehouse & Logistics", "CAUTION_LOWER_RELEVANCE", "Warehouse/Depot", {"industrial": ("warehouse", "depot", "logistics")}, ("warehouse", "depot")),
    ("Industrial Area / Zone", "GENERAL_CONTEXT", "Other Industrial", {"landuse": ("industrial",), "industrial": ("industrial_estate", "industrial_park", "industrial_zone", "area")}, ()),
    ("Generic Industrial Building", "GENERAL_CONTEXT", "Other Industrial", {"building": ("industrial",)}, ()),
]
FACILITY_DEFAULT = ("Other Industrial", "GENERAL_CONTEXT", "Other Industrial")
#: Reviewers' spellings by class (fixed values).
ANNOTATIONS = {
    "Industrial / Facility Fire": "Industrial Fire", "industrial/facility fire": "Industrial Fire",
    "Persistent Industrial Thermal Source": "Persistent Industrial Thermal Source", "Presistent Industrial Themal Souce": "Persistent Industrial Thermal Source",
    "Agricultural Burning": "Agricultural Burning", "agricultural Burning": "Agricultural Burning", "agricultural burning": "Agricultural Burning", "argricultural burning": "Agricultural Burning",
    "agricultural burn.": "Agricultural Burning", "agriculatural fire": "Agricultural Burning", "Biomass / Agricultural Burning": "Agricultural Burning",
    "Natural/Forest Fire": "Natural/Forest Fire", "NAtural/Forest Fire": "Natural/Forest Fire", "forest fire": "Natural/Forest Fire",
    "Other/Unclassified": "Other/Unclassified",
}
#: Annotations that name a facility and no status (fixed values).
EQUIPMENT_ONLY = ("Industrial Facility", "Industrial Facility / Boiler Anomaly", "Industrial Facility / Salt Refinery")
#: Training classes by reviewed class (fixed values).
TARGETS = {"Industrial Fire": "Industrial Thermal Activity", "Persistent Industrial Thermal Source": "Industrial Thermal Activity", "Agricultural Burning": "Agricultural Burning", "Natural/Forest Fire": "Natural / Wildfire / Other", "Other/Unclassified": "Natural / Wildfire / Other"}
#: Error category of each status (fixed values).
ERROR_CATEGORIES = {"CLOUD_REJECTED": "CLOUD_REJECTED", "MISSING_PRODUCT": "MISSING_PRODUCT", "AUTH_REQUIRED": "AUTH_FAILURE", "AUTH_FAILURE": "AUTH_FAILURE", "PROCESSING_API_ERROR": "PROCESSING_API_ERROR", "CORRUPT_RASTER": "PROCESSING_FAILED", "PROCESSING_FAILED": "PROCESSING_FAILED"}
#: Bonus of each land cover in the candidate score (fixed values).
LANDCOVER_BONUS = {"Built-up": 0.10, "Shrubland": 0.05, "Grassland": 0.05, "Cropland": 0.07, "Tree cover": 0.03}


def landcover_class(code: Column | str) -> Column:
    """M20."""
    return lookup(col(code).cast("int"), LANDCOVER, "Unknown")


def facility_type_code(kind: Column | str) -> Column:
    """0 for unknown types."""
    return lookup(col(kind), FACILITY_CODES, 0)


def classify_facility(power: Column, industrial: Column, man_made: Column, landuse: Column, building: Column, name: Column, strict_words: bool = False) -> Column:
    """struct(category, tier, type) by the first rule that holds; null tags count as empty.

    ``strict_words`` takes parts of names as whole words only.
    """
    tags = {k: F.lower(F.coalesce(v, F.lit(""))) for k, v in (("power", power), ("industrial", industrial), ("man_made", man_made), ("landuse", landuse), ("building", building))}
    title = F.lower(F.coalesce(name, F.lit("")))
    named = lambda part: title.rlike(rf"(?<![a-z]){part.strip()}(?![a-z])") if strict_words else F.contains(title, F.lit(part))
    result = lambda c, t, k: F.struct(F.lit(c).alias("normalized_category"), F.lit(t).alias("relevance_tier"), F.lit(k).alias("facility_type"))
    chain = None
    for category, tier, kind, values, parts in FACILITY_RULES:
        rule = reduce(lambda a, b: a | b, [*(tags[k].isin(*v) for k, v in values.items()), *(named(p) for p in parts)])
        chain = F.when(rule, result(category, tier, kind)) if chain is None else chain.when(rule, result(category, tier, kind))
    return chain.otherwise(result(*FACILITY_DEFAULT))


def normalize_annotation(raw: Column | str) -> Column:
    """struct(label, unambiguous, reason) of a reviewer's text; null counts as the text 'None'."""
    x = F.trim(F.coalesce(col(raw), F.lit("None")))
    low = F.lower(x)
    has = lambda *parts: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in parts))
    unsure = has("possible", "buring")
    reason = (
        F.when(unsure & has("agricultural", "argricultural"), "possible agricultural burning")
        .when(unsure & has("forest"), "possible forest fire")
        .when(unsure & has("garbage"), "possible garbage burning")
        .when(has("thermal anomaly"), "thermal anomaly at a facility, fire or operation unresolved")
        .when(x.isin(*EQUIPMENT_ONLY), "facility named, status not given")
        .when(has("scrub", "brush"), "brush or scrub burning fits several classes")
        .otherwise(F.concat(F.lit("unrecognized annotation: "), x))
    )
    known = lookup(x, ANNOTATIONS)
    return F.struct(F.coalesce(known, F.lit("REVIEW_REQUIRED")).alias("label"), known.isNotNull().alias("unambiguous"), F.when(known.isNotNull(), "direct match").otherwise(reason).alias("reason"))


def target_class(label: Column | str) -> Column:
    """Three training classes; null for labels under review."""
    return lookup(col(label), TARGETS)


def error_category(status: Column | str) -> Column:
    """Empty text for successes."""
    return lookup(F.coalesce(col(status), F.lit("")), ERROR_CATEGORIES, "")


def weak_label(distance: Column | str, active_days: Column | str, spike: Column, landcover: Column | str, forest_season: Column | str, stubble_season: Column | str, near_m: float = DEFAULTS.near_facility_m, days: int = DEFAULTS.persistent_days) -> Column:
    """First rule that holds; an unknown distance is not near, an unknown land cover uses the rules without it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    near, lasting, hot = yes(col(distance) <= near_m), yes(col(active_days) >= days), yes(spike)
    forest, stubble = yes(col(forest_season) == 1), yes(col(stubble_season) == 1)
    cover = F.coalesce(col(landcover), F.lit("Unknown"))
    known, built = cover != "Unknown", cover == "Built-up"
    return (
        F.when(known & near & built & lasting & ~hot, "Persistent Thermal Source")
        .when(known & near & built & hot, "Industrial Fire")
        .when((cover == "Tree cover") & ~near & forest, "Forest Fire")
        .when((cover == "Cropland") & ~lasting & stubble, "Agricultural Burning")
        .when(known, "Other/Unclassified")
        .when(near & lasting & ~hot, "Persistent Thermal Source")
        .when(near & hot, "Industrial Fire")
        .when(~near & hot & forest, "Possible Forest Fire")
        .when(~near & ~lasting & stubble, "Possible Agricultural Burning")
        .otherwise("Other/Unclassified")
    )


def proximity(distance: Column | str, most: float = 50_000.0) -> Column:
    """1 at the facility, 0 at ``most`` metres and beyond or where there is none."""
    return 1 - F.least(F.coalesce(col(distance), F.lit(most)), F.lit(most)) / most


def minmax(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """Scaled to 0..1, guarded against a range of nothing."""
    return (col(value) - col(low)) / (col(high) - col(low) + 1e-9)


def landcover_bonus(cover: Column | str) -> Column:
    return lookup(col(cover), LANDCOVER_BONUS, 0.0)


def published_tier(score: Column | str) -> Column:
    """M35."""
    return F.when(col(score) >= 0.5, "HIGH").when(col(score) >= 0.3, "MEDIUM").otherwise("LOW")


def first_tier(frp: Column | str, active_days: Column | str, spike: Column, stubble: Column | str) -> Column:
    """The first-generation candidate tier."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(col(frp) >= 5) | yes(col(active_days) >= 3) | yes(spike), "HIGH").when(yes(col(frp) >= 2.5) | yes(col(stubble) == 1), "MEDIUM").otherwise("LOW")


def confidence_tier(probability: Column | str) -> Column:
    """Tier of the largest probability, rounded to four digits first."""
    p = F.round(col(probability), 4)
    return F.when(p >= 0.75, "HIGH").when(p >= 0.5, "MEDIUM").otherwise("LOW")


def rationale(tier: Column | str, distance: Column | str, frp: Column | str, active_days: Column | str, cover: Column | str) -> Column:
    """The reasons for a selection as text."""
    return F.concat_ws(
        "; ",
        F.concat(col(tier), F.lit(" priority")),
        F.when(col(distance) <= 2000, F.lit("industrial facility within 2 km")),
        F.when(col(frp) >= 5, F.lit("high radiative power")),
        F.when(col(active_days) >= 3, F.lit("persistent location")),
        F.when(col(cover) != "Unknown", F.concat(F.lit("land cover: "), col(cover))),
    )


def persistent(active_days: Column | str, days: int = DEFAULTS.persistent_days) -> Column:
    """M32."""
    return flag(col(active_days) >= days)
