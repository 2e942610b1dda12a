"""Spatial joins without a spatial index: grid cells as equi-join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.common import flag
from emberline.functions.geo import haversine_m, inside_rings
from emberline.operators.site_index import MOST, site_index
from emberline.params import DEFAULTS, Params
from emberline.sources.shared import materialize

#: Rows that a task of a nearest search takes at most: some ten seconds of work.
SEARCHED = 100_000


def in_box(df: DataFrame, south: float, north: float, west: float, east: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Inclusive; plain comparisons, so they reach the Parquet scan."""
    return df.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def in_polygon(df: DataFrame, edges: DataFrame, lat: str = "latitude", lon: str = "longitude", most_edges: int = 5000, closed: bool | None = False) -> DataFrame:
    """Rows inside the rings of ``edges`` (x1, y1, x2, y2), after the box of the edges; ``closed`` says where points on an edge belong, as in ``inside_rings``: outside, by default.

    No edges: no row, same columns; edges with a null coordinate don't count.  Up to ``most_edges`` edges are one array in the plan; more are joined by latitude band.  The test is the same.
    """
    edges = edges.select(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).na.drop()
    few = edges.limit(most_edges + 1).collect()
    if not few:
        return df.limit(0)
    if len(few) <= most_edges:
        xs, ys = [x for r in few for x in (r.x1, r.x2)], [y for r in few for y in (r.y1, r.y2)]
        rows = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in r.asDict().items())) for r in few))
        return in_box(df, min(ys), max(ys), min(xs), max(xs), lat, lon).filter(inside_rings(lat, lon, rows, closed))
    box = edges.agg(F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2")), F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))).first()
    near = in_box(df, *box, lat, lon)
    step = max((box[1] - box[0]) / 1000, 1e-9)
    band = lambda c: F.floor((c - box[0]) / step)
    by_band = edges.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2"))))).groupBy("_band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    return near.withColumn("_band", band(F.col(lat))).join(by_band, "_band").filter(inside_rings(lat, lon, F.col("_edges"), closed)).drop("_band", "_edges")


def in_region(df: DataFrame, edges: DataFrame | None, params: Params = DEFAULTS, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside the polygon, or inside the region's box where there is no polygon."""
    if edges is None or edges.isEmpty():
        return in_box(df, params.bbox_south, params.bbox_north, params.bbox_west, params.bbox_east, lat, lon)
    return in_polygon(df, edges, lat, lon)


def tile_grid(spark: SparkSession, rows: int, cols: int, south: float, north: float, west: float, east: float, overlap: float = 0.0) -> DataFrame:
    """Equal tiles of a box, each widened by ``overlap`` degrees and cut to the box."""
    r, c = F.floor(F.col("id") / cols), F.col("id") % cols
    dy, dx = (north - south) / rows, (east - west) / cols
    return spark.range(rows * cols).select(
        F.col("id").alias("tile_no"),
        F.greatest(F.lit(south), south + r * dy - overlap).alias("south"),
        F.least(F.lit(north), south + (r + 1) * dy + overlap).alias("north"),
        F.greatest(F.lit(west), west + c * dx - overlap).alias("west"),
        F.least(F.lit(east), west + (c + 1) * dx + overlap).alias("east"),
    )


def nearest(points: DataFrame, sites: DataFrame, k: int = 1, lat: str = "latitude", lon: str = "longitude", keep: tuple[str, ...] = ("osm_type", "osm_id"), result: str = "nearest", most: int = MOST) -> DataFrame:
    """Each point with an array of its ``k`` nearest sites, struct(distance_m, *keep), ties by ``keep`` in order.

    An index of the sites is built, then each point joins its one cell, which holds every site that can be nearest there, ``most`` of them at most.  Points that aren't on the globe and
    tables without sites get an empty array.  Distances are rounded to a millimetre, which settles ties.
    """
    return site_index(sites, k, keep, most).look_up(points, lat, lon, result)


def nearest_one(points: DataFrame, sites: DataFrame, prefix: str, distance: str, keep: tuple[str, ...] = ("osm_type", "osm_id", "name"), **how) -> DataFrame:
    """The nearest site's columns under ``prefix`` and its distance; nulls where there is none."""
    out = nearest(points, sites, 1, keep=keep, result="_near", **how).withColumn("_near", F.get("_near", 0))
    return out.withColumns({distance: F.col("_near.distance_m"), **{f"{prefix}_{c}": F.col(f"_near.{c}") for c in keep}}).drop("_near")


def tile_coverage(points: DataFrame, tiles: DataFrame, lat: str = "latitude", lon: str = "longitude", cell: float = 1.0) -> DataFrame:
    """Coverage of each point: COVERED in a successful tile, else FAILED_TILE in another, else OUTSIDE; bounds are inclusive."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    cells = tiles.withColumn("_cy", span("south", "north")).withColumn("_cx", span("west", "east")).groupBy("_cy", "_cx").agg(F.collect_list(F.struct("south", "north", "west", "east", "success")).alias("_tiles"))
    y, x = F.col(lat), F.col(lon)
    out = points.withColumns({"_cy": F.floor(y / cell), "_cx": F.floor(x / cell)}).join(cells, ["_cy", "_cx"], "left")
    hits = F.filter("_tiles", lambda t: y.between(t.south, t.north) & x.between(t.west, t.east))
    status = F.when(F.coalesce(F.exists(hits, lambda t: t.success), F.lit(False)), "COVERED").when(F.coalesce(F.size(hits), F.lit(0)) > 0, "FAILED_TILE").otherwise("OUTSIDE")
    return out.withColumn("coverage", status).drop("_cy", "_cx", "_tiles")


#: Events of one place and day that a row of the pairs' join holds at most.
TOGETHER = 1000


def _place_days(events: DataFrame, key: str) -> DataFrame:
    """(lat, lon, day, ids): the events of each place and day, ``TOGETHER`` in a row at most; those without key, place or date are in no pair."""
    day = F.datediff("acq_date", F.lit("2000-01-01").cast("date"))
    rows = events.select(F.col(key).alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), day.alias("day")).na.drop()
    rows = rows.groupBy("lat", "lon", "day").agg(F.collect_list("id").alias("ids"))
    parts = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(TOGETHER)), lambda i: F.slice("ids", i, TOGETHER))
    return rows.select("lat", "lon", "day", F.explode(parts).alias("ids"))


def near_in_space_time(left: DataFrame, right: DataFrame, km: float = 3.0, days: int = 3, key: str = "event_id") -> DataFrame:
    """Pairs (left key, right key) with a haversine distance below ``km`` and fewer than ``days`` days apart, not of one event.

    Places meet, not events: those of one place and day are one row of the join, and only the pairs found are written out.  The left side is sent to the day buckets around its own and
    the right one to the cells around its own, so the join is an equi-join.  Both sides are sorted by it: they are 3 and 9 times their tables, which Spark's estimate of their size
    doesn't know, so neither must be broadcast.  The pairs themselves grow with the square of the events.
    """
    high, wide = km / 111.0, km / 111.0 * 1.5
    around = lambda c: F.explode(F.array(*(F.floor(c) + d for d in (-1, 0, 1))))
    a, b = (_place_days(x, key).withColumnsRenamed({c: f"{c}_{n}" for c in ("lat", "lon", "day", "ids")}) for n, x in (("a", left), ("b", right)))
    a = a.withColumns({"cy": F.floor(F.col("lat_a") / high), "cx": F.floor(F.col("lon_a") / wide)}).withColumn("cd", around(F.col("day_a") / days))
    b = b.withColumn("cd", F.floor(F.col("day_b") / days)).withColumn("cy", around(F.col("lat_b") / high)).withColumn("cx", around(F.col("lon_b") / wide))
    close = (F.abs(F.col("day_a") - F.col("day_b")) < days) & (F.abs(F.col("lat_a") - F.col("lat_b")) <= high) & (F.round(haversine_m("lat_a", "lon_a", "lat_b", "lon_b"), 3) < km * 1000)
    found = a.hint("merge").join(b.hint("merge"), ["cy", "cx", "cd"]).filter(close).select(F.explode("ids_a").alias("a"), "ids_b")
    return found.select("a", F.explode("ids_b").alias("b")).filter("a <> b")


def spatial_duplicates(events: DataFrame, score: str, km: float = 5.5, key: str = "event_id") -> DataFrame:
    """``events`` with is_spatial_duplicate: another event of the same date within ``km`` has a higher score, or the same and a lower key.

    All events of a date in a cell of a diagonal below ``km`` are near each other, so all but the best of them are duplicates at once.  Only the best of each cell go to the
    cells around it and meet the events there, so an event meets some 25 others, however many share its cell.  Events without coordinates, date or
    score beat nothing and aren't duplicates; the 180th meridian parts its two sides.  The best of the cells are as many as the events where those are sparse, and some 25 times
    as many around them, so neither is broadcast.
    """
    degrees = 0.95 * km / 111.32 / 2**0.5
    row_of = lambda c: F.floor(c / degrees)
    shrink = lambda row: F.greatest(F.cos(F.radians((row + 0.5) * degrees)), F.lit(0.02))
    kept = events.select(key, "latitude", "longitude", F.col("acq_date").alias("_d"), F.col(score).alias("_score")).na.drop()
    kept = kept.withColumn("_cy", row_of(F.col("latitude"))).withColumn("_cx", F.floor(F.col("longitude") * shrink(F.col("_cy")) / degrees))
    kept = materialize(kept)
    best = kept.groupBy("_d", "_cy", "_cx").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col(key).alias("k"), "latitude", "longitude")).alias("_best"))
    best = materialize(best)
    low = kept.join(best.hint("merge"), ["_d", "_cy", "_cx"]).filter((-F.col("_score") > F.col("_best.s")) | ((-F.col("_score") == F.col("_best.s")) & (F.col(key) > F.col("_best.k")))).select(key)

    around = best.select("_d", F.col("_best.s").alias("_s"), F.col("_best.k").alias("_k"), F.col("_best.latitude").alias("_y"), F.col("_best.longitude").alias("_x"), F.explode(F.sequence(F.col("_cy") - 2, F.col("_cy") + 2)).alias("_cy"))
    wide = km / 111.32 * 1.01 / F.least(shrink(F.col("_cy") - 3), shrink(F.col("_cy") + 3), shrink(F.col("_cy")))  # degrees of longitude that reach so far in the rows around
    column = lambda c: F.floor(c * shrink(F.col("_cy")) / degrees)
    around = around.withColumn("_cx", F.explode(F.sequence(column(F.col("_x") - wide), column(F.col("_x") + wide))))
    beats = (-F.col("_score") < F.col("_s")) | ((-F.col("_score") == F.col("_s")) & (F.col(key) < F.col("_k")))
    near = F.round(haversine_m("_y", "_x", "latitude", "longitude"), 3) <= km * 1000
    beaten = kept.join(around.hint("merge"), ["_d", "_cy", "_cx"]).filter(beats & near).select(F.col("_k").alias(key))
    marks = low.union(beaten).distinct().withColumn("_dup", F.lit(True))
    return events.join(marks, key, "left").withColumn("is_spatial_duplicate", F.coalesce("_dup", F.lit(False))).drop("_dup")


def footprint_cells(edges: DataFrame, key: str = "product_id", across: int = 16) -> DataFrame:
    """A covering of polygons (key, x1, y1, x2, y2: edges of all rings) by cells (_level, _cy, _cx, key, _edges), some ``across`` on the longer side.

    Cells that no edge's box meets lie inside or outside as a whole: the inner ones have no edges, the others are left out.  The rest hold the edges of their band of
    latitude, which is all an even-odd test of a point in the cell needs.
    """
    edges = materialize(edges.select(key, *(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).na.drop())
    box = edges.groupBy(key).agg(F.min(F.least("y1", "y2")).alias("_s"), F.max(F.greatest("y1", "y2")).alias("_n"), F.min(F.least("x1", "x2")).alias("_w"), F.max(F.greatest("x1", "x2")).alias("_e"))
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("_n") - F.col("_s"), F.col("_e") - F.col("_w"), F.lit(1e-6)) / across)), F.lit(-30)).cast("int")
    box = box.withColumn("_level", level)
    size = F.pow(F.lit(2.0), F.col("_level"))
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    sized = edges.join(box.select(key, "_level"), key)
    banded = sized.withColumn("_cy", span(F.least("y1", "y2"), F.greatest("y1", "y2")))
    bands = banded.groupBy(key, "_cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    crossed = banded.withColumn("_cx", span(F.least("x1", "x2"), F.greatest("x1", "x2"))).select(key, "_cy", "_cx").distinct().withColumn("_crossed", F.lit(True))
    cells = box.withColumn("_cy", span(F.col("_s"), F.col("_n"))).withColumn("_cx", span(F.col("_w"), F.col("_e"))).select(key, "_level", "_cy", "_cx")
    cells = cells.join(bands, [key, "_cy"], "left").join(crossed, [key, "_cy", "_cx"], "left")
    inner = F.coalesce(inside_rings((F.col("_cy") + 0.5) * size, (F.col("_cx") + 0.5) * size, F.col("_edges")), F.lit(False))
    return cells.filter(F.col("_crossed") | inner).select("_level", "_cy", "_cx", key, F.when(F.col("_crossed"), F.col("_edges")).alias("_edges"))


def in_footprints(points: DataFrame, cells: DataFrame, key: str = "product_id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``points`` with the key of each polygon that they lie in or on, a row for each; ``cells`` are a covering of ``footprint_cells``.

    A point looks its cell up once for each cell size that occurs, of which there are some thirty at most; inner cells need no test.
    """
    levels = sorted(r["_level"] for r in cells.select("_level").distinct().collect())
    if not levels:
        return points.join(cells.select(key), F.lit(False))
    y, x = F.col(lat), F.col(lon)
    size = F.pow(F.lit(2.0), F.col("_level"))
    keyed = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"_cy": F.floor(y / size), "_cx": F.floor(x / size)})
    hit = F.col("_edges").isNull() | inside_rings(lat, lon, F.col("_edges"), closed=True)
    return keyed.join(cells, ["_level", "_cy", "_cx"]).filter(hit).drop("_level", "_cy", "_cx", "_edges")


def distance_bands(df: DataFrame, distance: str, radii: tuple[int, ...] = DEFAULTS.radii_m) -> DataFrame:
    """Rows within each radius, their share, and the gain over the next smaller radius."""
    from pyspark.sql import Window

    counts = df.agg(F.count("*").alias("n"), *(F.sum(flag(F.col(distance) <= float(r))).alias(f"r{r}") for r in radii))
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("radius_m"), F.coalesce(f"r{r}", F.lit(0)).alias("within")) for r in radii)))
    out = counts.select("n", rows.alias("x")).select("x.radius_m", "x.within", F.coalesce(F.round(100.0 * F.col("x.within") / F.nullif(F.col("n"), F.lit(0)), 2), F.lit(0.0)).alias("pct"))
    return out.withColumn("gain", F.col("within") - F.coalesce(F.lag("within").over(Window.orderBy("radius_m")), F.lit(0)))
