"""Distances, tiles and boxes on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.common import col, flag
from emberline.params import DEFAULTS


def haversine_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str, radius: float = DEFAULTS.earth_radius_m) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    s, t = F.sin((b - a) / 2), F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), s * s + F.cos(a) * F.cos(b) * t * t)))


def planar_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Flat approximation with 111 and 108 km a degree."""
    y, x = (col(lat1) - col(lat2)) * 111.0, (col(lon1) - col(lon2)) * 108.0
    return F.sqrt(y * y + x * x)


def within_flags(distance: Column | str, prefix: str, radii: tuple[int, ...] = DEFAULTS.radii_m) -> dict[str, Column]:
    """A 0/1 column for each radius; 10 km is always among them."""
    return {f"{prefix}_{r}m": flag(col(distance) <= float(r)) for r in sorted({*radii, 10_000})}


def match_quality(km: Column | str) -> Column:
    """M18."""
    d = col(km)
    return F.when(d.isNull(), "no match").when(d <= 0.5, "strong").when(d <= 2.0, "moderate").otherwise("weak")


def match_strength(m: Column | str) -> Column:
    """Strength of the nearest facility's match by distance in metres."""
    d = col(m)
    return F.when(d.isNull() | (d > 10_000), "NO MATCH").when(d < 1000, "STRONG").when(d < 5000, "NEARBY").otherwise("WEAK")


def tile_name(lat: Column | str, lon: Column | str) -> Column:
    """Name of the 3 x 3 degree tile by its lower left corner, such as N09E078."""
    y, x = (F.floor(col(c) / 3).cast("int") * 3 for c in (lat, lon))
    return F.concat(F.when(y >= 0, "N").otherwise("S"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x >= 0, "E").otherwise("W"), F.lpad(F.abs(x).cast("string"), 3, "0"))


def aoi_box(lat: Column | str, lon: Column | str, half_m: float) -> Column:
    """Square box around a point; null for a point off the globe or a size that isn't positive."""
    y, x = col(lat), col(lon)
    dy = F.lit(half_m / 111_320.0)
    dx = F.lit(half_m) / (111_320.0 * F.greatest(F.abs(F.cos(F.radians(y))), F.lit(1e-6)))
    box = F.struct(F.greatest(y - dy, F.lit(-90.0)).alias("south"), F.least(y + dy, F.lit(90.0)).alias("north"), F.greatest(x - dx, F.lit(-180.0)).alias("west"), F.least(x + dx, F.lit(180.0)).alias("east"))
    return F.when(y.between(-90, 90) & x.between(-180, 180) & F.lit(half_m > 0), box)


def satellite_link(lat: Column | str, lon: Column | str) -> Column:
    """Link to a satellite view of the point."""
    return F.format_string("https://www.google.com/maps/@%.6f,%.6f,800m/data=!3m1!1e3", col(lat), col(lon))


def route_link(lat: Column | str, lon: Column | str, to_lat: Column | str, to_lon: Column | str) -> Column:
    """Link that shows the event and its facility, or a note that there is none."""
    link = F.format_string("https://www.google.com/maps/dir/%.6f,%.6f/%.6f,%.6f", col(lat), col(lon), col(to_lat), col(to_lon))
    return F.when(col(to_lat).isNull() | col(to_lon).isNull(), "No matched facility").otherwise(link)


def inside_rings(lat: Column | str, lon: Column | str, edges: Column, closed: bool | None = False) -> Column:
    """Even-odd test of a point against an array of ring edges (x1, y1, x2, y2).  Points on an edge are outside, or inside if ``closed``; with None the crossings alone decide, as in SQL.

    The point is bound as one value first, so what derives its coordinates runs once a row, not once for each edge.
    """

    def inside(p: Column) -> Column:
        y, x = p.y, p.x
        crosses = lambda e: ((y >= e.y1) & (y < e.y2) | (y >= e.y2) & (y < e.y1)) & (x < e.x1 + (y - e.y1) * (e.x2 - e.x1) / F.nullif(e.y2 - e.y1, F.lit(0.0)))
        on_line = lambda e: F.abs((x - e.x1) * (e.y2 - e.y1) - (y - e.y1) * (e.x2 - e.x1)) <= 1e-12
        touches = lambda e: on_line(e) & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))
        odd = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
        if closed is None:
            return odd
        on_edge = F.exists(edges, lambda e: F.coalesce(touches(e), F.lit(False)))
        return odd | on_edge if closed else odd & ~on_edge

    return F.exists(F.array(F.struct(col(lat).alias("y"), col(lon).alias("x"))), inside)
