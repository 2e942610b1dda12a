"""An index of sites by which one equi-join finds a point's nearest (J1-J4, J27, T4): cells of the globe with all sites that can be nearest anywhere in them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberline.functions.geo import haversine_m
from emberline.params import DEFAULTS
from emberline.sources.shared import materialize, spread, union_all

#: Cell sizes in degrees, each a quarter of the one before; the last is about five centimetres.
SIZES = tuple(32.0 / 4**n for n in range(14))
#: Place in SIZES of the directory's cells of 2 degrees, of which the globe has fewer than 17,000.
DIRECTORY = 2
#: Sites of one cell; a cell with more is split, but for those of the last size.
MOST = 64
#: Sites of a cell that one task takes down to its leaves.
ALONE = 5_000
#: Cells of a round that are few enough for all tasks to know their rivals, some hundred bytes each; more are shuffled.
FEW = 20_000
#: Distances are rounded to a millimetre, so a site beats another only by more; in radians.
_TIE = 2e-10


def _vector(lat: Column, lon: Column) -> Column:
    y, x = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(y) * F.cos(x)).alias("x"), (F.cos(y) * F.sin(x)).alias("y"), F.sin(y).alias("z"))


#: Columns of a cell's corners and middle as unit vectors.
_SPOTS = tuple(tuple(f"_{spot}{axis}" for axis in "xyz") for spot in ("sw", "se", "nw", "ne", "mid"))


def _shaped(cells: DataFrame, size: float) -> DataFrame:
    """Cells (_cy, _cx, ...) of the globe with the unit vectors of their corners and middle; they are cut at the poles."""
    edge = lambda c, k: F.least(F.greatest((F.col(c) + k) * size, F.lit(-90.0)), F.lit(90.0))
    on_globe = lambda c, most: (F.col(c) * size <= most) & ((F.col(c) + 1) * size >= -most)
    south, north, west, east = edge("_cy", 0), edge("_cy", 1), F.col("_cx") * size, (F.col("_cx") + 1) * size
    spots = [(y, x) for y in (south, north) for x in (west, east)] + [((south + north) / 2, (west + east) / 2)]
    vectors = [_vector(y, x) for y, x in spots]
    return cells.filter(on_globe("_cy", 90) & on_globe("_cx", 180)).withColumns({c: v[axis] for names, v in zip(_SPOTS, vectors, strict=True) for c, axis in zip(names, "xyz", strict=True)} | {"_half": F.lit(math.radians(size / 2))})


def _narrowed(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs`` of shaped cells and sites without the sites of which ``k`` others are nearer everywhere in the cell.

    The points nearer to a than to b are a half of the globe, so a is nearer in all of a cell if it is so at its corners, with a margin for the parallels, which aren't great circles.
    Those that can beat others are the nearest to each corner and to the middle; sites are dealt to ``k`` groups, and a site goes if one of each group beats it.
    """
    half = F.col("_half")  # a column, so that all rounds run the same generated code
    margin = half * half / 3
    dot = lambda names, v: F.col(names[0]) * v["x"] + F.col(names[1]) * v["y"] + F.col(names[2]) * v["z"]
    own = F.col("_v")
    best = [F.max_by(F.when(F.col("_g") == g, own), F.when(F.col("_g") == g, dot(s, own))) for g in range(k) for s in _SPOTS]
    rivals = pairs.groupBy("_cy", "_cx").agg(*(b.alias(f"_r{i}") for i, b in enumerate(best)))
    distance = 2 - 2 * dot(_SPOTS[4], own)  # of the middle, squared
    reach = 1.6 * F.sqrt(F.greatest(distance, F.lit(0.0))) + 2 * half

    def beats(a: Column) -> Column:
        d = {axis: a[axis] - own[axis] for axis in "xyz"}
        far = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
        return F.coalesce(F.least(*(dot(s, d) for s in _SPOTS[:4])) > margin * far + _TIE * reach + 4e-16, F.lit(False))

    n = len(_SPOTS)
    beaten = [reduce(Column.__or__, [beats(F.col(f"_r{g * n + i}")) for i in range(n)]) for g in range(k)]
    return pairs.join(rivals, ["_cy", "_cx"]).filter(~reduce(Column.__and__, beaten)).select("_cy", "_cx", "_s", "_v", "_g")


def _spots(cy: int, cx: int, size: float) -> np.ndarray:
    """The corners of a cell and its middle as unit vectors."""

    def unit(lat: float, lon: float) -> list[float]:
        y, x = math.radians(lat), math.radians(lon)
        return [math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)]

    south, north = (max(-90.0, min(90.0, (cy + i) * size)) for i in (0, 1))
    west, east = cx * size, (cx + 1) * size
    return np.array([*(unit(y, x) for y in (south, north) for x in (west, east)), unit((south + north) / 2, (west + east) / 2)])


def _on_globe(cy: int, cx: int, size: float) -> bool:
    return cy * size <= 90 and (cy + 1) * size >= -90 and cx * size <= 180 and (cx + 1) * size >= -180


def _unbeaten(v: np.ndarray, rivals: list[np.ndarray], spots: np.ndarray, size: float) -> np.ndarray:
    """Which of the sites ``v`` stay in a cell; ``rivals`` are those of each group; same rules as ``_narrowed``."""
    half = math.radians(size / 2)
    least = _TIE * (1.6 * np.sqrt(np.maximum(2 - 2 * (v @ spots[4]), 0.0)) + 2 * half) + 4e-16
    beaten = np.ones(len(v), bool)
    for own in rivals:
        one = np.zeros(len(v), bool)
        for rival in own:
            d = rival - v
            one |= (d @ spots[:4].T).min(1) > half * half / 3 * np.sqrt((d * d).sum(1)) + least
        beaten &= one
    return ~beaten


def _vectors(column: pa.StructArray) -> np.ndarray:
    return np.stack([a.to_numpy(zero_copy_only=False) for a in column.flatten()], 1).astype(float)


def _children(level: int, py: int, px: int) -> list[tuple[int, int]]:
    """The cells of a level on the globe that are in a cell of the level before."""
    found = [(y, x) for y in range(-3, 3) for x in range(-6, 6)] if level == 0 else [(4 * py + i, 4 * px + j) for i in range(4) for j in range(4)]
    return [c for c in found if _on_globe(*c, SIZES[level])]


def _round(open_: DataFrame, level: int, k: int) -> DataFrame:
    """``_narrowed`` for the children of few cells, without a row for each pair of a child and a site: every task names its nearest to each child's corners and middle, the
    nearest of all tasks, some hundred bytes a child, go back to all tasks, and each drops the sites that those beat."""
    size = SIZES[level]

    def by_parent(batch: pa.RecordBatch):
        at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_py", "_px")], 1)
        parents, which = np.unique(at, axis=0, return_inverse=True)
        for n, (py, px) in enumerate(parents.tolist()):
            yield np.flatnonzero(which.ravel() == n), _children(level, py, px)

    def nearest(batches):
        best: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            v, g = _vectors(batch.column("_v")), batch.column("_g").to_numpy(zero_copy_only=False)
            for rows, cells in by_parent(batch):
                for cell in cells:
                    dots = v[rows] @ _spots(*cell, size).T
                    for i in range(k):
                        own = np.flatnonzero(g[rows] == i)
                        if len(own):
                            top = own[np.argmax(dots[own], 0)]
                            d, w = dots[top, range(len(_SPOTS))], v[rows[top]]
                            if (*cell, i) in best:
                                d0, w0 = best[*cell, i]
                                d, w = np.maximum(d, d0), np.where((d > d0)[:, None], w, w0)
                            best[*cell, i] = d, w
        keys = np.repeat(np.array(list(best), np.int32).reshape(-1, 3), len(_SPOTS), 0)
        d, w = (np.concatenate([x[n] for x in best.values()]) if best else np.empty(shape) for n, shape in ((0, 0), (1, (0, 3))))
        spot = np.tile(np.arange(len(_SPOTS), dtype=np.int32), len(best))
        yield pa.record_batch([*(pa.array(keys[:, n]) for n in range(3)), pa.array(spot), pa.array(d), *(pa.array(w[:, n]) for n in range(3))], ["cy", "cx", "g", "spot", "d", "x", "y", "z"])

    found = open_.select("_py", "_px", "_v", "_g").mapInArrow(nearest, "cy int, cx int, g int, spot int, d double, x double, y double, z double")
    found = found.groupBy("cy", "cx", "g", "spot").agg(F.max(F.struct("d", "x", "y", "z")).alias("m")).select("cy", "cx", "g", "m.x", "m.y", "m.z").distinct()
    rivals: dict[tuple[int, int], list[list]] = {}
    for r in found.collect():
        rivals.setdefault((r.cy, r.cx), [[] for _ in range(k)])[r.g].append((r.x, r.y, r.z))
    rivals = {c: [np.array(x).reshape(-1, 3) for x in groups] for c, groups in rivals.items()}

    def keep(batches):
        for batch in batches:
            v = _vectors(batch.column("_v"))
            for rows, cells in by_parent(batch):
                for cy, cx in cells:
                    left = pa.array(rows[_unbeaten(v[rows], rivals[cy, cx], _spots(cy, cx, size), size)])
                    if len(left):
                        kept = batch.select(["_s", "_v", "_g"]).take(left)
                        yield pa.record_batch([pa.array(np.full(len(left), c), pa.int32()) for c in (cy, cx)] + kept.columns, ["_cy", "_cx", "_s", "_v", "_g"])

    kinds = {f.name: f.dataType.simpleString() for f in open_.schema}
    return open_.select("_py", "_px", "_s", "_v", "_g").mapInArrow(keep, f"_cy int, _cx int, _s {kinds['_s']}, _v {kinds['_v']}, _g {kinds['_g']}")


def _finish(top: int, k: int, most: int):
    """The function that takes one cell of level ``top`` with its sites down to leaves; same rules as ``_narrowed``."""

    def narrow(v: np.ndarray, g: np.ndarray, cy: int, cx: int, size: float) -> np.ndarray:
        spots = _spots(cy, cx, size)
        owns = (v[g == i] for i in range(k))
        return _unbeaten(v, [own[np.unique(np.argmax(own @ spots.T, 0))] if len(own) else own for own in owns], spots, size)

    def tied(v: np.ndarray, g: np.ndarray, cy: int, size: float) -> int:
        """Sites that stay in every cell at a pole, which all its cells share: those near the same latitude.  Parts of the cell would hold them again, four times as many parts at each level."""
        if -90 < cy * size and (cy + 1) * size < 90:
            return 0
        height = v[:, 2] if (cy + 1) * size >= 90 else -v[:, 2]
        least = min(height[g == i].max(initial=-2.0) for i in range(k))
        return int((height >= least - 1e-9).sum())

    def finish(table: pa.Table) -> pa.Table:
        v = _vectors(table.column("_v").combine_chunks())
        g = table.column("_g").to_numpy()
        todo = [(top, table.column("_cy")[0].as_py(), table.column("_cx")[0].as_py(), np.arange(len(v)))]
        out = []
        while todo:
            level, cy, cx, own = todo.pop()
            size = SIZES[level]
            if not _on_globe(cy, cx, size):
                continue
            own = own[narrow(v[own], g[own], cy, cx, size)]
            if len(own) <= most or level == len(SIZES) - 1 or len(own) <= 2 * tied(v[own], g[own], cy, size):
                out.append((level, cy, cx, own))
            else:
                todo += [(level + 1, 4 * cy + i, 4 * cx + j, own) for i in range(4) for j in range(4)]
        sizes = np.r_[0, np.cumsum([len(x[3]) for x in out])]
        sites = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), table.column("_s").combine_chunks().take(pa.array(np.concatenate([x[3] for x in out]))))
        return pa.table([*(pa.array([x[i] for x in out], pa.int32()) for i in range(3)), sites], ["_level", "_cy", "_cx", "_sites"])

    return finish


def _shortlist(k: int):
    """The function that says for each point which places of its arrays of sites can be among the ``k`` nearest: those, and what is so near to them that rounding decides."""
    diameter = 2 * DEFAULTS.earth_radius_m

    @arrow_udf("array<int>")
    def places(lat: pa.Array, lon: pa.Array, lats: pa.Array, lons: pa.Array) -> pa.Array:
        counts = lats.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        a, x = (np.radians(v.to_numpy(zero_copy_only=False))[row] for v in (lat, lon))
        b, z = (np.radians(v.flatten().to_numpy(zero_copy_only=False)) for v in (lats, lons))
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((z - x) / 2) ** 2
        d = diameter * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        some = counts > 0
        if k == 1:
            kth = np.minimum.reduceat(d, starts[some]) if some.any() else d
        else:
            kth = d[np.lexsort((d, row))][(starts + np.minimum(k, counts) - 1)[some]]
        limit = np.zeros(len(counts))
        limit[some] = kth + 0.002 + (kth > 1.9e7)  # metres; the arcsine is coarse on the far side of the globe
        near = d <= limit[row]
        ends = np.r_[0, np.cumsum(np.bincount(row[near], minlength=len(counts)))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((np.arange(len(d)) - starts[row])[near], pa.int32()))

    return places


@dataclass(frozen=True)
class SiteIndex:
    """``leaves`` (_level, _cy, _cx, _sites) cover the globe without overlap; ``directory`` (_dy, _dx, _levels) says for each cell of 2 degrees which levels its leaves have."""

    leaves: DataFrame
    directory: DataFrame
    k: int
    keep: tuple[str, ...]

    def look_up(self, points: DataFrame, lat: str = "latitude", lon: str = "longitude", result: str = "nearest") -> DataFrame:
        """``points``, which may be a stream, with an array of the ``k`` nearest sites, struct(distance_m, *keep); empty for points that aren't on the globe.

        A point joins its only leaf: the directory, bounded by the globe, is broadcast and names the one or few levels to look at.  The leaf's sites are compared in batches of
        points; only the nearest and their ties go through Spark's distance, which ranks them.  Nothing is counted, written or kept between batches.
        """
        y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
        valid = F.coalesce(y.between(-90, 90) & x.between(-180, 180), F.lit(False))
        near = F.transform("_at", lambda i: F.get("_sites", i))
        ranked = F.transform(near, lambda s: F.struct(F.round(haversine_m(y, x, s["latitude"], s["longitude"]), 3).alias("distance_m"), *(s[c].alias(c) for c in self.keep)))
        size = F.element_at(F.array(*map(F.lit, SIZES)), F.greatest(F.col("_level"), F.lit(0)) + 1)
        at = lambda c: F.when(valid, F.floor(c / size)).otherwise(F.lit(0)).cast("int")
        step = SIZES[DIRECTORY]
        out = points.withColumns({"_dy": F.when(y.between(-90, 90), F.floor(y / step)).cast("int"), "_dx": F.when(x.between(-180, 180), F.floor(x / step)).cast("int")}).join(F.broadcast(self.directory), ["_dy", "_dx"], "left")
        out = out.withColumn("_level", F.explode(F.coalesce("_levels", F.array(F.lit(-1))))).withColumns({"_cy": at(y), "_cx": at(x)})
        out = out.join(self.leaves, ["_level", "_cy", "_cx"]).withColumn("_at", _shortlist(self.k)(y, x, F.col("_sites.latitude"), F.col("_sites.longitude")))
        return out.withColumn(result, F.slice(F.sort_array(ranked), 1, self.k)).drop("_dy", "_dx", "_levels", "_level", "_cy", "_cx", "_sites", "_at")


def site_index(sites: DataFrame, k: int = 1, keep: tuple[str, ...] = ("osm_type", "osm_id"), most: int = MOST, alone: int = ALONE) -> SiteIndex:
    """An index of all ``sites`` (latitude, longitude, *keep) that are on the globe.

    All sites belong to the largest cells at first.  A cell drops the sites that can't be nearest there and is split in sixteen while it holds more than ``most``, so dense regions
    get small cells and far ones stay large.  Cells with more than ``alone`` sites do so in rounds of joins over all tasks, smaller ones at once in one task.  No row holds more than ``most`` sites, unless so many stand within five
    centimetres or are equally near to a pole; of those at the very same place only the first ``k`` by ``keep`` count.
    """
    here = Window.partitionBy("latitude", "longitude").orderBy(*keep)
    rows = sites.select(F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), *(F.col(c) for c in keep if c not in ("latitude", "longitude")))
    rows = rows.filter(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)).withColumn("_n", F.row_number().over(here)).filter(F.col("_n") <= k)
    site = F.struct("latitude", "longitude", *(c for c in keep if c not in ("latitude", "longitude")))
    rows = rows.select(site.alias("_s"), _vector(F.col("latitude"), F.col("longitude")).alias("_v"), F.pmod(F.xxhash64("latitude", "longitude", "_n"), F.lit(k)).alias("_g"))
    kind = rows.schema["_s"].dataType.simpleString()
    rows = spread(materialize(rows))
    whole = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi)))
    cells = rows.sparkSession.range(1).select(whole(-3, 2).alias("_cy")).withColumn("_cx", whole(-6, 5)).withColumns({"_py": F.lit(0), "_px": F.lit(0)})
    open_, n, leaves = rows.withColumns({"_py": F.lit(0), "_px": F.lit(0)}), 72, []  # all sites stand in one cell, the globe
    crowded = rows.count() > alone
    for level, size in enumerate(SIZES):
        cells, few = _shaped(cells, size), n <= FEW
        pairs = open_.join(F.broadcast(cells) if few else cells, ["_py", "_px"])
        if crowded:
            kept = materialize(_round(spread(open_), level, k) if few else _narrowed(pairs, k))
            size_of = kept.groupBy("_cy", "_cx").agg(F.count(F.lit(1)).alias("_n"))
            full = size_of.filter(F.col("_n") > alone).select("_cy", "_cx")
            n = 16 * full.count() if level < len(SIZES) - 1 else 0
            rest = kept.join(full, ["_cy", "_cx"], "left_anti") if n else kept
        else:
            rest, n = pairs.select("_cy", "_cx", "_s", "_v", "_g"), 0
        leaves.append(rest.groupBy("_cy", "_cx").applyInArrow(_finish(level, k, most), f"_level int, _cy int, _cx int, _sites array<{kind}>"))
        if not n:
            break
        parent = full.select(F.col("_cy").alias("_py"), F.col("_cx").alias("_px"))
        cells = parent.withColumn("_ny", whole(0, 3)).withColumn("_nx", whole(0, 3)).select("_py", "_px", (F.col("_py") * 4 + F.col("_ny")).alias("_cy"), (F.col("_px") * 4 + F.col("_nx")).alias("_cx"))
        open_ = kept.join(F.broadcast(full) if 16 * FEW > n else full, ["_cy", "_cx"]).withColumnsRenamed({"_cy": "_py", "_cx": "_px"})
    nowhere = rows.sparkSession.range(1).select(F.lit(-1).alias("_level"), F.lit(0).alias("_cy"), F.lit(0).alias("_cx"), F.array().cast(f"array<{kind}>").alias("_sites"))
    leaves = materialize(union_all([*leaves, nowhere]))
    return SiteIndex(leaves, materialize(_directory(leaves)), k, keep)


def _directory(leaves: DataFrame) -> DataFrame:
    """The levels of the leaves in each cell of 2 degrees."""
    parts = []
    for level in range(DIRECTORY + 1):
        n = 4 ** (DIRECTORY - level)
        span = lambda c, n=n: F.explode(F.sequence(F.col(c) * n, F.col(c) * n + (n - 1)))
        parts.append(leaves.filter(F.col("_level") == level).select("_level", "_cy", "_cx").withColumn("_dy", span("_cy")).withColumn("_dx", span("_cx")).select("_dy", "_dx", "_level"))
    ratio = F.pow(F.lit(4.0), F.col("_level") - DIRECTORY)
    down = lambda c: F.floor(F.col(c) / ratio).cast("int")
    parts.append(leaves.filter(F.col("_level") > DIRECTORY).select(down("_cy").alias("_dy"), down("_cx").alias("_dx"), "_level"))
    return reduce(DataFrame.unionByName, parts).groupBy("_dy", "_dx").agg(F.collect_set("_level").alias("_levels"))
