"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut
from emberline.llm.components import connected_components

_BLOCK, _ROWS, _CELLS = 512, 20_000, 1_000_000


@functools.lru_cache(maxsize=64)
def product_code(dims: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors for each half of the dimensions; a filter is one of each half and points along their sum."""
    rng = np.random.default_rng(dims * 1_000_003 + codes)
    first, second = rng.normal(size=(codes, (dims + 1) // 2)), rng.normal(size=(codes, dims // 2 or 1))
    return tuple(c / np.linalg.norm(c, axis=1, keepdims=True) for c in (first, second))


@functools.lru_cache(maxsize=64)
def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix, so that what a vector meets doesn't depend on the directions its table favours."""
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


def list_decode(x: np.ndarray, codes: int, k: int) -> np.ndarray:
    """For each unit vector the sorted numbers of the ``k`` nearest filters (of all if there are fewer), one row each.

    The i-th best code of one half and the j-th best of the other have i * j - 1 products before them at least, so only those with i * j <= k are added up.
    """
    first, second = product_code(x.shape[1], codes)
    k, m = min(k, codes**2), min(k, codes)
    i, j = np.divmod(np.arange(m * m), m)
    i, j = i[(i + 1) * (j + 1) <= k], j[(i + 1) * (j + 1) <= k]
    out = np.empty((len(x), k), np.int64)
    step = max(1, _CELLS // codes)
    for s in range(0, len(x), step):
        y = x[s : s + step] @ rotation(x.shape[1])
        halves = y[:, : first.shape[1]] @ first.T, (y[:, first.shape[1] :] if y.shape[1] > 1 else np.zeros((len(y), 1))) @ second.T
        best = [np.argpartition(-h, m - 1, axis=1)[:, :m] for h in halves]
        best = [np.take_along_axis(o, np.argsort(-np.take_along_axis(h, o, 1), axis=1, kind="stable"), 1) for h, o in zip(halves, best, strict=True)]
        total = np.take_along_axis(halves[0], best[0], 1)[:, i] + np.take_along_axis(halves[1], best[1], 1)[:, j]
        top = np.argpartition(-total, k - 1, axis=1)[:, :k]
        out[s : s + step] = np.sort(np.take_along_axis(best[0], i[top], 1) * codes + np.take_along_axis(best[1], j[top], 1), axis=1)
    return out


def pairs_at(dims: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors of that cosine (of equal vectors in one dimension)."""
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(2, n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dims == 1:
        return x, x
    y -= (x * y).sum(1, keepdims=True) * x
    return x, cosine * x + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)


def share_met(x: np.ndarray, y: np.ndarray, codes: int, k: int) -> float:
    """The share of the pairs x[i], y[i] that have a filter in common."""
    return float(np.mean([not set(a).isdisjoint(b) for a, b in zip(list_decode(x, codes, k).tolist(), list_decode(y, codes, k).tolist(), strict=True)]))


@functools.lru_cache(maxsize=64)
def filter_plan(dims: int, rows: int, least: float, recall: float) -> tuple[int, int]:
    """(codes, k) for a table of ``rows`` vectors: about rows / 16 filters, and the shortest lists by which ``recall`` of random pairs at the least cosine meet.

    Measured on seeded pairs.  Where lists of 64 don't reach it (few dimensions, low cosines), there are fewer filters; one filter holds all.
    """
    codes = max(32, int(rows**0.5 / 4) + 1)
    x, y = pairs_at(dims, least, 2000, dims)
    while codes > 1:
        for k in (6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64):
            if share_met(x, y, codes, k) >= recall:
                return codes, k
        codes = codes * 2 // 3
    return 1, 1


def _local_labels(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a small boolean matrix of links."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(rows: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
    """Links within each group of sorted rows of one length; a pair counts in the first filter that both pass only."""
    x = _unit(np.stack(rows["v"].to_numpy()).astype(np.float64))
    node, copies, cell = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["cell"].to_numpy()
    slot, one, filters = rows["slot"].to_numpy(), (rows["p"] == rows["q"]).to_numpy(), np.stack(rows["filters"].to_numpy())
    filters = np.where(filters < cell[:, None], filters, -1)  # those before the group's own
    change = np.zeros(len(rows), bool)
    for c in ("label", "cell", "p", "q"):
        v = rows[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    edges = np.r_[0, np.flatnonzero(change), len(rows)]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e - s < 2:
            continue
        links = x[s:e] @ x[s:e].T >= least
        np.fill_diagonal(links, False)
        if not one[s]:
            links &= slot[s:e, None] != slot[None, s:e]
        linked = np.flatnonzero(links.any(1))
        if not len(linked):
            continue
        links, f = links[np.ix_(linked, linked)], filters[s:e][linked]
        earlier, at = np.unique(f, return_inverse=True)
        held = np.zeros((len(f), len(earlier)), np.float32)
        held[np.arange(len(f))[:, None], at.reshape(f.shape)] = 1
        held[:, earlier < 0] = 0
        links &= held @ held.T == 0
        linked = linked + s
        yield pd.DataFrame({"a": node[linked], "b": node[linked][_local_labels(links)], "n": links @ copies[linked]})


def vector_links(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", recall: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; rows link if their labels are equal and the cosine in double precision is ``least`` or more.

    Vectors that are null, empty or zero or hold a null or non-finite component, and those without a label, link with nothing; nor do vectors of
    different lengths.  Repeated keys are vectors of their own; a null key counts as a vector but never as a component's smallest key unless
    all its keys are null.  Equal vectors are compared once, with their number.  Each remaining vector goes to its nearest filters; the number of filters
    grows with the rows, and the lists with it so that a pair at the least cosine meets with a probability of ``recall`` at any number of rows, closer
    pairs more surely.  A filter with many vectors is split into blocks that meet pairwise.
    """
    item = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{item}>").alias("v"), F.col(label).alias("label"))
    finite = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("label", F.when(finite, F.col("label"))).withColumns({"h": F.xxhash64("v"), "g": F.hash("v")})
    rows = cut(rows.withColumn("v", F.when(F.col("label").isNotNull(), F.col("v"))))
    linked = rows.filter("label is not null")
    copies = linked.groupBy("label", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    copies = cut(copies.withColumn("node", F.monotonically_increasing_id()))
    distinct = copies.count()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dims, part in f.groupby(f["v"].map(len)):
                x = _unit(np.stack(part["v"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"node": part["node"], "label": part["label"], "copies": part["copies"], "dims": dims, "v": part["v"], "filters": list(list_decode(x, *filter_plan(dims, distinct, least, recall)))})

    kind = dict(rows.dtypes)["label"]
    passed = cut(copies.select("node", "label", "copies", "v").mapInPandas(decode, f"node long, label {kind}, copies long, dims int, v array<{item}>, filters array<long>"))
    cells = passed.select("node", "label", "dims", F.explode("filters").alias("cell"))
    sizes = cells.groupBy("label", "dims", "cell").agg(F.ceil(F.count("*") / F.lit(_BLOCK)).cast("int").alias("blocks"), F.count("*").alias("size")).filter("size > 1").drop("size")
    cells = cells.join(sizes, ["label", "dims", "cell"]).withColumn("slot", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"p": F.least("slot", "other"), "q": F.greatest("slot", "other")})
    at = ["label", "dims", "cell", "p", "q"]
    cells = cells.select("node", *at, "slot").join(passed.select("node", "copies", "v", "filters"), "node").repartition(*at).sortWithinPartitions(*at, "node")

    def by_length(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, same in part.groupby("dims", sort=False):
            yield from _compare(same.reset_index(drop=True), least)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for f in frames:
            kept.append(f)
            if sum(map(len, kept)) < _ROWS:
                continue
            part = pd.concat(kept, ignore_index=True)
            whole = np.flatnonzero((part[at] != part[at].iloc[-1]).any(axis=1))
            stop = int(whole[-1]) + 1 if len(whole) else 0
            if stop:
                yield from by_length(part[:stop])
            kept = [part[stop:].reset_index(drop=True)]
        if kept and sum(map(len, kept)):
            yield from by_length(pd.concat(kept, ignore_index=True))

    found = cut(cells.mapInPandas(compare, "a long, b long, n long"))
    n = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    tops = connected_components(found.select("a", "b")).withColumnRenamed("component", "top")
    reps = copies.drop("v").join(n, "node", "left").join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    smallest = reps.groupBy("top").agg(F.min("rep").alias("component"))
    reps = reps.join(smallest, "top").select("label", "h", "g", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "component")
    out = rows.drop("v").join(reps, ["label", "h", "g"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
