"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import LongType

from emberline.llm.common import cut, free_name, lower_words
from emberline.llm.components import connected_components

SHINGLE, BITS, SEGMENTS = 4, 64, 8
WIDTH = BITS // SEGMENTS
#: Segments of the ring that a candidate's key covers; under the budgets below they may differ in one bit, and not in the first of them.
CHAIN = 3
_BLOCK = 1 << 15


def _shingles(text: str | None, size: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words with single spaces, and where its runs of ``size`` words begin and end; fewer words are one run, none no run."""
    words = lower_words(text)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= size:
        return joined, [0][: len(words)], [len(joined)][: len(words)]
    return joined, [0, *(ends[: len(words) - size] + 1).tolist()], ends[size - 1 :].tolist()


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit set, the lowest first."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash as a signed number: a bit is 1 if set in over half the hashes of the word shingles, repeats included."""
    joined, starts, stops = _shingles(text, SHINGLE)
    if not starts:
        return 0
    counts, n, h = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    for a in range(0, n, _BLOCK):
        counts += _votes(np.array([h(joined[x:y], 42) for x, y in zip(starts[a : a + _BLOCK], stops[a : a + _BLOCK], strict=True)], np.uint64))
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


@pandas_udf(LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(np.fromiter((fingerprint(t) for t in s), np.int64, len(s)))


def _segments(fp: str, s: str, n: int) -> Column:
    """``n`` segments of the ring from segment ``s``, the first one lowest."""
    return F.expr(f"(shiftrightunsigned({fp}, {s} * {WIDTH}) | shiftleft({fp}, {BITS} - {s} * {WIDTH})) & {(1 << n * WIDTH) - 1}L")


def _within(a: str, b: str, most: int) -> Column:
    """Pigeonring test from segment s: every chain of l segments differs in at most l * most / SEGMENTS bits; the whole ring is the Hamming check."""
    x = f"(shiftrightunsigned({a} ^ {b}, s * {WIDTH}) | shiftleft({a} ^ {b}, {BITS} - s * {WIDTH}))"
    test = F.lit(True)
    for n in range(1, SEGMENTS):
        test = test & F.expr(f"bit_count({x} & {(1 << n * WIDTH) - 1}L) <= {n * most // SEGMENTS}")
    return test & F.expr(f"bit_count({a} ^ {b}) <= {most}")


def _starts(flips: bool) -> Column:
    """An array of (s, flip): the ring's starts, with one flipped bit of the chain's later segments or none."""
    later = [1 << b for b in range(WIDTH, CHAIN * WIDTH)] if flips else []
    return F.array(*(F.struct(F.lit(s).alias("s"), F.lit(f).cast("long").alias("flip")) for s in range(SEGMENTS) for f in (0, *later)))


def _keyed(nodes: DataFrame, flips: bool) -> DataFrame:
    """Each fingerprint under the keys of its chains.  With ``flips`` also with each zero bit of the chain's later segments set: of two fingerprints that
    differ there, the one with the zero meets the other's own key, so each pair meets from one side."""
    x = nodes.select("*", F.explode(_starts(flips)).alias("at")).select(*nodes.columns, "at.s", "at.flip")
    x = x.withColumn("chain", _segments("fp", "s", CHAIN)).filter("chain & flip = 0")
    return x.withColumn("key", F.expr(f"cast(shiftleft(cast(s as long), {CHAIN * WIDTH}) | chain | flip as int)")).drop("chain", "flip")


def simhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = 4) -> DataFrame:
    """(key, fp, component_id) of every row: rows whose fingerprints are linked by steps of ``most`` or fewer bits share the smallest key.

    ``most`` is at most 4 (the keys' budgets hold for that).  Null and word-less texts have fingerprint 0.  Work is on distinct fingerprints, so
    copies never meet pairwise; sides of joins that grow with them are never broadcast.  First every fingerprint is compared with the smallest and largest one under each of its keys and the links are
    contracted; then only keys under which different components meet are expanded.  Rows with a null key keep component null unless linked.
    """
    if not 0 <= most <= 4:
        raise ValueError("most must be 0 to 4")
    fps = cut(docs.select(F.col(key).cast("long").alias("key"), simhash(F.col(text)).alias("fp")))
    nodes = cut(fps.groupBy("fp").agg(F.min("key").alias("id")))
    own = _keyed(nodes.select("fp"), False)
    ends = own.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    near = own.join(ends.hint("merge"), "key")
    stars = near.filter(_within("fp", "lo", most)).select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    stars = stars.union(near.filter(_within("fp", "hi", most)).select(F.col("fp").alias("a"), F.col("hi").alias("b")))
    first = connected_components(stars.filter("a <> b"))
    held = cut(nodes.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("c")))

    own = _keyed(held.select("fp", "c"), False)
    met = own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    abroad = _keyed(held.select("fp", "c"), True).join(met.hint("shuffle_hash"), "key").filter("lo <> c or hi <> c").select("key", "s", "fp", "c")
    other = own.select("key", F.col("fp").alias("fp2"), F.col("c").alias("c2"))
    links = abroad.join(other.hint("merge"), "key").filter("c <> c2").filter(_within("fp", "fp2", most)).select(F.col("c").alias("a"), F.col("c2").alias("b"))
    second = connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("top"))
    whole = held.join(second.hint("merge"), "c", "left").select("fp", "id", F.coalesce("top", "c").alias("top"))
    smallest = whole.groupBy("top").agg(F.min("id").alias("component_id"))
    by_fp = cut(whole.join(smallest.hint("merge"), "top").select("fp", "component_id"))
    return fps.join(by_fp.hint("merge"), "fp").select(F.col("key").alias(key), "fp", "component_id")


# ------------------------------------------------- near copies by similarity

#: Texts that say which shingles are frequent, and in how many of them those are.
ORDERED_BY, OFTEN = 20_000, 8
LANES = 4
CHAINS = 16
CHAIN_BITS = 24
#: Bits of the wide fingerprint in which documents may differ to be compared; those of 0.8 of their shingles differ in about 36.
MOST_WIDE = 48
_LANE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    joined, starts, stops = _shingles(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[x:y], 42) for x, y in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def _set_hash(h: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))) if len(h) else 0


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """A SimHash of 64 * LANES bits of a set of hashes, as bytes."""
    counts = np.zeros(BITS * LANES, np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, len(h), _BLOCK):
            part = (h[a : a + _BLOCK, None] ^ _LANE) * np.uint64(0xD6E8FEB86659FD93)
            part = (part ^ (part >> np.uint64(32))) * _LANE
            part ^= part >> np.uint64(29)
            counts += np.concatenate([_votes(part[:, k]) for k in range(LANES)])
    return np.packbits(counts * 2 > len(h), bitorder="little")


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are in ``OFTEN`` or more of some ``ORDERED_BY`` texts, sorted, and in how many they are."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [shingle_set(t, shingle) for t in f["text"]]
            yield pd.DataFrame({"s": np.concatenate([*found, np.empty(0, np.uint64)]).view("<i8")})

    share = min(1.0, ORDERED_BY / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64("key", "digest"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    found = some.mapInPandas(sets, "s long").groupBy("s").count().filter(F.col("count") >= OFTEN).toPandas()
    h = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["count"].to_numpy(np.int64)[order]


def _first(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingles of a sorted set by one of which all sets are met that share ``least`` of the larger one: the rarest first, equals by hash."""
    n = len(h)
    keep = n - math.ceil(least * n - 1e-6) + 1 if n else 0
    known, times = common
    if not len(known):
        return h[:keep]
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return h[np.lexsort((h, np.where(known[at] == h, times[at], 0)))][:keep]


#: Slots of the marks by which only rows with a wanted key are sent to the verification; all tasks know them, some 30 MB at most.
MARKS = 1 << 20


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` and ``digest`` may be among those of ``wanted``: all that are, and some others, the more the fuller ``MARKS``."""
    slot = F.pmod(F.xxhash64("key", "digest"), F.lit(MARKS)).cast("int").alias("slot")
    return rows.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")


def _chains(fp: str) -> Column:
    """The keys of a wide fingerprint (an array of 64-bit numbers): its ring's chains of three bytes, from every other byte."""
    word = lambda k: F.get(fp, k % LANES)
    own = [F.shiftrightunsigned(word(k // 4), 16 * (k % 4)) for k in range(CHAINS)]
    own = [x if k % 4 < 3 else x.bitwiseOR(F.shiftleft(word(k // 4 + 1), 16)) for k, x in enumerate(own)]
    return F.array(*(x.bitwiseAND(F.lit((1 << CHAIN_BITS) - 1)).cast("int") for x in own))


def _prefix(n: Column, least: float) -> Column:
    """How many shingles ``_first`` keeps of a set of ``n``."""
    return n - F.ceil(least * n - 1e-6) + 1


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    """Rows of the same key, or of none, and the same text."""
    return a["key"].eqNullSafe(b["key"]) & (a["digest"] == b["digest"])


def _near_copy_sets(docs: DataFrame, text: str, key: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, digest, h) of every row and (h, one, top) of every distinct set: the hash of its text, that of its set, the first row of the set (those without a key come last) and the
    group of near copies.

    Similarity is the Jaccard index of the sets of ``shingle`` words, worked out from the whole texts before a link counts.  Work is on distinct sets, each known by the number of one of
    its rows.  First each set is compared with the first and the last one under each of sixteen keys of its SimHash of 256 bits and the links are contracted, so a group of copies isn't
    written out in pairs.  That loses some, so all other links follow from shingles: of two sets that share ``least`` of the larger, the first 1 - ``least`` of their shingles in any one
    order have one in common.  Sets of different components that do are compared if their sizes allow it and if they have as many of those in common as sets of such sizes must: of the
    set whose first shingles end earlier in the order, all that are shared must be among the first of both.  The order puts shingles that are frequent in some ``ORDERED_BY`` texts last,
    which only keeps the groups small: every link is found by any order.  First shingles are kept as 32 bits, which can only bring more sets together.  Texts without words are one group.
    Sides of joins that grow with the rows are sorted, never broadcast: Spark sizes them by their compressed files and doesn't know what an explode adds.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    common = _frequent(rows, shingle)

    @pandas_udf("struct<h:long,fp:array<long>,n:int,first:array<int>>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out = []
            for t in s:
                h = shingle_set(t, shingle)
                out.append((_set_hash(h), wide_fingerprint(h).view("<i8"), len(h), _first(h, common, least).astype(np.uint32).view(np.int32)))
            yield pd.DataFrame(out, columns=["h", "fp", "n", "first"])

    fps = cut(rows.select("key", "digest", sketch("text").alias("x")).select(F.monotonically_increasing_id().alias("row"), "key", "digest", "x.*"))
    nodes = cut(fps.groupBy("h").agg(F.min("row").alias("row"), F.min(F.struct(F.col("key").isNull().alias("none"), "key", "digest")).alias("one"), *(F.any_value(c).alias(c) for c in ("fp", "n"))))
    near = lambda a, b: F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(LANES)) + f" <= {MOST_WIDE}")
    fits = lambda a, b: F.least(a, b) >= least * F.greatest(a, b) - 1e-6

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), each there once, those whose sets are similar enough."""
        pairs = cut(pairs)
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(nodes.select("row", "h", "one.key", "one.digest").hint("merge"), "row"))

        def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()  # repeated rows of a key and text mostly come to one task
            own: list[tuple[int, bytes]] = []
            for f in frames:
                for row, t, h in zip(f["row"], f["text"], f["h"], strict=True):
                    if row not in seen and _set_hash(found := shingle_set(t, shingle)) == h:
                        seen.add(row)
                        own.append((row, found.tobytes()))
                    if len(own) >= 500:
                        yield pd.DataFrame(own, columns=["row", "s"])
                        own = []
            yield pd.DataFrame(own, columns=["row", "s"])

        texts = _marked(rows.filter("text is not null"), wanted)
        known = texts.join(wanted.hint("merge"), _same_row(texts, wanted)).select("row", "h", "text").mapInPandas(sets, "row long, s binary")
        known = cut(known)

        @arrow_udf("double")
        def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
            out = []
            for p, q in zip(x, y, strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                n = len(np.intersect1d(p, q, assume_unique=True))
                out.append(n / max(1, len(p) + len(q) - n))
            return pa.array(out, pa.float64())

        left, right = known.select(F.col("row").alias("a"), F.col("s").alias("s_a")), known.select(F.col("row").alias("b"), F.col("s").alias("s_b"))
        return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(jaccard("s_a", "s_b") >= least).select("a", "b")

    own = nodes.filter("h <> 0").select("row", "fp", "n", F.posexplode(_chains("fp")).alias("c_no", "chain")).withColumn("key", F.expr(f"c_no * {1 << CHAIN_BITS} + chain")).drop("c_no", "chain")
    ends = own.groupBy("key").agg(*(f(F.struct("row", "fp", "n")).alias(c) for c, f in (("lo", F.min), ("hi", F.max)))).filter("lo.row <> hi.row")
    stars = own.join(ends.hint("merge"), "key").select("row", "fp", "n", F.explode(F.array("lo", "hi")).alias("e")).filter("row <> e.row").filter(near("fp", "e.fp")).filter(fits("n", "e.n"))
    first = connected_components(verified(stars.select(F.least("row", "e.row").alias("a"), F.greatest("row", "e.row").alias("b")).distinct()))
    held = cut(nodes.join(first.withColumnRenamed("node", "row").hint("merge"), "row", "left").select("row", "h", "one", "n", F.coalesce("component", "row").alias("c")))

    own = fps.select("row", "first").join(held.filter("h <> 0").select("row", "c").hint("merge"), "row").select("row", "c", F.explode("first").alias("key"))
    group = Window.partitionBy("key")
    mixed = own.withColumns({"lo": F.min("c").over(group), "hi": F.max("c").over(group)}).filter("lo <> hi").drop("lo", "hi")
    mixed = cut(mixed.join(held.select("row", "n").hint("merge"), "row"))
    other = mixed.select("key", *(F.col(c).alias(f"{c}2") for c in ("row", "c", "n")))
    shared = mixed.join(other.hint("merge"), "key").filter("c < c2").filter(fits("n", "n2")).groupBy(F.col("row").alias("a"), F.col("row2").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.any_value("n").alias("n"), F.any_value("n2").alias("n2"))
    must = F.ceil(least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-6)
    links = verified(shared.filter(F.col("m") >= F.least(*(must - F.col(c) + _prefix(F.col(c), least) for c in ("n", "n2")))).select("a", "b"))
    top = held.select(F.col("row").alias("a"), F.col("c").alias("c_a")), held.select(F.col("row").alias("b"), F.col("c").alias("c_b"))
    second = connected_components(links.join(top[0].hint("merge"), "a").join(top[1].hint("merge"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("top"))
    return fps.select("key", "digest", "h"), cut(held.select("h", "one", "c").join(second.hint("merge"), "c", "left").select("h", "one", F.coalesce("top", "c").alias("top")))


def near_copy_components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(key, component_id) of every row: rows linked by steps of ``least`` or more similarity share the smallest key (``_near_copy_sets``).  Rows with a null key keep component null unless linked."""
    rows, whole = _near_copy_sets(docs, text, key, shingle, least)
    smallest = whole.groupBy("top").agg(F.min("one.key").alias("component_id"))
    by_set = cut(whole.join(smallest.hint("merge"), "top").select("h", "component_id"))
    return rows.select("key", "h").join(by_set.hint("merge"), "h").select(F.col("key").alias(key), "component_id")


def without_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies (``_near_copy_sets``), the one with the smallest key; rows without a key come last.

    Every row is a text of its own, also where its key comes twice or is missing.  Of the group's rows with that key and the same text the first by the other columns stays.
    """
    rows, whole = _near_copy_sets(docs, text, key, shingle, least)
    first = whole.groupBy("top").agg(F.min("one").alias("one")).select("one.key", "one.digest")
    again = rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    first = cut(first.join(again.hint("merge"), _same_row(first, again), "left").select(first["key"], first["digest"], F.col("times").isNotNull().alias("again")))
    own, digest, mark = (free_name(c, docs) for c in ("key", "digest", "again"))
    first = first.toDF(own, digest, mark)
    own, digest, mark = first[own], first[digest], first[mark]
    held = docs.join(first.hint("merge"), docs[key].cast("long").eqNullSafe(own) & (F.xxhash64(docs[text]) == digest))
    one = held.filter(~mark).select(*(docs[c] for c in docs.columns))
    if first.filter(mark).isEmpty():
        return one
    orders = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    same = held.filter(mark).groupBy(own, digest).agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), F.struct(*(docs[c] for c in orders))).alias("row"))
    return one.unionByName(same.select("row.*"))
