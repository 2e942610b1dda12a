"""Mixing sources to target weights: equal blocks of words go to sources, then to their shards, by highest quotients (Sainte-Lague)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut

_WORD = r"[^\x20\x09-\x0D]+"
#: A source has so many shards at most; beyond it the shards grow.
MOST_SHARDS = 65_536


def _number(*parts: Column) -> Column:
    """A seeded number of 60 bits, the first digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null: 0, without an array of them."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, _WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int, order: str = "source", size: str = "source_size") -> DataFrame:
    """``sizes``, one row for each source, with its ``place`` from 0 by ``order`` (nulls last), ``weight`` and ``target``.

    The weights repeat over the sources.  They share ``share`` (as a fraction) of all sizes; no target exceeds ``most`` times its source's size, and what is above
    goes to the others by weight until none is above.  That fixed point is a common level times the weight: sources whose bound is below it
    come first in the order of bound over weight, so the level is the largest one that is consistent with its own place there.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col(order).asc_nulls_last())).cast("long") - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("bound", most * F.col(size)).withColumn("_ratio", F.col("bound") / F.col("weight"))
    along = Window.orderBy("_ratio", "place")
    full = F.coalesce(F.sum("bound").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    all_of = F.sum(size).over(Window.partitionBy())
    ranked = ranked.withColumn("_level", (share[0] * all_of - share[1] * full) / (share[1] * rest))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy())
    return ranked.withColumn("target", F.least(F.col("bound").cast("double"), level * F.col("weight"))).drop("_ratio", "_level", "bound")


def sainte_lague(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of each group go one by one to the party with the highest quotient votes / (2 quota + 1), the smaller ``party`` among equals.

    Only quotients near the last seat are listed: with n parties, rounding votes * (seats - n / 2 - 1) / all votes gives quotas that all are sure of, and
    with + in place of - ones that none exceeds, which leaves about two quotients a party.  Groups without votes get nothing.
    """
    own = Window.partitionBy(group)
    total, slack = F.sum(votes).over(own), F.count(F.lit(1)).over(own) / 2 + 1
    bound = lambda n: F.coalesce(F.floor(F.when(total > 0, F.col(votes) * n / total) + 0.5), F.lit(0)).cast("long")
    x = parties.withColumns({"_low": bound(F.greatest(F.col(seats) - slack, F.lit(0.0))), "_high": bound(F.col(seats) + slack)})
    x = x.withColumn("_left", F.col(seats) - F.sum("_low").over(own))
    nth = F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array().cast("array<bigint>")))
    next_ones = x.filter(F.col(votes) > 0).select(group, party, "_left", F.col(votes).alias("_votes"), nth.alias("_nth"))
    order = Window.partitionBy(group).orderBy((F.col("_votes") / (2 * F.col("_nth") - 1)).desc(), party, "_nth")
    won = next_ones.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _left").groupBy(group, party).agg(F.count(F.lit(1)).alias("_won"))
    return x.join(won, [group, party], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_low", "_high", "_left", "_won")


def mix_sources(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2,
    block: int = 16, shard: int = 100_000, seed: int = 12,
) -> DataFrame:
    """(key, source, size, source_size, target, spans): of each row of ``docs`` the spans of words that the mix takes, ``times`` each.

    A null text has no words, a null source is a source of its own, the last.  The mix is made of blocks of ``block`` words: its blocks go to sources by their
    targets, those of a source to its shards (of about ``shard`` words and documents each) by their words.  In a shard the documents lie in seeded order;
    its quota makes whole passes over them, and what is left chooses as many blocks by seeded numbers.  So a source is within a few blocks of its
    target, a document is never taken more than ``most`` times, and all depends on the rows alone: rows with equal key and text are interchangeable.
    """
    whole = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(whole).alias("size"), _number(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(whole, F.lit(""))).alias("h"))
    rows = cut(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = source_targets(sources, weights, share, most)
    blocks = F.floor((share[0] * F.sum("source_size").over(Window.partitionBy()) / share[1]) / block + 0.5).cast("long")
    sources = sainte_lague(sources.withColumns({"all": F.lit(0), "seats": blocks}), "all", "place", "target", "seats")
    shards = F.least(F.greatest(F.ceil((F.col("source_size") + F.col("n")) / shard), F.lit(1)), F.lit(MOST_SHARDS)).cast("long")
    sources = cut(sources.select("source", "source_size", "place", "target", F.col("quota").alias("seats"), shards.alias("shards")).coalesce(1))

    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("shard", F.col("h") % F.col("shards"))
    own = dealt.groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    own = sainte_lague(own, "place", "shard", "words", "seats")
    wanted = F.least(F.col("quota") * block, most * F.col("words"))
    passes = F.floor(wanted / F.col("words")).cast("long")
    chosen = F.floor((wanted - F.col("passes") * F.col("words")) / block + 0.5).cast("int")
    number = lambda k: _number(F.lit(seed), F.col("place"), F.col("shard"), k)
    numbers = F.array_sort(F.transform(F.sequence(F.lit(0), F.ceil(F.col("words") / block).cast("int") - 1), number))
    own = own.filter("words > 0").withColumn("passes", passes).withColumn("chosen", chosen)
    own = own.select("place", "shard", "passes", F.when(F.col("chosen") > 0, F.element_at(numbers, F.col("chosen"))).otherwise(F.lit(-1)).alias("last"))

    line = Window.partitionBy("place", "shard").orderBy("h", F.col("key"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("stop", F.sum("size").over(line)).withColumn("start", F.col("stop") - F.col("size")).join(own, ["place", "shard"], "left")
    begin = lambda k: F.greatest(k * block, F.col("start")) - F.col("start")
    end = lambda k: F.least((k + 1) * block, F.col("stop")) - F.col("start")
    times = lambda k: F.col("passes") + (number(k) <= F.col("last")).cast("long")
    spans = F.transform(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)), lambda k: F.struct(begin(k).alias("start"), end(k).alias("stop"), times(k).alias("times")))
    spans = F.when(F.col("size") > 0, F.filter(spans, lambda s: s["times"] > 0)).otherwise(F.array().cast("array<struct<start: bigint, stop: bigint, times: bigint>>"))
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", spans.alias("spans"))


def words_taken(spans: Column) -> Column:
    """Words of spans, repeats counted."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]) * s["times"])
