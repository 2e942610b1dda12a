"""Ranked lexical search by NRA: impact-sorted lists are read in order, every document has a lower and an upper score, until the best are settled."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut

#: Bytes of UTF-8 that stand in a term, A-Z lower-cased; all others become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents of one search, by their postings, and postings that the first step reads of each list.
SHARD, FIRST = 2_000_000, 64


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased; null has none."""
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split() if text else []


def no_random_access(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that may stand among the ``k`` best of ``n_docs`` documents and have a score of ``floor`` or more, and above 0.

    Each list has documents and impacts, largest first.  A document's lower score is the sum of the impacts seen; its upper score adds for each list in which
    it hasn't been seen the impact last read there (0 at the list's end).  Steps read on in all lists, twice as far each time, until
    the documents whose upper score reaches the k-th largest lower score have both scores equal: membership, ties and scores are settled then.
    """
    lower = np.zeros(n_docs, np.int64)
    at, last = [0] * len(lists), [int(x[0]) for _, x in lists]
    step = FIRST
    while True:
        for i, (docs, impacts) in enumerate(lists):
            a, b = at[i], min(at[i] + step, len(docs))
            if a < b:
                lower[docs[a:b]] += impacts[a:b]
                at[i], last[i] = b, int(impacts[b - 1]) if b < len(docs) else 0
        seen = np.zeros(n_docs, np.int64)
        for i, (docs, _) in enumerate(lists):
            if last[i]:
                seen[docs[: at[i]]] += last[i]
        upper = lower + (sum(last) - seen)
        least = max(floor, 1, int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs >= k else 0)
        open_docs = np.flatnonzero(upper >= least)
        if (lower[open_docs] == upper[open_docs]).all():
            return open_docs, lower[open_docs]
        step *= 2


class Best:
    """The k best (score, key) so far, equal scores by ascending key with null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 0

    def take(self, scores: list[int], keys: list) -> None:
        self.rows = heapq.nsmallest(self.k, [*self.rows, *((-s, key is None, key) for s, key in zip(scores, keys, strict=True))], key=lambda r: r[:2] if r[1] else r)


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, their terms by number, and the number of each term."""

    ids: list
    of: list[list[int]]
    number: dict[bytes, int]

    @classmethod
    def read(cls, rows: list[tuple]) -> Items:
        number: dict[bytes, int] = {}
        of = [sorted({number.setdefault(t, len(number)) for t in terms(text)}) for _, text in rows]
        return cls([i for i, _ in rows], of, number)


def term_counts(docs: DataFrame, number: dict[bytes, int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, terms, tf): of each document with a term the terms it has in all, and which of the numbered ones it holds how often."""
    kind = docs.schema[key].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = number.keys()
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                size, held, often, ends = [], [], [], [0]
                for t in part.column("text").to_pylist():
                    found = terms(t)
                    each = Counter(found)
                    both = each.keys() & wanted
                    held += map(number.__getitem__, both)
                    often += map(each.__getitem__, both)
                    size.append(len(found))
                    ends.append(len(held))
                ends = pa.array(ends, pa.int32())
                out = pa.RecordBatch.from_arrays([part.column("key"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(held, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(often, pa.int64()))], ["key", "n", "terms", "tf"])
                yield out.filter(pa.array(np.array(size) > 0))

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInArrow(counted, f"key {kind}, n long, terms array<int>, tf array<long>")


def _searched(counts: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int, shard: int) -> DataFrame:
    """(item, key, score): the ``k`` best of each task for each item."""
    kind = counts.schema["key"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.of]

        def run(rows: pa.Table) -> None:
            n = rows.column("n").to_numpy()
            sizes = rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
            term, tf = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "tf"))
            m = 50 + 50 * n * n_docs // n_terms
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            order = np.lexsort((-impact, term))
            order = order[impact[order] > 0]
            doc, impact, term = doc[order], impact[order], term[order]
            first = np.searchsorted(term, np.arange(len(weight) + 1)).tolist()
            keys = rows.column("key")
            for b, own in zip(best, items.of, strict=True):
                if lists := [(doc[first[t] : first[t + 1]], impact[first[t] : first[t + 1]]) for t in own if first[t] < first[t + 1]]:
                    docs, scores = no_random_access(lists, len(n), k, b.floor)
                    b.take(scores.tolist(), keys.take(pa.array(docs)).to_pylist())

        held, postings, key_type = [], 0, pa.int64()
        for batch in batches:
            held.append(batch)
            key_type = batch.schema.field("key").type
            postings += len(batch.column("terms").flatten())
            if postings >= shard:
                run(pa.Table.from_batches(held))
                held, postings = [], 0
        if held:
            run(pa.Table.from_batches(held))
        for i, b in enumerate(best):
            if b.rows:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(b.rows), pa.int32()), pa.array([r[2] for r in b.rows], key_type), pa.array([-r[0] for r in b.rows], pa.int64())], ["item", "key", "score"])

    return counts.mapInArrow(search, f"item int, key {kind.simpleString()}, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", block_chars: int = 5_000_000, shard: int = SHARD
) -> DataFrame:
    """(item_key, rank, key, score): the ``k`` documents with the highest scores above 0 for each item, equal scores by ascending key (null last).

    The score of a document is the sum over the item's distinct terms of w * (1000000000 * tf div (1000 * tf + 20 * m)) with w = floor(1000 * ln((2N + 2) / (2df + 1)))
    and m = 50 + 50 * n * N div L.  Null texts have no terms.  Rows with the same key are documents of their own, and rows of
    ``items`` with the same key are items of their own; items without terms get nothing.

    The documents are a table of term counts of what the items ask for; its partitions are searched alone, in shards of about ``shard`` postings that take over
    the k-th score so far, and the k best of each task are ranked in the end.  Items go to the tasks in blocks of about ``block_chars`` characters.
    """
    asked = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    chars = asked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(chars) // block_chars))
    key_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    session, out = docs.sparkSession, None
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else asked
        own = Items.read([(r["i"], r["t"]) for r in some.collect()])
        if not own.number:
            continue
        counts = cut(term_counts(docs, own.number, text, key))
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        share = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")
        weight = np.zeros(len(own.number), np.int64)
        for r in held.select("term", F.floor(1000 * F.log(share)).cast("long").alias("w")).toLocalIterator():
            weight[r["term"]] = r["w"]
        names = session.createDataFrame([(n, i) for n, i in enumerate(own.ids)], f"item int, item_key {item_kind.simpleString()}")
        found = _searched(counts, own, weight, n_docs, n_terms, k, shard).withColumn("block", F.lit(block)).join(F.broadcast(names), "item")
        out = found if out is None else out.union(found)
    if out is None:
        out = session.createDataFrame([], f"item int, key {key_kind}, score long, block int, item_key {item_kind.simpleString()}")
    order = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")
