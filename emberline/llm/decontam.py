"""Benchmark decontamination: n-gram seeds, a count of the words in common, then Smith-Waterman alignment of the passages they point at."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import WordHash, gram_hashes, lower_words

#: A seed of more items than this is common: its items are looked at only if the text holds one of their rare words too.
_COMMON = 8
_SCORE = 1 << 20  # alignments carry score * _SCORE + matched words in one number
_PAD_ITEM, _PAD_TEXT = np.uint64(1), np.uint64(2)


def align(items: list[np.ndarray], texts: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of items[i] with texts[i] (word hashes), all pairs at once: best local score and the matched words of it.

    Each step takes the next word of every item; a gap in the item becomes a running maximum along the text.
    """
    rows, cols = max(map(len, items)), max(map(len, texts))
    a = np.full((len(items), rows), _PAD_ITEM)
    b = np.full((len(items), cols), _PAD_TEXT)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    hit, miss, skip = match * _SCORE + 1, mismatch * _SCORE, -gap * _SCORE
    ramp = np.arange(1, cols + 1, dtype=np.int64) * skip
    last = np.zeros((len(items), cols + 1), np.int64)
    best = np.zeros(len(items), np.int64)
    for r in range(rows):
        here = last[:, :-1] + np.where(a[:, r, None] == b, hit, miss)
        np.maximum(here, last[:, 1:] - skip, out=here)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        last[:, 1:] = here
        np.maximum(best, here.max(1), out=best)
    score = (best + _SCORE // 2) // _SCORE
    return score, best - score * _SCORE


def fewest_matched(size: int, least: float) -> int:
    """The fewest words of an item of ``size`` words that are ``least`` of it."""
    return int(np.ceil(least * size - 1e-9))


def seed_size(size: int, least: float, n: int) -> int:
    """Words of a seed: the missing words cut the others into runs, and the longest run has so many at least (``n`` at most are needed)."""
    have = fewest_matched(size, least)
    return max(1, min(n, -(-have // (size - have + 1))))


@dataclass(frozen=True)
class ItemIndex:
    """Word hashes of a block of benchmark items and their n-grams, sorted: a seed is an n-gram with the items and places that hold it."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # into item and place, by gram
    item: np.ndarray
    place: np.ndarray
    sizes: tuple[int, ...]  # lengths of n-grams
    bags: list[tuple[np.ndarray, np.ndarray]]  # distinct words of each item, sorted, with their numbers
    rare: np.ndarray  # distinct rare words of all items, sorted
    rare_first: np.ndarray  # into rare_item, by rare word
    rare_item: np.ndarray
    common: list[np.ndarray]  # places in ``item`` and ``place`` of each item's common seeds

    @classmethod
    def of(cls, rows: list[tuple], n: int, least: float) -> ItemIndex:
        known = WordHash()
        rows = [(i, known.of(w)) for i, t in rows if (w := lower_words(t))]
        size = [seed_size(len(w), least, n) for _, w in rows]
        each = [gram_hashes(w, s) for (_, w), s in zip(rows, size, strict=True)]
        flat = np.concatenate([*each, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(rows)), [len(g) for g in each])
        place = np.concatenate([*(np.arange(len(g)) for g in each), np.empty(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        first, item, place = np.r_[first, len(flat)], item[order], place[order].astype(np.int64)
        bags = [np.unique(w, return_counts=True) for _, w in rows]
        held, items_of = np.unique(np.concatenate([w for w, _ in bags] or [np.empty(0, np.uint64)]), return_counts=True)
        rare: list[tuple[int, int]] = []
        for i, (w, n) in enumerate(bags):  # so many of its rarest words that a match can't miss all of them
            k = np.argsort(items_of[np.searchsorted(held, w)], kind="stable")
            need = int(np.searchsorted(np.cumsum(n[k]), n.sum() - fewest_matched(int(n.sum()), least), "right")) + 1
            rare += [(int(x), i) for x in w[k[:need]]]
        rare.sort()
        words, at = np.unique(np.array([x for x, _ in rare], np.uint64), return_index=True)
        often = np.flatnonzero(np.repeat(np.diff(first) > _COMMON, np.diff(first)))
        by_item = np.argsort(item[often], kind="stable")
        common = np.split(often[by_item], np.searchsorted(item[often][by_item], np.arange(1, len(rows)))) if rows else []
        return cls([i for i, _ in rows], [w for _, w in rows], grams, first, item, place, tuple(sorted(set(size))), bags, words, np.r_[at, len(rare)], np.array([i for _, i in rare], np.int64), common)


def _hits(index: ItemIndex, seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and diagonals of seeds found at places of a text."""
    many = index.first[seeds + 1] - index.first[seeds]
    own = np.repeat(index.first[seeds] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return index.item[own], np.repeat(at, many) - index.place[own]


def _passages(h: np.ndarray, index: ItemIndex, least: float) -> Iterator[tuple[int, int, int]]:
    """(item, start, stop) of a text's passages that hold a seed of an item and enough of its words, neighbouring seeds along a diagonal taken together.

    Rare seeds name their items at once; a common one, such as an instruction that all items begin with, names those of its items of which the text
    holds a rare word.  An item's rare words are so many that a match can't miss all of them, so nothing is lost.
    A passage reaches twice the item's length beyond its seeds: an alignment spends more on extra words beyond that than its matches give.
    """
    seeds, at = [], []
    for n in index.sizes:
        g = gram_hashes(h, n)
        k = np.minimum(np.searchsorted(index.grams, g), len(index.grams) - 1)
        hit = np.flatnonzero(index.grams[k] == g)
        seeds.append(k[hit])
        at.append(hit)
    seeds, at = np.concatenate(seeds), np.concatenate(at)
    if not len(seeds):
        return
    many = index.first[seeds + 1] - index.first[seeds]
    often = many > _COMMON
    item, diagonal = _hits(index, seeds[~often], at[~often])
    if often.any():
        k = np.minimum(np.searchsorted(index.rare, words := np.unique(h)), len(index.rare) - 1)
        k = k[index.rare[k] == words]
        near = np.unique(np.concatenate([index.rare_item[a:b] for a, b in zip(index.rare_first[k], index.rare_first[k + 1], strict=True)] or [np.empty(0, np.int64)]))
        own = np.concatenate([index.common[i] for i in near.tolist()] or [np.empty(0, np.int64)])
        gram = np.searchsorted(index.first, own, "right") - 1
        order = np.argsort(seeds[often], kind="stable")
        seeds, at = seeds[often][order], at[often][order]
        a, b = np.searchsorted(seeds, gram), np.searchsorted(seeds, gram, "right")
        own = np.repeat(own, b - a)
        spot = np.arange(len(own)) - np.repeat(np.cumsum(b - a) - b, b - a)
        item, diagonal = np.r_[item, index.item[own]], np.r_[diagonal, at[spot] - index.place[own]]
    if not len(item):
        return
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    lengths = np.array([len(index.words[i]) for i in item])
    new = np.r_[True, (item[1:] != item[:-1]) | (np.diff(diagonal) > 2 * lengths[1:]), True]
    for a, b in zip(edges := np.flatnonzero(new), edges[1:], strict=False):
        i, size = int(item[a]), int(lengths[a])
        start, stop = max(0, int(diagonal[a]) - 2 * size), int(diagonal[b - 1]) + 3 * size
        words, times = index.bags[i]
        k = np.minimum(np.searchsorted(words, h[start:stop]), len(words) - 1)
        both = np.bincount(k[words[k] == h[start:stop]], minlength=len(words))
        if np.minimum(both, times).sum() >= fewest_matched(size, least):
            yield i, start, stop


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, n: int = 3, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """(key, item_key, similarity, matched, score, start_word, end_word) of documents that hold an exact, edited or paraphrased copy of a benchmark item.

    Similarity is the share of the item's words that the best local alignment matches; rows have ``least`` or more, the best passage of each pair.
    Seeds are runs of up to ``n`` of an item's words, shorter for short items: if the words that are missing and the places where a document adds words
    are no more than the words that may be missing, one run stays whole, however often it occurs.  Passages with a seed are aligned if they hold
    ``least`` of the item's words in any order, equal ones in a batch once.  The items go to the tasks in blocks of about ``block_words`` words, so a
    larger benchmark costs more scans and no more memory.  Items and texts that are null or without words match nothing.  Repeated keys are
    handled as one document each.
    """
    items = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter("t is not null and i is not null")
    words = items.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(words) // block_words))
    kinds = dict(docs.dtypes) | {"item": dict(benchmark.dtypes)[item_key]}
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block) if blocks > 1 else items
        index = ItemIndex.of(sorted(((r["i"], r["t"]) for r in rows.collect()), key=lambda r: (str(r[0]), r[1])), n, least)
        if not len(index.grams):
            continue
        one = _block_matches(docs, index, least, key, text, item_key, kinds)
        found = one if found is None else found.union(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"{key} {kinds[key]}, {item_key} {kinds['item']}, similarity double, matched int, score int, start_word int, end_word int")
    best = found.groupBy(key, item_key).agg(F.max(F.struct("similarity", "score", F.negative("start_word").alias("s"), "matched", "end_word")).alias("m"))
    return best.select(key, item_key, "m.similarity", "m.matched", "m.score", F.negative("m.s").alias("start_word"), "m.end_word")


def _block_matches(docs: DataFrame, index: ItemIndex, least: float, key: str, text: str, item_key: str, kinds: dict[str, str]) -> DataFrame:
    names = ["key", "item", "similarity", "matched", "score", "start_word", "end_word"]

    def verify(rows: list[tuple]) -> pd.DataFrame:
        """Output rows for (key, item, start, passage) rows."""
        distinct = {(i, p): 0 for _, i, _, p in rows}
        pairs = sorted(distinct, key=lambda x: len(index.words[x[0]]) + len(x[1]) // 8)
        texts = [np.frombuffer(p, np.uint64) for _, p in pairs]
        a = 0
        while a < len(pairs):  # passages of like length, about a million cells of a row at once at most
            b = min(len(pairs), a + 2000)
            while b > a + 1 and (b - a) * (len(index.words[pairs[b - 1][0]]) + len(texts[b - 1])) > 1_000_000:
                b = (a + b + 1) // 2
            score, matched = align([index.words[i] for i, _ in pairs[a:b]], texts[a:b])
            distinct.update(zip(pairs[a:b], zip(score.tolist(), matched.tolist(), strict=True), strict=True))
            a = b
        out = []
        for k, i, start, p in rows:
            score, matched = distinct[i, p]
            size = len(index.words[i])
            if matched >= fewest_matched(size, least):
                out.append((k, index.ids[i], matched / size, matched, score, start, start + len(p) // 8))
        return pd.DataFrame(out, columns=names)

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for f in frames:
            rows, cells = [], 0
            for k, t in zip(f["key"], f["text"], strict=True):
                if len(h := known.of(lower_words(t))):
                    for i, start, stop in _passages(h, index, least):
                        rows.append((k, i, start, h[start:stop].tobytes()))
                        cells += len(rows[-1][3])
                    if cells > 16_000_000:
                        yield verify(rows)
                        rows, cells = [], 0
            yield verify(rows)

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    out = source.mapInPandas(match, f"key {kinds[key]}, item {kinds['item']}, similarity double, matched int, score int, start_word int, end_word int")
    return out.withColumnsRenamed({"key": key, "item": item_key})
