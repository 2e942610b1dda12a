"""Bigram language model in sharded Elias-Fano tries.

Level 1 of a shard holds the hashes of its contexts with their counts and a monotone pointer to their successors; level 2 holds the successors of all
contexts in one monotone sequence, each key being relative to its context, with the quantised smoothed probabilities beside it.
A shard is a file in the shared folder that tasks map into memory.
"""

from __future__ import annotations

import functools
import json
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from emberline.llm.common import WordHash, free_name, lower_words, shared_dir

#: No word holds a space, so no word has these hashes but by chance.
END, BEGIN = (np.uint64(WordHash()[x]) for x in (b" end", b" begin"))
_STEP = 4096.0  # quantised probabilities: -log10(p) in steps of 1 / 4096
_TOKENS = 1_500_000  # tokens that a task holds at once
_LOW32 = np.uint64(0xFFFFFFFF)


# ---------------------------------------------------------------- Elias-Fano


def ef_build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A sorted uint64 sequence below ``universe``: packed low bits, upper bits in unary, and the ones before each word of the upper bits."""
    n = len(values)
    low = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
    bits = np.zeros(((n * low + 63) // 64 + 2) * 64, np.uint8)
    for a in range(0, n if low else 0, 1 << 17):
        part = values[a : a + (1 << 17)]
        bits[a * low : (a + len(part)) * low] = ((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    top = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = (int(universe) >> low) + n + 1
    upper = np.zeros((size + 63) // 64 * 64, np.uint8)
    upper[top] = 1
    upper = np.packbits(upper, bitorder="little").view(np.uint64)
    ones = np.r_[0, np.cumsum(np.bitwise_count(upper), dtype=np.int64)].astype(np.uint32)
    return {"low": np.packbits(bits, bitorder="little").view(np.uint64), "upper": upper, "ones": ones, "meta": np.array([n, low], np.int64)}


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.upper, self.ones = parts["low"], parts["upper"], parts["ones"]
        self.n, self.bits = (int(x) for x in parts["meta"])

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Positions of the k-th ones or zeros of the upper bits."""
        before = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones if zero else self.ones.astype(np.int64)
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 16):
            part = k[a : a + (1 << 16)]
            word = np.minimum(np.searchsorted(before, part, "right") - 1, len(self.upper) - 1)
            x = self.upper[word]
            bits = np.unpackbits((~x if zero else x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rank = np.cumsum(bits, axis=1, dtype=np.uint8)
            out[a : a + (1 << 16)] = word * 64 + np.argmax(rank == (part - before[word] + 1)[:, None], axis=1)
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        pos = i.astype(np.int64) * self.bits
        at, off = pos >> 6, (pos & 63).astype(np.uint64)
        high = np.where(off == 0, np.uint64(0), self.low[at + 1] << ((np.uint64(64) - off) & np.uint64(63)))
        return ((self.low[at] >> off) | high) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i.astype(np.int64), False) - i).astype(np.uint64) << np.uint64(self.bits) | self._lows(i)

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value of at least x, among the indices lo to hi where they are given; n or hi if there is none."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        most = len(self.upper) * 64 - self.n - 1
        start = np.where(h > 0, self._select(np.clip(h - 1, 0, most), True) - (h - 1), 0)
        stop = self._select(np.clip(h, 0, most), True) - h
        start, stop = np.clip(start, 0, self.n), np.clip(stop, 0, self.n)
        if lo is not None:
            start, stop = np.clip(start, lo, hi), np.clip(stop, lo, hi)
        want = x & np.uint64((1 << self.bits) - 1)
        while len(open_ := np.flatnonzero(start < stop)):
            mid = (start[open_] + stop[open_]) // 2
            less = self._lows(mid) < want[open_]
            start[open_] = np.where(less, mid + 1, start[open_])
            stop[open_] = np.where(less, stop[open_], mid)
        return start


# ------------------------------------------------------------------- shards


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_shard(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON with the arrays' types and places, then the arrays.  Written under another name first, so a retried task leaves a whole file."""
    fs, path = _filesystem(folder)
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [v.dtype.str, len(v), at]
        at += (v.nbytes + 63) // 64 * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    fs.create_dir(path, recursive=True)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(line)
        for v in arrays.values():
            f.write(v.tobytes() + bytes(-v.nbytes % 64))
    fs.move(part, f"{path}/{name}")


@functools.lru_cache(maxsize=512)
def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """A shard's arrays in mapped memory."""
    with open(f"{_filesystem(folder)[1]}/{name}", "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return _arrays(data, data.find(b"\n") + 1)


@functools.lru_cache(maxsize=2)
def _fetched(folder: str, name: str) -> dict[str, np.ndarray]:
    """A shard's arrays from a folder that can't be mapped, in memory; few are kept."""
    fs, path = _filesystem(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        data = f.read()
    return _arrays(data, data.find(b"\n") + 1)


def _arrays(data, end: int) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(data, kind, n, end + at) for k, (kind, n, at) in json.loads(data[:end]).items()}


def _shard(folder: str, name: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    return (_mapped if isinstance(_filesystem(folder)[0], fs.LocalFileSystem) else _fetched)(folder, name)


def summed_pairs(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs with their summed counts."""
    order = np.lexsort((word, context))
    context, word, count = context[order], word[order], count[order]
    new = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])]) if len(context) else np.empty(0, np.int64)
    return context[new], word[new], np.add.reduceat(count, new) if len(new) else count


def shard_arrays(context: np.ndarray, word: np.ndarray, count: np.ndarray, base: int, span: int, discount: float) -> dict[str, np.ndarray]:
    """A shard's trie from (context hash, low 32 bits of the word's hash, count) rows, repeats included; ``base`` and ``span``: the shard's share of the hashes.

    Words of one context whose low 32 bits are equal count as one: a chance of about one in four thousand for a word after a million others.
    """
    context, word, count = summed_pairs(context, word, count)
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    total = np.add.reduceat(count, first)
    pointer = np.r_[first, len(context)].astype(np.uint64)
    owner = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(pointer.astype(np.int64)))
    prob = np.maximum(count - discount, 1e-9) / total[owner.astype(np.int64)]
    out = {"total": total.astype(np.int64), "prob": np.minimum(np.rint(-np.log10(prob) * _STEP), 65535).astype(np.uint16)}
    levels = {"context": ef_build(context[first] - np.uint64(base), span), "pointer": ef_build(pointer, len(context) + 1), "word": ef_build(owner << np.uint64(32) | word.astype(np.uint64), len(first) << 32)}
    return out | {f"{k}.{p}": v for k, x in levels.items() for p, v in x.items()}


class Shard:
    def __init__(self, arrays: dict[str, np.ndarray], base: int):
        part = lambda k: EliasFano({p: arrays[f"{k}.{p}"] for p in ("low", "upper", "ones", "meta")})
        self.context, self.pointer, self.word, self.base = part("context"), part("pointer"), part("word"), np.uint64(base)
        self.total, self.prob = arrays["total"], arrays["prob"]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Level-1 index of each hash, -1 if absent."""
        i = self.context.successor(h - self.base)
        there = i < self.context.n
        there[there] = self.context.access(i[there]) == (h - self.base)[there]
        return np.where(there, i, -1)

    def pairs(self, i: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For level-1 indices and words: the discounted probability of the pair, 0 if unseen, and the number of the context's successors."""
        lo, hi = self.pointer.access(i).astype(np.int64), self.pointer.access(i + 1).astype(np.int64)
        x = i.astype(np.uint64) << np.uint64(32) | (word & _LOW32)
        at = self.word.successor(x, lo, hi)
        there = at < hi
        there[there] = self.word.access(at[there]) == x[there]
        p = np.zeros(len(i))
        p[there] = 10 ** (self.prob[at[there]] / -_STEP)
        return p, hi - lo


# -------------------------------------------------------------------- model


@dataclass(frozen=True)
class BigramModel:
    folder: str
    log_shards: int
    present: tuple[int, ...]
    tokens: int
    vocabulary: int
    discount: float

    def _each(self, h: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """The shards that sorted hashes fall into, with the slices that do."""
        edges = np.searchsorted(h, np.array([s << (64 - self.log_shards) for s in self.present], np.uint64))
        for s, a, b in zip(self.present, edges, np.r_[edges[1:], len(h)], strict=True):
            b = a + int(np.searchsorted(h[a:b], np.uint64((s + 1 << (64 - self.log_shards)) - 1), "right"))
            if b > a:
                yield Shard(_shard(self.folder, f"{s}.trie"), s << (64 - self.log_shards)), slice(a, b)

    def score(self, hashes: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of texts given as word hashes.

        A token's probability is max(count(pair) - D, 0) / count(context) + D * successors / count(context) * base(token); after a context
        that training lacks, base(token) alone, base being (count + 1) / (N + V + 1).
        """
        size = np.array([len(x) + 1 for x in hashes])
        stops = np.cumsum(size)
        token, context = np.empty(stops[-1], np.uint64), np.empty(stops[-1], np.uint64)
        for x, b, n in zip(hashes, stops, size, strict=True):
            token[b - n : b - 1], token[b - 1], context[b - n], context[b - n + 1 : b] = x, END, BEGIN, x
        words, back = np.unique(np.concatenate([token, context]), return_inverse=True)
        token_at, context_at = back[: len(token)], back[len(token) :]
        index, total = np.full(len(words), -1), np.zeros(len(words), np.int64)
        for shard, s in self._each(words):
            index[s] = shard.find(words[s])
            known = index[s] >= 0
            total[s][known] = shard.total[index[s][known]]
        count = total.copy()  # of the token: contexts count as often as the token does, but for the first context and the last token
        ends = total[words == BEGIN]
        count[words == END], count[words == BEGIN] = (ends[0] if len(ends) else 0), 0
        base = (count + 1) / (self.tokens + self.vocabulary + 1)
        pair, pair_back = np.unique(context_at.astype(np.int64) << 32 | token_at, return_inverse=True)
        left, right = pair >> 32, pair & 0xFFFFFFFF
        p = base[right]
        edges = np.searchsorted(left, np.arange(len(words) + 1))
        for shard, s in self._each(words):
            at = slice(edges[s.start], edges[s.stop])
            own = np.flatnonzero(index[left[at]] >= 0) + at.start
            seen, successors = shard.pairs(index[left[own]], words[right[own]])
            n = total[left[own]]
            p[own] = seen + self.discount * successors / n * base[right[own]]
        starts = stops - size
        sums = [np.add.reduceat(v, starts) for v in ((count[token_at] > 0).astype(np.int64), np.log10(base)[token_at], np.log10(p)[pair_back])]
        return [(int(n), int(k), float(b), float(s)) for n, k, b, s in zip(size, *sums, strict=True)]


def fit_bigrams(train: DataFrame, text: str = "text", discount: float = 0.75, folder: str | None = None, shard_bytes: int = 64 << 20) -> BigramModel:
    """Count all pairs of neighbouring tokens of ``train`` and write the tries; null texts count as empty, one end token each.

    Tasks sum the pairs of what they hold and send them, packed by shard of the context's hash, through one shuffle; a shard's task sums them again as they
    come, so a context that is everywhere takes the room of its distinct successors.  There is a shard for each ``shard_bytes`` of text.
    Only a row of totals for each shard comes to the driver.
    """
    folder = folder or f"{shared_dir(train.sparkSession)}/trie-{uuid.uuid4().hex}"
    size = train.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()["n"] or 0
    log_shards = max(3, (size // shard_bytes).bit_length())
    shift = np.uint64(64 - log_shards)

    def packed(hashes: list[np.ndarray]) -> Iterator[dict]:
        contexts = np.concatenate([np.r_[BEGIN, x] for x in hashes])
        token = np.concatenate([np.r_[x, END] for x in hashes]) & _LOW32
        words, at = np.unique(contexts, return_inverse=True)
        pair, n = np.unique(at.astype(np.uint64) << np.uint64(32) | token, return_counts=True)
        context = words[(pair >> np.uint64(32)).astype(np.int64)]
        shard = (context >> shift).astype(np.int64)
        for a, b in zip(edges := np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), np.r_[edges[1:], len(shard)], strict=True):
            yield {"shard": int(shard[a]), "contexts": context[a:b].tobytes(), "words": pair[a:b].astype(np.uint32).tobytes(), "counts": n[a:b].astype(np.uint32).tobytes()}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, part, n = WordHash(), [], 0
        for f in frames:
            for t in f["text"]:
                part.append(known.of(lower_words(t)))
                n += len(part[-1]) + 1
                if n > _TOKENS:
                    yield pd.DataFrame(packed(part))
                    part, n = [], 0
        if part:
            yield pd.DataFrame(packed(part))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finish(shard: int, parts: list) -> pd.DataFrame:
            arrays = shard_arrays(*(np.concatenate(c) for c in zip(*parts, strict=True)), shard << int(shift), 1 << int(shift), discount)
            write_shard(folder, f"{shard}.trie", arrays)
            return pd.DataFrame({"shard": [shard], "tokens": [int(arrays["total"].sum())], "contexts": [len(arrays["total"])]})

        now, parts, fresh = None, [], 0
        for f in frames:
            for shard, *cols in zip(f["shard"], f["contexts"], f["words"], f["counts"], strict=True):
                if shard != now and parts:
                    yield finish(now, parts)
                    parts, fresh = [], 0
                now = shard
                context, word, n = (np.frombuffer(c, kind) for c, kind in zip(cols, (np.uint64, np.uint32, np.uint32), strict=True))
                parts.append((context, word, n.astype(np.int64)))
                fresh += len(n)
                if fresh > max(2_000_000, len(parts[0][2])):  # as much again as is summed already
                    parts, fresh = [summed_pairs(*(np.concatenate(c) for c in zip(*parts, strict=True)))], 0
        if parts:
            yield finish(now, parts)

    rows = train.select(F.col(text).alias("text")).mapInPandas(count, "shard int, contexts binary, words binary, counts binary")
    built = rows.repartition("shard").sortWithinPartitions("shard").mapInPandas(build, "shard int, tokens long, contexts long").collect()
    return BigramModel(folder, log_shards, tuple(sorted(r["shard"] for r in built)), sum(r["tokens"] for r in built), sum(r["contexts"] for r in built), discount)


def lm_scores(model: BigramModel, docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability); null counts as empty, one end token.

    Columns of ``docs`` with these names are replaced, all others stay.
    """
    own = free_name("lm", docs)

    @pandas_udf("struct<n_tokens:long,n_known:long,base_score:double,score:double>")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for s in texts:
            out, part, n = [], [], 0
            for t in s:
                part.append(known.of(lower_words(t)))
                n += len(part[-1]) + 1
                if n > _TOKENS // 2:
                    out += model.score(part)
                    part, n = [], 0
            out += model.score(part) if part else []
            yield pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])

    out = docs.withColumn(own, scores(F.col(text)))
    return out.withColumns({"train_tokens": F.lit(model.tokens).cast("long"), **{c: F.col(own)[c] for c in ("n_tokens", "n_known", "base_score", "score")}}).drop(own)
