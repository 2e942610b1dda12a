"""Best-fit packing of documents into token sequences, shrunk first by dominance."""

from __future__ import annotations

import functools
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from emberline.llm.common import cut

#: Texts that hold one of these are tokenized whole: white space on which Arrow and the tokenizer differ, and the starts of special tokens.
_WHOLE = r"<\||[\x1c-\x1f]"
#: ASCII punctuation that ends a word is a token of its own, so it is set apart; fewer distinct words are left.
_CLOSING = r"([0-9A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ])([!-/:-@\[-`{-~]+)([ \t\n\r]|$)"
#: Marks that may join an ASCII letter, and the capital that becomes a letter with one; texts with these stay as they are.
_MARKS = "[\u0300-\u036f\u0130]"
_REMEMBERED = 300_000
#: Byte-level alphabet: bytes without a visible character of their own stand at 256 and above, in order.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def _plain(texts: pa.Array) -> pa.Array:
    """The texts with the same tokens and fewer distinct words: ASCII capitals lowered, closing punctuation set apart."""
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=_CLOSING, replacement=r"\1 \2\3")
    return pc.if_else(pc.match_substring_regex(texts, pattern=_MARKS), texts, plain)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordTokenizer:
    """Token ids of texts for tokenizers that drop white space and never join words across it: each distinct word is tokenized once and remembered.

    Arrow splits the texts and numbers the distinct words of a batch; only those are looked up in Python.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.merges = self.tokenizer.model
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        """Words of letters are one pre-token each and go to the merges at once, as bytes in the tokenizer's alphabet; other words take the whole way."""
        out, others = [], []
        for k, w in enumerate(words):
            if not w.isalpha() or not w.isascii() and not ("\u0130" not in w and unicodedata.is_normalized("NFC", w)):
                others.append(k)
                out.append([])
                continue
            w = w.lower() if w.isascii() else "".join(map(str.lower, w)).encode("utf-8").decode("latin-1").translate(_BYTES)
            out.append([t.id for t in self.merges.tokenize(w)])
        for k, e in zip(others, self.tokenizer.encode_batch_fast([words[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words; new ones are tokenized."""
        if len(self.known) > _REMEMBERED:
            self._empty()
        new = [w for w in words if w not in self.known]
        ids = self._word_ids(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, pattern=_WHOLE)
        split = pc.utf8_split_whitespace(_plain(pc.if_else(odd, "", texts)))
        words = split.flatten().dictionary_encode()
        n = self._learn(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        begin, size = self.starts[n], self.starts[n + 1] - self.starts[n]
        ends = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        at = ends[np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))].astype(np.int64)].tolist()
        out = [flat[a:b] for a, b in itertools.pairwise(at)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._ids(texts[k].as_py())
        return out


def _slices(texts: pa.Array, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // chars
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    yield from itertools.pairwise(edges)


def pieces_of(docs: DataFrame, path: str, text: str, key: str, size: int, end_id: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32): a document's ids and ``end_id``, in pieces of ``size`` if longer."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, end = WordTokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                out = []
                for k, ids in enumerate(tokenize(batch.column(1).slice(a, b - a)), a):
                    ids, n = ids.astype("<u4", copy=False), len(ids) + 1
                    for i, start in enumerate(range(0, n, size)):
                        crc = zlib.crc32(ids[start : start + size])
                        last = start + size >= n
                        out.append((k, i, start, n - start if last else size, zlib.crc32(end, crc) if last else crc))
                at, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(pieces, f"key {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def _dominating(left: np.ndarray, j: int, size: int) -> tuple[int, ...] | None:
    """The set of lengths with j that dominates all others, if one of the rules shows it."""
    room = size - j
    others = left[: room + 1].copy()
    if j <= room:
        others[j] -= 1  # the piece itself can't stand beside it
    fits = np.flatnonzero(others)
    if not len(fits):
        return (j,)
    i = int(fits[-1])
    small = np.repeat(fits[:3], np.minimum(others[fits[:3]], 3))[:3]
    if i == room or len(small) < 2 or small[:2].sum() > room:
        return (j, i)
    if len(small) == 3 and small.sum() <= room:
        return None
    partner = np.searchsorted(fits, room - fits, "right") - 1  # the largest second piece beside each first one
    alone = (partner >= 0) & (fits[partner] == fits) & (others[fits] < 2)
    partner = np.where(alone, partner - 1, partner)
    best = int(np.where(partner >= 0, fits + fits[partner], 0).max())
    if i >= best:
        return (j, i)
    b = int(fits[partner[-1]]) if partner[-1] >= 0 else 0
    if not b or i + b < best:
        return None
    larger = fits[fits > b]
    larger = np.repeat(larger[:2], np.minimum(others[larger[:2]], 2))[:2]
    return (j, i, b) if len(larger) < 2 or larger.sum() > room else None


def plan_packing(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """How many sequences take which lengths: (times, lengths) for ``counts`` pieces of each length.

    Dominance (Martello and Toth), from the largest length j down, i being the largest remaining length that fits beside it:
    {j} is fixed if nothing fits; {j, i} if it fills the sequence, if no two remaining pieces fit beside j, or if at most two fit and no two of them
    weigh more than i; {j, i, b} if at most two fit, it is the fullest such set, and no two pieces larger than b fit.  Whatever an
    optimal packing puts beside j can change places with such a set.  Using up pieces leaves that true, so a rule is applied as often as its
    lengths last.  Lengths that no rule fixes are packed best-fit decreasing.  The work depends on the number of lengths, not of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    plan: list[tuple[int, tuple[int, ...]]] = []
    for j in range(size, 0, -1):
        while left[j]:
            fixed = _dominating(left, j, size)
            if fixed is None:
                break
            need = np.bincount(fixed)
            times = int((left[: len(need)][need > 0] // need[need > 0]).min()) if len(fixed) > 1 or 2 * j > size else 1
            plan.append((times, fixed))
            left[: len(need)] -= times * need
    bins: dict[int, list[list]] = {}  # by room left: [times, lengths]
    open_rooms = np.zeros(size + 1, np.int64)
    for j in range(size, 0, -1):
        c = int(left[j])
        while c:
            rooms = np.flatnonzero(open_rooms[j:])
            if len(rooms):
                room = int(rooms[0]) + j
                times, lengths = bins[room].pop()
                use = min(c, times)
                if times > use:
                    bins[room].append([times - use, lengths])
                open_rooms[room] -= use
                lengths, room = (*lengths, j), room - j
            else:
                per = size // j
                use, lengths = (c // per, (j,) * per) if c >= per else (1, (j,) * c)
                room = size - j * len(lengths)
                c -= use * (len(lengths) - 1)
            c -= use
            bins.setdefault(room, []).append([use, lengths])
            open_rooms[room] += use
        left[j] = 0
    plan += [(times, lengths) for group in bins.values() for times, lengths in group]
    return plan


def pack(docs: DataFrame, path: str, size: int = 2048, text: str = "text", key: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Pieces of all documents with the sequence and the place that each has there.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset.  Null texts count as empty: one piece, the end id.  Repeated keys are packed
    as documents of their own.  Only the number of pieces of each length, at most ``size`` rows, comes to the driver.
    """
    rows = cut(pieces_of(docs, path, text, key, size, end_id).withColumn("part", F.spark_partition_id()))
    per_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[list[int]]] = {}  # by length: [first rank, sequence of it, offset]
    used, sequence = dict.fromkeys(counts, 0), 0
    for times, lengths in plan_packing(counts, size):
        at = 0
        for n in lengths:
            slots.setdefault(n, []).append([used[n], sequence, at])
            used[n] += times
            at += n
        sequence += times
    tables = {n: np.array(x, np.int64) for n, x in slots.items()}

    @pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(n), 2), np.int64)
        for x in np.unique(n):
            own, t = n == x, tables[int(x)]
            k = np.searchsorted(t[:, 0], r[own], "right") - 1
            out[own] = np.c_[t[k, 1] + r[own] - t[k, 0], t[k, 2]]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy(key, "piece")) - 1)
    ranked = ranked.join(before.hint("merge"), ["part", "length"]).withColumn("at", place("length", F.col("rank") + F.col("before")))
    return ranked.select(key, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
