"""Cross-tokenizer alignment: tokens of a byte-level BPE (A) and of a piece BPE with byte fallback (B) over the same bytes, merged in lockstep."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut
from emberline.llm.packing import _BYTES

SPACE = "▁"
#: Letters whose words are one pre-token of A in every version of Unicode, and marks that may end them.
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ]+)([.,;:!?]?)")
_AFTER_WHITE = re.compile(r"\s ")
_STRETCH = re.compile(r"(?<=\S)(?= )")
_BREAK = re.compile(r"(?<=\S)(\n)(?=\S)")
#: A tokens that one lane of the lockstep merge goes over; longer stretches have several lanes.
LANE = 512


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of all links, and which tokens of A and of B end a group.

    The tokens of all sequences lie in a row; ends are byte offsets that go on from one sequence to the next, ``first`` is where each sequence's A
    tokens begin.  Every sequence is a lane (long ones are several, cut between A tokens): one state vector holds each lane's place in A and in B, a
    step links the two tokens, then moves on in A, in B or, at a cut, in both.  Lanes that are done leave the vector.
    """
    size = np.diff(np.r_[first, len(a_ends)])
    lanes = -(-size // lane)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = np.repeat(first, lanes) + nth * lane
    stop = np.minimum(at + lane, np.repeat(first + size, lanes))
    begin = np.where(at > 0, a_ends[at - 1], 0) if len(at) else at
    bt = np.searchsorted(b_ends, begin, "right")
    cut_a, cut_b = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    link_a, link_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(at):
        link_a.append(at)
        link_b.append(bt)
        x, y = a_ends[at], b_ends[bt]
        same = x == y
        cut_a[at[same]] = cut_b[bt[same]] = True
        at, bt = at + (x <= y), bt + (y <= x)
        left = at < stop
        if not left.all():
            at, bt, stop = at[left], bt[left], stop[left]
    return np.concatenate(link_a), np.concatenate(link_b), cut_a, cut_b


@dataclass(frozen=True)
class TokenizerPair:
    """Both tokenizers with the bytes of their entries.  ``ends`` are the marks that no piece of B joins to a letter, so that they can be set apart."""

    a: object
    b: object
    a_size: np.ndarray
    b_bytes: list[bytes]
    ends: frozenset[str]

    @classmethod
    def load(cls, a_path: str, b_path: str) -> TokenizerPair:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        if a.normalizer is not None or "ByteLevel(add_prefix_space=False" not in repr(a.pre_tokenizer):
            raise ValueError("A must be a byte-level BPE without normaliser and prefix space")
        known = a.get_vocab(with_added_tokens=True)
        a_size = np.zeros(max(known.values()) + 1, np.int64)
        for token, i in known.items():
            a_size[i] = len(token)  # a character for each byte
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces of B must not go on over a space or a line end")
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        joined = {p[k + 1] for p in pieces for k in range(len(p) - 1) if p[k].isalpha()}
        return cls(a, b, a_size, b_bytes, frozenset(".,;:!?") - joined)

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of parts of a text, a leading space being part of the part."""
        a: list = [None] * len(parts)
        rest = []
        model = self.a.model
        for k, p in enumerate(parts):
            m = _PLAIN.fullmatch(p)
            if m and not m[3]:
                a[k] = [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(_BYTES))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.a.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False), strict=True):
            a[k] = e.ids
        # B puts a space first; where there is none, or nothing but it, a line end takes it, which no piece joins to what follows
        b = self.b.encode([p[1:] if p[0] == " " < p else "\n" + p.lstrip(" ") for p in parts], num_threads=1)
        return a, [x if p[0] == " " < p else x[:1] if p == " " else x[2:] for x, p in zip(b, parts, strict=True)]

    def parts(self, stretch: str) -> list[str]:
        """A stretch (a space and what follows up to the next space after a non-space) in parts at whose ends both tokenizers always cut."""
        m = _PLAIN.fullmatch(stretch)
        if m:
            return [stretch] if not m[3] else [stretch[:-1], m[3]] if m[3] in self.ends else [stretch]
        if "\n" in stretch:
            whole = _BREAK.split(stretch)
            if len(whole) > 1:
                return [p for w in whole for p in ([w] if w == "\n" else self.parts(w))]
        return [stretch]


@functools.cache
def _pair(a_path: str, b_path: str) -> TokenizerPair:
    return TokenizerPair.load(a_path, b_path)


def stretches(text: str) -> list[str]:
    """Space + text, cut before each space that follows a non-space; the first space of each stretch is left out.  Both tokenizers cut there whatever stands around."""
    return text.split(" ") if not _AFTER_WHITE.search(" " + text) else [s[1:] for s in _STRETCH.split(" " + text)]


class _Numbers(dict):
    """Number of a string in order of first sight."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _ragged(rows: list, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), kind, int(sizes.sum())), np.r_[0, np.cumsum(sizes)]


def _joined(ids: np.ndarray, last: np.ndarray) -> Iterator[str]:
    """The ids of each group with commas, ``last`` marking the ends of the groups."""
    text, at = [*map(str, ids.tolist())], 0
    for end in (np.flatnonzero(last) + 1).tolist():
        yield text[at] if end == at + 1 else ",".join(text[at:end])
        at = end


def _taken(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all values of some ragged rows, and how many each row has."""
    size = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


class Aligner:
    """Alignment of texts, stretch by stretch: the distinct parts of the texts so far are encoded and merged once."""

    def __init__(self, pair: TokenizerPair):
        self.pair = pair
        self.empty()

    def empty(self) -> None:
        self.words, self.parts = _Numbers(), _Numbers()
        self.word_part, self.word_first, self.word_text = np.empty(0, np.int64), np.zeros(1, np.int64), []
        self.part_text: list[str] = []
        self.per_part = np.empty((0, 4), np.int64)  # tokens of A and B, groups, links
        self.good = np.empty(0, bool)
        self.link, self.link_first = np.empty(0, np.int64), np.zeros(1, np.int64)  # A id << 32 | B id
        self.occurs = np.zeros(0, np.int64)

    def _learn_parts(self, new: list[str]) -> None:
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            a_ids, b_ids = self.pair.encode(some)
            whole = [p.encode() for p in some]
            good = np.fromiter((b"".join(map(self.pair.b_bytes.__getitem__, b)) == w for b, w in zip(b_ids, whole, strict=True)), bool, len(some))
            a, a_first = _ragged(a_ids)
            sizes = np.fromiter(map(len, whole), np.int64, len(some))
            owner = np.repeat(np.arange(len(some)), np.diff(a_first))
            good &= np.bincount(owner, self.pair.a_size[a], len(some)).astype(np.int64) == sizes
            if not good.all():  # these have no tokens
                a_ids, b_ids = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (a_ids, b_ids))
                a, a_first = _ragged(a_ids)
                owner = np.repeat(np.arange(len(some)), np.diff(a_first))
            b, b_first = _ragged(b_ids)
            b_size = np.fromiter(map(len, self.pair.b_bytes), np.int64, len(self.pair.b_bytes))
            a_ends, b_ends = np.cumsum(self.pair.a_size[a]), np.cumsum(b_size[b])
            la, lb, cut_a, cut_b = lockstep(a_ends, b_ends, a_first[:-1][np.diff(a_first) > 0])
            n_links = np.bincount(owner[la], minlength=len(some))
            order = np.argsort(owner[la], kind="stable")
            self.link = np.concatenate([self.link, (a[la] << 32 | b[lb])[order]])
            self.link_first = np.concatenate([self.link_first, self.link_first[-1] + np.cumsum(n_links)])
            counts = np.stack([np.diff(a_first), np.diff(b_first), np.bincount(owner[cut_a], minlength=len(some)), n_links], 1)
            self.per_part = np.concatenate([self.per_part, counts])
            self.good = np.concatenate([self.good, good])
            text = [f"{x}|{y}" for x, y in zip(_joined(a, cut_a), _joined(b, cut_b), strict=True)]
            at = np.r_[0, np.cumsum(counts[:, 2])].tolist()
            self.part_text += [text[i] if j == i + 1 else ";".join(text[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of each text by number, in a row, and where each text begins; null and empty texts have none."""
        each = [np.fromiter(map(self.words.__getitem__, w := stretches(t)), np.int64, len(w)) if t else np.empty(0, np.int64) for t in texts]
        known = len(self.word_text)
        if len(self.words) > known:
            new = [*itertools.islice(self.words, known, None)]
            rows = [[*map(self.parts.__getitem__, self.pair.parts(" " + w))] for w in new]
            if len(self.parts) > len(self.part_text):
                self._learn_parts([*itertools.islice(self.parts, len(self.part_text), None)])
            part, first = _ragged(rows)
            self.word_part = np.concatenate([self.word_part, part])
            self.word_first = np.concatenate([self.word_first, self.word_first[-1] + first[1:]])
            self.word_text += [self.part_text[r[0]] if len(r) == 1 else ";".join([self.part_text[p] for p in r]) for r in rows]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.concatenate([*each, np.empty(0, np.int64)]), np.r_[0, np.cumsum(sizes)]

    def take(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links) and the groups' SHA-256 of each text, then its parts in a row and how many it has; texts that a tokenizer doesn't give back have none."""
        word, first = self.number(texts)
        place, n_parts = _taken(self.word_first, word)
        part = self.word_part[place]
        at = np.repeat(np.arange(len(texts)), np.diff(first))
        owner = np.repeat(at, n_parts)
        bad = np.bincount(owner, ~self.good[part], len(texts)) > 0
        part, owner = part[~bad[owner]], owner[~bad[owner]]
        counts = np.stack([np.bincount(owner, self.per_part[part, k], len(texts)) for k in range(4)], 1).astype(np.int64)
        digests = [hashlib.sha256(";".join(map(self.word_text.__getitem__, word[i:j].tolist())).encode()).hexdigest() if j > i and not b else "" for i, j, b in zip(first.tolist(), first[1:].tolist(), bad.tolist(), strict=False)]
        self.occurs = np.bincount(part, minlength=len(self.parts)) + np.pad(self.occurs, (0, len(self.parts) - len(self.occurs)))
        return counts, digests, part, np.bincount(owner, minlength=len(texts))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the parts since the last call of ``forget``: distinct id pairs, their links, where each pair's parts begin, the parts, and how often each holds the pair."""
        part = np.flatnonzero(self.occurs)
        place, size = _taken(self.link_first, part)
        key, owner = self.link[place], np.repeat(part, size)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.empty(0, np.int64)
        times = np.diff(np.r_[new, len(key)])
        key, owner = key[new], owner[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else new
        n = np.add.reduceat(times * self.occurs[owner], first) if len(first) else first
        return key[first], n, np.r_[first, len(key)], owner, times

    def forget(self, remembered: int) -> None:
        """Start a new count; strings go too if there are more than ``remembered`` of them."""
        self.occurs = np.zeros(0, np.int64)
        if max(len(self.words), len(self.parts)) > remembered:
            self.empty()


def _parts_of(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > chars:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, groups): the groups of each text in order, each with its byte span in space + text and the ids of its tokens of A and of B.

    Texts that are null, empty or not given back by a tokenizer have an empty array.  Every row of ``docs`` gives one row.
    """
    kind = docs.schema[key].dataType.simpleString()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        aligner = Aligner(pair)
        b_size = np.array([len(x) for x in pair.b_bytes], np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for t in texts:
                word, _ = aligner.number([t])
                part = aligner.word_part[_taken(aligner.word_first, word)[0]]
                rows, start = [], 0
                if len(part) and aligner.good[part].all():
                    for g in ";".join(map(aligner.part_text.__getitem__, part.tolist())).split(";"):
                        a, b = ([int(x) for x in side.split(",")] for side in g.split("|"))
                        rows.append({"start": start, "end": (start := start + int(b_size[b].sum())), "a": a, "b": b})
                out.append(rows)
                aligner.forget(400_000)
            schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, schema)], [key, "groups"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(grouped, f"`{key}` {kind}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", remembered: int = 400_000, chars: int = 64_000_000) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``.

    A link joins two tokens that share a byte; the count of an id pair is the number of links of the whole corpus that hold it, and a link is one of the best
    if no other pair with its B id has a larger count.  Texts that are null, empty or not given back by a tokenizer have zeros and ''.  Rows with the same key or
    without one are documents of their own.

    Tasks align their texts in chunks of up to ``remembered`` distinct stretches or ``chars`` characters, and send each distinct pair of a chunk once, with the parts
    that hold it; the counts come back to the chunk by a shuffle on its number, so no task holds the pairs of the corpus.
    """
    kind = docs.schema[key].dataType
    schema = f"chunk long, key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, parts array<int>, pair long, n long, owners array<int>, times array<int>"

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, size, chunk = Aligner(_pair(a_path, b_path)), 0, TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in schema.split(", ")]

        def lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))

        def rows(many: int, key_type: pa.DataType, **columns) -> pa.RecordBatch:
            kinds = dict.fromkeys(("parts", "owners", "times"), pa.list_(pa.int32())) | {"key": key_type, "groups_sha256": pa.string()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(many, kinds.get(c, pa.int64()))) for c in names], names)

        def close(key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            pair, n, first, owner, times = aligner.pairs()
            for a in range(0, len(pair), 20_000):
                b = min(a + 20_000, len(pair))
                own = slice(first[a], first[b])
                yield rows(b - a, key_type, chunk=pa.array(np.full(b - a, chunk)), pair=pa.array(pair[a:b]), n=pa.array(n[a:b]), owners=lists(first[a : b + 1] - first[a], owner[own]), times=lists(first[a : b + 1] - first[a], times[own]))
            aligner.forget(remembered)

        key_type = None
        for batch in batches:
            key_type, texts = batch.schema.field("key").type, batch.column("text").to_pylist()
            for a, b in _parts_of(texts):
                counts, digests, part, n_parts = aligner.take(texts[a:b])
                columns = {c: pa.array(counts[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                yield rows(b - a, key_type, chunk=pa.array(np.full(b - a, chunk)), key=batch.column("key").slice(a, b - a), groups_sha256=pa.array(digests), parts=lists(np.r_[0, np.cumsum(n_parts)], part), **columns)
                size += sum(len(t or "") for t in texts[a:b])
                if size > chars or max(len(aligner.words), len(aligner.parts)) > remembered:
                    yield from close(key_type)
                    chunk, size = chunk + 1, 0
        if key_type is not None:
            yield from close(key_type)

    def summed(docs_of: pa.Table, pairs_of: pa.Table) -> pa.Table:
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        value = np.zeros((2, 1), np.int64)
        if pairs_of.num_rows:
            owner, times = flat(pairs_of, "owners"), flat(pairs_of, "times").astype(np.int64)
            many = pairs_of.column("owners").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            value = np.zeros((2, int(owner.max()) + 1), np.int64)
            for k, c in enumerate(("best", "count")):
                np.add.at(value[k], owner, times * np.repeat(pairs_of.column(c).to_numpy().astype(np.int64), many))
        part = flat(docs_of, "parts")
        ends = np.r_[0, np.cumsum(docs_of.column("parts").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        total = [np.diff(np.r_[0, np.cumsum(v[part])][ends]) for v in value]
        out = docs_of.select(["key", "n_a", "n_b", "n_groups", "n_links"])
        return out.append_column("n_best", pa.array(total[0])).append_column("count_sum", pa.array(total[1])).append_column("groups_sha256", docs_of.column("groups_sha256"))

    rows = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(aligned, schema))
    pairs = rows.filter("pair is not null")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    counts = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    pairs = pairs.select(F.col("chunk").alias("of"), "pair", "owners", "times").join(counts, "pair").select("of", "owners", "times", "count", "best")
    each = rows.filter("pair is null").select("chunk", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "parts")
    out = each.groupBy("chunk").cogroup(pairs.groupBy("of")).applyInArrow(summed, f"key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", key)
