"""Line dedup by a fixed-depth template tree."""

from __future__ import annotations

import itertools
import math
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from emberline.llm.common import cut, free_name, gram_hashes

_WILD = 0
_TEXT_END = 0xFE  # a byte that no UTF-8 text holds
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, _TEXT_END])
_BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _token_hashes(nb: np.ndarray, start: np.ndarray, size: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of words that lie in a row as bytes, ``lines`` having so many words, and the same with 0 for variable fields: words with digits, addresses and links, but for
    those of lines that have no other word.

    A word's hash is the sum of a fixed value for each byte times a power for its place, mixed at the end.
    """
    pos = np.arange(len(nb)) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _BASE), dtype=np.uint64)
        h = np.add.reduceat(_BYTE_VALUES[nb] * power[pos], start)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    variable = (nb >= 48) & (nb <= 57) | (nb == 64) & (pos > 0) & (pos < np.repeat(size, size) - 1)
    slashes = np.flatnonzero((nb[:-2] == 58) & (nb[1:-1] == 47) & (nb[2:] == 47)) if len(nb) > 2 else np.empty(0, np.int64)
    variable[slashes[pos[slashes + 2] == pos[slashes] + 2]] = True
    h = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    field = np.maximum.reduceat(variable.view(np.uint8), start) > 0
    fields = np.add.reduceat(field.astype(np.int64), np.cumsum(lines) - lines)
    return h, np.where(field & np.repeat(fields < lines, lines), np.uint32(_WILD), h)


@dataclass(frozen=True)
class Lines:
    """The lines of some texts: text and line numbers, token counts, hashes of the masked line and of its leaf, and all token hashes in a row."""

    text: np.ndarray
    number: np.ndarray
    size: np.ndarray
    line: np.ndarray
    leaf: np.ndarray
    tokens: np.ndarray
    start: np.ndarray


def masked_lines(texts: list[str | None], depth: int, short: int = 3) -> Lines:
    """All lines with a token.  Lines without a constant token, such as rows of numbers, have no variable fields; those of ``short`` tokens or fewer with variable fields come once
    more without, after all others, as equal ones recur whatever their template does.

    The leaf is the way down the tree: the token count, then place and hash of the first ``depth`` tokens that aren't variable, so that lines which
    begin with numbers don't all meet.  With ``depth`` 0 all leaves are 0.
    """
    buf = np.frombuffer(bytes([_TEXT_END]).join([t.encode("utf-8", "replace") if t else b"" for t in texts]), np.uint8)
    space = _SPACE[buf]
    at = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(buf) else np.zeros(0, np.int64)
    width = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 - at if len(at) else at
    ends_text = buf == _TEXT_END
    line_no, text_no = np.cumsum(ends_text | (buf == 10)), np.cumsum(ends_text)
    first_line = np.r_[0, line_no[ends_text]]
    line_no, text_no = line_no[at], text_no[at]
    start = np.flatnonzero(np.r_[True, line_no[1:] != line_no[:-1]]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(at)])
    text = text_no[start]
    number = line_no[start] - first_line[text]
    whole, tokens = _token_hashes(buf[~space], np.cumsum(width) - width, width, size) if len(at) else (np.zeros(0, np.uint32),) * 2
    again = np.flatnonzero((size <= short) & (np.minimum.reduceat(tokens, start) == _WILD)) if len(at) else np.zeros(0, np.int64)
    if len(again):
        own = np.repeat(start[again] - np.r_[0, np.cumsum(size[again])[:-1]], size[again]) + np.arange(size[again].sum())
        start, tokens = np.r_[start, len(tokens) + np.cumsum(size[again]) - size[again]], np.r_[tokens, whole[own]]
        text, number, size = np.r_[text, text[again]], np.r_[number, number[again]], np.r_[size, size[again]]
    place = np.arange(len(tokens), dtype=np.int64) - np.repeat(start, size)
    with np.errstate(over="ignore"):
        x = (tokens + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(32)
    line = np.add.reduceat(x, start) if len(start) else np.empty(0, np.uint64)
    if not depth:
        return Lines(text, number, size, line.view(np.int64), np.zeros(len(size), np.int64), tokens, start)
    fixed = np.flatnonzero(tokens != _WILD)
    owner = np.repeat(np.arange(len(size)), size)[fixed]
    turn = np.arange(len(fixed)) - np.searchsorted(owner, np.arange(len(size)))[owner] if len(fixed) else fixed
    leaf = np.zeros((len(size), depth + 1), np.uint64)
    leaf[:, 0] = size
    first = fixed[turn < depth]
    leaf[owner[turn < depth], turn[turn < depth] + 1] = x[first]
    leaf = gram_hashes(leaf.ravel(), depth + 1)[:: depth + 1]
    return Lines(text, number, size, line.view(np.int64), leaf.view(np.int64), tokens, start)


def _chunks(frames: Iterator[pd.DataFrame], chars: int = 1_000_000) -> Iterator[tuple[np.ndarray, list]]:
    """Keys and texts, about so many characters at a time; the arrays made of them take some 50 bytes a character."""
    for f in frames:
        ends = np.cumsum([len(t or "") for t in f["text"]]) // chars
        for _, part in f.groupby(ends):
            yield part["key"].to_numpy(), part["text"].tolist()


class _Leaf:
    """Templates of one leaf.  Lines come as rows of token hashes; a template is a line's tokens with 0 where members differ.

    A line joins the template that agrees with it best, if in ``least`` places or more.  Such a pair is found by its rarest places: with the places of each in one
    order, rare tokens of the leaf first and variable fields last, the first ``most`` + j of both share j at least.  Every choice of j of them is a
    key, and only templates under a line's keys are compared.  How rare a token is is counted on the leaf's first lines, and j is so large that few of those share
    a key; any order and any j find the same templates.  The first ``SCANNED`` templates need no keys: a line is compared with all of them.
    """

    MOST_KEYS, FEW, SCANNED = 120, 4.0, 48

    def __init__(self, size: int, share: float):
        self.size, self.least = size, int(np.ceil(share * size - 1e-9))
        self.most = size - self.least
        self.known: list[tuple[np.ndarray, np.ndarray]] | None = None
        self.by_key: dict[int, int | list[int]] = {}
        self.templates, self.n = np.empty((2, size), np.uint32), 0

    def _learn(self, rows: np.ndarray) -> None:
        self.known = [np.unique(c, return_counts=True) for c in rows.T]
        best = None
        for j in range(1, self.least + 1):
            if math.comb(self.most + j, j) > self.MOST_KEYS and j > 1:
                break
            self.picks = np.array([*itertools.combinations(range(self.most + j), j)])
            n = np.unique(self._keys(rows), return_counts=True)[1]
            shared = float((n * n).sum() / n.sum())
            if best is None or shared < best[0]:
                best = shared, self.picks
            if shared <= self.FEW:
                break
        self.picks = best[1]

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        order = np.empty(rows.shape, np.uint64)
        for k, (values, counts) in enumerate(self.known):
            at = np.minimum(np.searchsorted(values, rows[:, k]), len(values) - 1)
            order[:, k] = np.where(values[at] == rows[:, k], counts[at], 0)
        order = np.where(rows == _WILD, np.uint64(0xFFFFFFFFFFFFFFFF), order << np.uint64(32) | rows)
        rare = np.argsort(order, axis=1, kind="stable")[:, : int(self.picks.max()) + 1]
        with np.errstate(over="ignore"):
            x = (np.take_along_axis(rows, rare, 1).astype(np.uint64) << np.uint64(20) | rare.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key = np.zeros((len(rows), len(self.picks)), np.uint64)
            for k in range(self.picks.shape[1]):
                key = (key ^ x[:, self.picks[:, k]]) * np.uint64(0xC2B2AE3D27D4EB4F)
                key ^= key >> np.uint64(31)
        return key

    def _enter(self, keys: Sequence[int], t: int) -> None:
        for key in keys:
            have = self.by_key.setdefault(key, t)
            if isinstance(have, list):
                have.append(t)
            elif have != t:
                self.by_key[key] = [have, t]

    def take(self, rows: np.ndarray) -> list[int]:
        """The template of each row, in turn."""
        out = []
        while len(out) < len(rows) and self.n < self.SCANNED and self.known is None:
            out.append(self._joined(rows[len(out)], range(self.n)))
        if len(out) == len(rows):
            return out
        if self.known is None:
            self._learn(np.concatenate([self.templates[: self.n], rows[len(out) :]]))
            for t, keys in enumerate(self._keys(self.templates[: self.n]).tolist()):
                self._enter(keys, t)
        rest = rows[len(out) :]
        for row, keys in zip(rest, self._keys(rest).tolist(), strict=True):
            near: set[int] = set()
            for have in map(self.by_key.get, keys):
                if have is not None:
                    near.update(have) if isinstance(have, list) else near.add(have)
            out.append(self._joined(row, sorted(near), keys))
        return out

    def _joined(self, row: np.ndarray, near: list[int] | range, keys: list[int] | None = None) -> int:
        """The best of the templates ``near`` if it is near enough, else a new one, entered under ``keys``."""
        if near:
            same = ((self.templates[: self.n] if keys is None else self.templates[near]) == row).sum(1)
            best = int(same.argmax())
            if same[best] >= self.least:
                t = near[best]
                if same[best] < self.size:
                    changed = np.where(self.templates[t] == row, row, np.uint32(_WILD))
                    if keys is not None and (changed != self.templates[t]).any():
                        self._enter(self._keys(changed[None])[0].tolist(), t)
                    self.templates[t] = changed
                return t
        if self.n == len(self.templates):
            self.templates = np.concatenate([self.templates, np.empty_like(self.templates)])
        self.templates[self.n] = row
        self._enter(keys or (), self.n)
        self.n += 1
        return self.n - 1


class _Tree:
    """Leaves one after another, from rows sorted by leaf, line, document and number; of a leaf's lines only hash and template are kept."""

    BLOCK = 20_000

    def __init__(self, share: float, short: int, short_least: int):
        self.share, self.short, self.short_least, self.leaf, self.held = share, short, short_least, None, []

    def close(self) -> Iterator[tuple]:
        """The recurring lines of the leaf that ends: (line, template, first document, line number there)."""
        if self.leaf is not None:
            self._place()
            for line, t in zip(self.lines, self.of, strict=True):
                first, last, n = self.span[t]
                if first[0] != last and (n >= self.short_least or self.size > self.short or self.templates.templates[t].all()):
                    yield line, self.named[t], *first

    def _place(self) -> None:
        if self.held:
            rows = np.frombuffer(b"".join(x[1] for x in self.held), np.uint32).reshape(len(self.held), self.size)
            for (line, _, first, last, n), t in zip(self.held, self.templates.take(rows), strict=True):
                if t == len(self.span):
                    self.span.append([first, last, n])
                    self.named.append(line)
                else:
                    x = self.span[t]
                    self.span[t] = [min(x[0], first), max(x[1], last), x[2] + n]
                self.lines.append(line)
                self.of.append(t)
            self.held = []

    def open(self, leaf: int, size: int) -> None:
        self.leaf, self.size, self.templates = leaf, size, _Leaf(size, self.share)
        self.lines, self.of, self.span, self.named, self.held = array("q"), array("i"), [], [], []

    def take(self, line: int, tokens: bytes, doc, number: int, last, n: int) -> None:
        if self.held and self.held[-1][0] == line:
            self.held[-1][3] = max(self.held[-1][3], last)
            self.held[-1][4] += n
        else:
            if len(self.held) >= self.BLOCK:
                self._place()
            self.held.append([line, tokens, (doc, number), last, n])


def recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", share: float = 0.8, depth: int = 3, short: int = 3, short_least: int = 10) -> DataFrame:
    """(line, template, keep_key, keep_number): masked lines of the templates that occur in more than one document, with their first occurrence.

    Lines go down the tree by token count and their first ``depth`` constant tokens; in a leaf a line joins the template that it agrees with
    best, in ``share`` of its tokens at least, and the tokens that differ become variable fields; else it starts a template.  A template with variable fields of ``short`` tokens or
    fewer, such as "Page 12 of", says little, so it recurs only with ``short_least`` occurrences, a line counting once a document; equal lines
    recur in any case.  Lines without a constant token must be equal.  Tasks send a line once for all that they hold of it,
    so a line that is everywhere adds a few rows per task; a leaf comes to one task in order, which keeps a hash and a template number for each line.
    """
    kind = dict(docs.dtypes)[key]

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, texts in _chunks(frames):
            x = masked_lines(texts, depth, short)
            doc = keys[x.text]
            own = np.unique(doc, return_inverse=True)[1]
            order = np.lexsort((x.number, own, x.line))
            edge = np.r_[True, np.diff(x.line[order]) != 0] if len(order) else np.zeros(0, bool)
            first = np.flatnonzero(edge)
            last = order[np.r_[first[1:], len(order)] - 1] if len(order) else order
            at = order[first]
            once = edge | np.r_[True, np.diff(own[order]) != 0] if len(order) else edge
            held = np.add.reduceat(once.astype(np.int64), first) if len(order) else first  # documents
            raw = x.tokens.tobytes()
            own = [raw[4 * a : 4 * (a + n)] for a, n in zip(x.start[at].tolist(), x.size[at].tolist(), strict=True)]
            yield pd.DataFrame({"leaf": x.leaf[at], "line": x.line[at], "size": x.size[at], "tokens": own, "doc": doc[at], "number": x.number[at], "last": doc[last], "n": held})

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, names = _Tree(share, short, short_least), ["line", "template", "keep_key", "keep_number"]
        for f in frames:
            leaf, out = f["leaf"].to_numpy(), []
            edge = np.r_[True, leaf[1:] != leaf[:-1], True]
            alone = edge[:-1] & edge[1:]  # leaves of one row need no template
            if len(f):
                alone[0] &= leaf[0] != tree.leaf
                alone[-1] = False  # the next frame may go on with it
            spread = f[alone & (f["doc"] != f["last"]).to_numpy()]
            spread = spread[np.array([n >= short_least or size > short or bool(np.frombuffer(b, np.uint32).all()) for n, size, b in zip(spread["n"], spread["size"], spread["tokens"], strict=True)], bool)]
            out += zip(spread["line"].tolist(), spread["line"].tolist(), spread["doc"].tolist(), spread["number"].tolist(), strict=True)
            rest = f[~alone]
            for r in zip(*(rest[c].tolist() for c in f.columns), strict=True):
                if r[0] != tree.leaf:
                    out += tree.close()
                    tree.open(r[0], r[2])
                tree.take(r[1], r[3], r[4], r[5], r[6], r[7])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(tree.close()), columns=names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    rows = rows.mapInPandas(summed, f"leaf long, line long, size int, tokens binary, doc {kind}, number int, last {kind}, n long")
    rows = rows.repartition("leaf").sortWithinPartitions("leaf", "line", "doc", "number")
    return rows.mapInPandas(grow, f"line long, template long, keep_key {kind}, keep_number int")


def dropped_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", share: float = 0.8, depth: int = 3, short: int = 3, short_least: int = 10) -> DataFrame:
    """(key, numbers): of each document the sorted numbers of the lines to drop, those of recurring templates but for each template's first occurrence."""
    recurring = cut(recurring_lines(docs, text, key, share, depth, short, short_least))
    kind = dict(docs.dtypes)[key]

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, texts in _chunks(frames):
            x = masked_lines(texts, 0, short)
            yield pd.DataFrame({"line": x.line, "doc": keys[x.text], "number": x.number})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    places = rows.mapInPandas(listed, f"line long, doc {kind}, number int").join(recurring.hint("merge"), "line")
    places = places.filter("doc <> keep_key or number <> keep_number")
    return places.groupBy("doc").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the lines of recurring templates but for the first occurrence of each, by (key, line number); n_dropped counts them.

    Every row stays, with what is left of its text (empty if all its lines recur).  Null texts and null keys are left alone; rows with the same key lose the same
    line numbers.  A column n_dropped of ``docs`` is replaced, all others stay.
    """
    marks = dropped_lines(docs, text, key, **how)
    own, gone = free_name("doc", docs), free_name("numbers", docs)
    marks = marks.select(F.col("doc").alias(own), F.col("numbers").alias(gone))

    @pandas_udf("string")
    def without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out) for t, out in zip(texts, (set() if n is None else set(n) for n in numbers), strict=True)], dtype=object)

    out = docs.join(marks, F.col(key) == F.col(own), "left")
    left = without(F.when(F.col(gone).isNotNull(), F.col(text)), F.col(gone))  # only texts that lose lines go to Python
    return out.withColumns({text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(left), "n_dropped": F.coalesce(F.size(gone), F.lit(0))}).drop(own, gone)
