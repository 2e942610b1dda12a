"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SPACE = "▁"
_NONE = np.int64(1 << 40)


def _lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray, missing: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), missing, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], missing)


@dataclass(frozen=True)
class PieceMerges:
    """The model's merges as sorted arrays.

    A pair of symbols merges if its joined text is a piece; better score first, then further left.  ``lone`` marks ranks of which
    an extension isn't strictly worse: those are applied to the leftmost place only, all others to every place at once.
    """

    chars: np.ndarray  # code points of one-character symbols, sorted
    char_ids: np.ndarray
    pairs: np.ndarray  # left id << 20 | right id, sorted
    ranks: np.ndarray
    results: np.ndarray
    lone: np.ndarray  # by rank
    joined: np.ndarray  # bigrams of characters that some piece holds, first << 21 | second, sorted
    pieces: int  # ids below it are pieces; other symbols are characters outside the vocabulary

    @classmethod
    def load(cls, path: str) -> PieceMerges:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if (n := model.normalizer_spec).name != "identity" or not n.add_dummy_prefix or n.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and identity normalisation are handled")
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        score = {i: model.pieces[i].score for i in ids.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbols = dict(ids)
        for piece in ids:
            for c in piece:
                symbols.setdefault(c, len(model.pieces) + len(symbols))
        pairs = [(symbols[p[:k]] << 20 | symbols[p[k:]], order[score[i]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        best = {}  # the best rank of a pair that the piece is a part of
        for key, rank, _ in pairs:
            for part in (key >> 20, key & 0xFFFFF):
                best[part] = min(best.get(part, rank), rank)
        lone = np.zeros(len(order), bool)
        for i in score:
            r = order[score[i]]
            lone[r] |= best.get(i, r + 1) <= r
        pairs.sort()
        chars = sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1)
        joined = sorted({ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)})
        col = lambda rows, k: np.array([r[k] for r in rows], np.int64)
        return cls(col(chars, 0), col(chars, 1), col(pairs, 0), col(pairs, 1), col(pairs, 2), lone, np.array(joined, np.int64), len(model.pieces))

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, a word being a run of characters that merges don't leave.

        All words lie in one array of symbols with the number of their run.  A round finds the lowest rank of each run by a segmented minimum
        and applies it everywhere in that run; runs without a mergeable pair leave.  Words are first split where no piece holds both characters.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        sym = _lookup(self.chars, self.char_ids, code, -1)
        width = np.select([code < 0x80, code < 0x800, code < 0x10000], [1, 2, 3], 4)  # bytes, each a token where no piece holds the character
        held = (sym >= 0) & (sym < self.pieces)
        width[held] = 1
        if not len(code):
            return np.zeros(len(words), np.int64)
        cut = np.ones(len(code), bool)
        cut[1:] = (word[1:] != word[:-1]) | (_lookup(self.joined, np.ones(len(self.joined), np.int64), code[:-1] << 21 | code[1:], 0) == 0)
        run = np.cumsum(cut) - 1
        total = np.zeros(len(words), np.int64)
        rank, into = np.empty(len(sym), np.int64), np.empty(len(sym), np.int64)
        fresh = np.arange(len(sym))  # places whose pair with the next symbol has to be looked up
        while len(sym):
            rank[fresh] = _NONE
            pair = fresh[fresh < len(sym) - 1]
            pair = pair[(run[pair] == run[pair + 1]) & (sym[pair] >= 0) & (sym[pair + 1] >= 0)]
            key = sym[pair] << 20 | sym[pair + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            rank[pair[hit]], into[pair[hit]] = self.ranks[at[hit]], self.results[at[hit]]
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            low_each = np.repeat(low, length)
            keep = low_each != _NONE
            if not keep.all():
                total += np.bincount(word[~keep], width[~keep], len(words)).astype(np.int64)
            pos = np.flatnonzero((rank == low_each) & keep)
            if not len(pos):
                break
            head = np.r_[True, np.diff(pos) != 1]  # of neighbouring places every second one, from the left
            head_at = np.flatnonzero(head)
            parity = (pos - np.repeat(pos[head_at], np.diff(np.r_[head_at, len(pos)]))) % 2 == 0
            alone = self.lone[rank[pos]]
            leftmost = np.r_[True, run[pos][1:] != run[pos][:-1]]
            pos = pos[np.where(alone, leftmost, parity)]
            sym[pos] = into[pos]
            width[pos] = 1
            keep[pos + 1] = False
            place = (np.cumsum(keep) - 1)[pos]
            near = np.zeros(int(keep.sum()), bool)
            near[place] = near[np.maximum(place, 1) - 1] = True
            fresh = np.flatnonzero(near)
            sym, run, word, width, rank, into = sym[keep], run[keep], word[keep], width[keep], rank[keep], into[keep]
        return total


@functools.cache
def _merges(path: str) -> PieceMerges:
    return PieceMerges.load(path)


class _Ids(dict):
    """Number of a word in order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class TokenCounter:
    """Counts of whole texts; the counts of words are remembered up to a bound, beyond which they are worked out anew."""

    def __init__(self, merges: PieceMerges, remembered: int = 500_000):
        self.merges, self.remembered = merges, remembered
        self.ids, self.counts = _Ids(), np.empty(0, np.int64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.ids) > self.remembered:
            self.ids, self.counts = _Ids(), np.empty(0, np.int64)
        each = [np.fromiter(map(self.ids.__getitem__, words := _pre_tokens(t)), np.int64, len(words)) if t else np.empty(0, np.int64) for t in texts]
        if new := list(itertools.islice(self.ids, len(self.counts), None)):
            self.counts = np.concatenate([self.counts, *(self.merges.count(new[a : a + 50_000]) for a in range(0, len(new), 50_000))])
        return np.array([self.counts[x].sum() for x in each], np.int64)


def _pre_tokens(text: str) -> list[str]:
    """The text in pieces that merges don't cross: each run of spaces goes with what follows; a space is put first."""
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return [SPACE + w for w in words]
    out, run = [], 1
    for w in words[:-1]:
        if w:
            out.append(SPACE * run + w)
            run = 1
        else:
            run += 1
    out.append(SPACE * run + words[-1])
    return out


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Counts are those of the library for ``model`` without begin, end or added tokens; strings of special tokens in a text are ordinary
    text.  Null counts as empty and has no token.  Existing columns of those names are replaced.
    """

    @pandas_udf("long")
    def counted(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(_merges(model))
        for s in series:
            out, part, size = [np.empty(0, np.int64)], [], 0
            for t in s:
                part.append(t)
                size += len(t or "")
                if size > 2_000_000:
                    out.append(counter(part))
                    part, size = [], 0
            yield pd.Series(np.concatenate([*out, counter(part)]))

    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.withColumns({"n_bytes": n_bytes, "n_tokens": counted(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)
