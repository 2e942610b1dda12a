"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from emberline.llm.common import cut

UNKNOWN = "und"
_DIMS = 1 << 14
_CHUNK = 1 << 20
#: Lengths, in letters as powers of two, for which a rejection floor is measured.
_LENGTHS = range(2, 15)
_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _codes(text: str | None) -> Iterator[np.ndarray]:
    """The lower-cased text's code points a chunk at a time, each run of what isn't a letter as one space; a space comes first and last."""
    last = _SPACE
    yield np.array([_SPACE], np.uint32)
    for a in range(0, len(text or ""), _CHUNK):
        code = np.frombuffer(text[a : a + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(_letters()[code], code, np.uint32(_SPACE))
        code = code[(code != _SPACE) | (np.r_[np.uint32(last), code[:-1]] != _SPACE)]
        if len(code):
            yield code
            last = int(code[-1])
    if last != _SPACE:
        yield np.array([_SPACE], np.uint32)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed runs of 1 to 3 characters of the lower-cased text, all but letters being spaces; empty without a letter."""
    total, seen = np.zeros(_DIMS, np.int64), np.empty(0, np.uint32)
    for fresh in _codes(text):
        code = np.r_[seen, fresh].astype(np.uint64)
        n = len(seen)
        with np.errstate(over="ignore"):
            one = code * np.uint64(0x9E3779B97F4A7C15)
            two = (one[:-1] ^ (code[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
            three = (two[:-1] ^ (code[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xC2B2AE3D27D4EB4F) if len(two) else two
        at = np.concatenate([one[n:][code[n:] != _SPACE], two[max(0, n - 1) :], three[max(0, n - 2) :]]) >> np.uint64(50)
        total += np.bincount(at.astype(np.int64), minlength=_DIMS)
        seen = np.r_[seen, fresh][-2:]
    if len(seen) < 2:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def _length(letters: float) -> int:
    """The power of two of a length in letters, within the measured ones."""
    return int(min(max(np.log2(max(letters, 1)), _LENGTHS[0]), _LENGTHS[-1]))


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and each row's cosine to its own; starts from rows spread by farthest-first choice."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


def _grams(n: np.ndarray) -> float:
    """About how many letters gave these counts of runs of one to three characters."""
    return float(n.sum()) / 3


def _probes(text: str, r: np.random.Generator) -> Iterator[tuple[int, bool, str]]:
    """(length, shuffled, text): a passage of each length from the text, and the same with its letters dealt anew, as writing of no language."""
    for k in _LENGTHS:
        if len(text) < 1.5 * 2**k and k > _LENGTHS[0]:
            break
        a = int(r.integers(0, max(1, len(text) - int(1.2 * 2**k) + 1)))
        part = text[a : a + int(1.2 * 2**k)]
        letters = [c for c in part if c.isalpha()]
        dealt = iter(r.permutation(letters).tolist() if letters else [])
        yield k, False, part
        yield k, True, "".join(next(dealt) if c.isalpha() else c for c in part)


@dataclass(frozen=True)
class CentroidModel:
    """idf by bucket, centroids (rows) with their languages, and for each length the cosine below which a text is too far from every centroid."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def cosines(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Cosine to each centroid of a text given by its counts."""
        v = np.log1p(n) * self.idf[at]
        return (v @ self.centroids[:, at].T) / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        at, n = ngram_counts(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0, True
        cos = self.cosines(at, n)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[best], score, bool(score < self.floors[_length(_grams(n)) - _LENGTHS[0]])


def fit_language_centroids(train: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 1000, clusters: int = 4) -> CentroidModel:
    """Fit on a bounded sample of labelled rows: about ``per_lang`` of each language, drawn row by row, so copies don't come all or none.

    Rows with null text or language are left out; no usable row gives a model that rejects everything.  Idf counts and the clusters of each language
    are made by Spark over that sample.  The floors are measured on a quarter of it: at each length, passages of the sample and the same passages with
    their letters shuffled are compared with the centroids, and the floor lies half way between the lowest of the former (neighbouring lengths
    counted in) and the highest hundredth of the latter; where the two overlap (very short texts), at nine tenths of the lower one, so that clean short texts pass.
    """
    train = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    rates = {r["lang"]: min(1.0, per_lang / r["n"]) for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    nothing = CentroidModel(np.zeros(_DIMS), [], np.zeros((0, _DIMS)), np.zeros(len(_LENGTHS)))
    if not rates:
        return nothing
    rate = F.create_map(*(F.lit(x) for kv in sorted(rates.items()) for x in kv))[F.col("lang")]

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, r = [], np.random.default_rng(len(f))
            for i, (t, x) in enumerate(zip(f["text"], f["lang"], strict=True)):
                rows.append((x, 0, False, *ngram_counts(t)))
                for k, shuffled, probe in _probes(t, r) if i % 4 == 0 else ():
                    rows.append((x, k, shuffled, *ngram_counts(probe)))
                if len(rows) >= 300 or i == len(f) - 1:
                    yield pd.DataFrame(rows, columns=["lang", "length", "shuffled", "at", "n"])
                    rows = []

    sample = train.filter(F.rand(5) < rate)
    probes = cut(sample.mapInPandas(features, "lang string, length int, shuffled boolean, at array<int>, n array<long>").filter("size(at) > 0"))
    sample = probes.filter("length = 0")
    idf, rows = np.zeros(_DIMS), sample.count()
    for r in sample.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():
        idf[r["at"]] = np.log(1 + rows / r["df"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), _DIMS), np.float32)
        for k, (at, n) in enumerate(zip(group["at"], group["n"], strict=True)):
            x[k, at] = np.log1p(n) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, _ = _spherical_kmeans(x[np.lexsort(x[:, :8].T)], clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": list(c.astype(float))})

    got = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>").collect()
    if not got:
        return nothing
    got.sort(key=lambda r: (r["lang"], r["centroid"]))
    model = CentroidModel(idf, [r["lang"] for r in got], np.array([r["centroid"] for r in got], np.float32).reshape(-1, _DIMS), np.zeros(len(_LENGTHS)))

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"length": [_length(_grams(n)) for n in f["n"]], "shuffled": f["shuffled"], "cos": [float(model.cosines(a, n).max()) for a, n in zip(f["at"], f["n"], strict=True)]})

    cos = probes.mapInPandas(compared, "length int, shuffled boolean, cos double").groupBy("length").agg(F.min(F.expr("if(shuffled, null, cos)")).alias("own"), F.expr("percentile(if(shuffled, cos, null), 0.99)").alias("other"))
    floors, by = np.zeros(len(_LENGTHS)), {r["length"]: (r["own"], r["other"]) for r in cos.collect()}
    for k in _LENGTHS:
        own, other = by.get(k, (None, None))
        own = min((by[i][0] for i in (k - 1, k, k + 1) if i in by and by[i][0] is not None), default=None)
        if own is None or other is None:
            floors[k - _LENGTHS[0]] = floors[max(0, k - _LENGTHS[0] - 1)]  # no text is so long: as for the length before
        else:
            floors[k - _LENGTHS[0]] = (own + other) / 2 if own > other else 0.9 * min(own, other)
    return replace(model, floors=floors)


def predicted_language(model: CentroidModel, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column: the nearest centroid's language and cosine; ``und`` and rejected where there is no letter."""

    @pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang_pred", "score", "rejected"])

    return predict(text)
