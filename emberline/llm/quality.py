"""Quality scores from positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from emberline.llm.common import REMEMBERED, cut

_SHAPES = 128
_CLASSES = {c: "a" for c in map(chr, range(97, 123))} | {c: "A" for c in map(chr, range(65, 91))} | {c: "9" for c in "0123456789"}


class _Shapes(dict):
    """Bucket of a word's shape: runs of lower case, upper case, digits and each other character."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        shape, last = 0, ""
        for c in word:
            k = _CLASSES.get(c) or ("a" if c.islower() else "A" if c.isupper() else c)
            if k != last:
                shape, last = (shape * 1_000_003 + ord(k)) & 0xFFFFFFFF, k
        n = ((shape * 0x9E3779B1) & 0xFFFFFFFF) >> 25
        if len(word) <= 200:  # longer ones are worked out each time instead of being remembered
            self[word] = n
        return n


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def text_features(text: str | None, shapes: _Shapes | None = None) -> np.ndarray:
    """What the classifier sees of a whole text: shares of word shapes and of pairs of them, and figures on words, lines and characters."""
    shapes = _Shapes() if shapes is None else shapes
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    ids = np.fromiter(map(shapes.__getitem__, words), np.int64, n)
    one = np.sqrt(np.bincount(ids, minlength=_SHAPES) / max(n, 1))
    two = np.sqrt(np.bincount((ids[:-1] * 37 + ids[1:] * 101) % _SHAPES, minlength=_SHAPES) / max(n - 1, 1))
    size = np.fromiter(map(len, words), np.int64, n)
    code = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    kinds = np.bincount(code, minlength=256)
    letters = int(kinds[65:91].sum() + kinds[97:123].sum() + kinds[192:].sum())
    figures = [
        np.log1p(n), np.log1p(len(lines)), np.log1p(len(text)), _ratio(size.sum(), n), float(size.std()) if n else 0.0,
        _ratio(len(set(words)), n), _ratio(len(set(lines)), len(lines)), _ratio(n, len(lines)) ** 0.5,
        _ratio(kinds[65:91].sum(), letters), _ratio(kinds[48:58].sum(), len(text)), _ratio(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum(), len(text)),
        _ratio(kinds[46], n), _ratio(kinds[44], n), _ratio(letters, len(text)), _ratio(sum(x.rstrip().endswith((".", "!", "?")) for x in lines), len(lines)),
    ]
    return np.concatenate([one, two, np.array(figures, float)]).astype(np.float32)


@dataclass(frozen=True)
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.03, decay: float = 1e-4) -> PuModel:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss by Adam.

    Where the estimate of the negatives' risk falls below zero, its gradient is reversed, as the non-negative estimator asks.
    """
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    p, u = np.clip(p, -8, 8), np.clip(u, -8, 8)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, uu = sig(gp) / len(p), sig(gu) / len(u)
        rest = np.append(uu @ u - prior * (up @ p), uu.sum() - prior * up.sum())
        pos = -prior * sig(-gp) / len(p)
        g = np.append(pos @ p, pos.sum()) + rest if negative >= 0 else -rest
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return PuModel(mean, scale, w, float(b))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 15_000) -> PuModel:
    """Learn from ``docs`` (the rows to learn from) and ``labels`` of them; both hold ``key``.

    Trusted positives are rows with label 1, the unlabelled set is drawn from all of ``docs``; each is a random sample of about ``sample`` rows, drawn row by
    row, so copies and repeated keys don't come all or none.  The class prior is the share of label 1 among the given labels, which estimates that of the
    pool if labelled rows are a fair draw from it.  Null labels and keys are ignored; with no positive the model gives 0.5 to everything.
    Several labels of one key count once, the highest winning.
    """
    labels = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("y"))
    known = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    rows = docs.count()
    width = 2 * _SHAPES + 15
    if not known["p"] or not rows:
        return PuModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    trusted = labels.filter("y = 1").filter(F.rand(11) < sample / known["p"]).select("key", F.lit(True).alias("trusted"))  # about ``sample`` rows
    x = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(trusted), "key", "left")
    x = x.withColumns({"drawn": F.rand(12) < sample / rows, "trusted": F.coalesce("trusted", F.lit(False))}).filter("trusted or drawn")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = _Shapes()
        for f in frames:
            yield pd.DataFrame({"trusted": f["trusted"], "drawn": f["drawn"], "x": [text_features(t, shapes).tolist() for t in f["text"]]})

    drawn = cut(x.mapInPandas(features, "trusted boolean, drawn boolean, x array<float>"))
    if (n := drawn.count()) > 3 * sample:  # keys that many documents share
        drawn = drawn.filter(F.rand(13) < 2 * sample / n)
    prior = min(0.99, max(0.01, known["p"] / known["n"]))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(group["x"].to_numpy()).astype(np.float64)
        trusted, drawn = group["trusted"].to_numpy(bool), group["drawn"].to_numpy(bool)
        model = fit_nnpu(z[trusted], z[drawn] if drawn.any() else z, prior)
        return pd.DataFrame({"mean": [model.mean], "scale": [model.scale], "weights": [model.weights], "bias": [model.bias]})

    fitted = drawn.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "mean array<double>, scale array<double>, weights array<double>, bias double").first()
    if fitted is None:
        return PuModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    return PuModel(np.array(fitted["mean"]), np.array(fitted["scale"]), np.array(fitted["weights"]), fitted["bias"])


def quality_score(model: PuModel, text: Column) -> Column:
    """The model's probability of label 1 for a text column; null counts as empty."""

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = _Shapes()
        for s in texts:
            x = np.stack([text_features(t, shapes) for t in s]).astype(np.float64) if len(s) else np.zeros((0, len(model.mean)))
            yield pd.Series(model.score(np.clip((x - model.mean) / model.scale, -8, 8) * model.scale + model.mean))

    return score(text)
