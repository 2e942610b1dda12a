"""Secret scan: candidates by form, false positives removed by a random forest."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut

#: A candidate is a run of such characters, eight or more, with a digit; what is assigned to a telling name; or the head of a key block.  Quantifiers don't
#: give back and names begin at their first character, so the time is linear in the text.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-.@:])[A-Za-z0-9+/_\-.@:]{8,}+=*+")
_ASSIGNED = re.compile(r"(?<![\w.\-])([\w.\-]++)\s*+[=:]\s*+[\"']?")
_VALUE = re.compile(r"[^\s\"']{6,}")
_TELLING = re.compile(r"(?i)passw(?:or)?d|pwd|secret|token|api_?key|access_?key|credential")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,4}PRIVATE KEY(?: BLOCK)?-----")
_NAME = re.compile(r"(?i)(passw(?:or)?d|pwd|secret|token|api_?key|access_?key|private_?key|credential|bearer|auth)")
#: Forms of which the label is beyond doubt; they make the labelled findings.
_SURE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+")
_HARMLESS = re.compile(r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+\.?|\d{1,3}(\.\d{1,3}){3}(:\d+)?\.?|[+(]?[\d\-().:/]+|(?i:https?://\S+)|(?i:\S*(example|xxxx|changeme|placeholder|dummy)\S*)")
_HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")

FEATURES = ("length", "digits", "upper", "lower", "other", "transitions", "entropy", "hex", "dictionary", "named", "assigned", "quoted", "before_known", "after_known", "before", "after", "path", "path_test")
_WORD = re.compile(r"[^\W\d_]+")


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of candidates in order, none within another: key blocks first, then what is assigned to a telling name, then runs with a digit."""
    text = text or ""
    spans: list[tuple[int, int]] = []

    def add(found: Iterator[tuple[int, int]]) -> None:
        """Spans of one kind, in order, that touch none of those before."""
        taken, i, new = sorted(spans), 0, []
        for a, b in found:
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                new.append((a, b))
        spans.extend(new)

    if "-----BEGIN" in text:
        add(m.span() for m in _KEY_BLOCK.finditer(text))
    if "=" in text or ":" in text:
        add(_assigned(text))
    add(x for m in _RUN.finditer(text) if (x := _value(text, *m.span())))
    return sorted(spans)


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Spans of what is assigned to telling names; after another name the search goes on at its value, which may hold a further one."""
    at = 0
    while m := _ASSIGNED.search(text, at):
        at = m.end()
        if _TELLING.search(m[1]) and (value := _VALUE.match(text, at)):
            yield value.span()
            at = value.end()


def _value(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The run without the telling name that it begins with, if it has a digit and six characters."""
    if (eq := text.rfind("=", a, b)) > a and _NAME.search(text[a:eq]):
        a = eq + 1
    return (a, b) if b - a >= 6 and re.search(r"\d", text[a:b]) else None


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def finding_features(text: str, a: int, b: int, path: str | None, dictionary: frozenset[str] | set[str]) -> list[float]:
    """What the forest sees of the candidate text[a:b]: form, dictionary coverage, neighbouring words and path."""
    x, n = text[a:b], max(1, b - a)
    kinds = Counter(map(_kind, x))
    left, right = text[max(0, a - 80) : a], text[b : b + 80]
    before, after = _WORD.findall(left)[-3:], _WORD.findall(right)[:2]
    covered = sum(len(w) for w in _WORD.findall(x) if w.lower() in dictionary)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(x).values())
    bucket = lambda w: float(zlib.crc32(w.lower().encode()) % 64)
    return [
        float(n), kinds[0] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, sum(_kind(p) != _kind(q) for p, q in zip(x, x[1:], strict=False)) / n, entropy, float(bool(_HEX.fullmatch(x))),
        covered / n, float(bool(_NAME.search(left[-40:]))), float(left.rstrip(" \"'")[-1:] in ("=", ":")), float(left[-1:] in "\"'" and left != ""),
        float(bool(before) and before[-1].lower() in dictionary), float(bool(after) and after[0].lower() in dictionary), bucket(before[-1]) if before else 64.0, bucket(after[0]) if after else 64.0,
        bucket(path or ""), float(bool(re.search(r"(?i)test|example|sample|doc", path or ""))),
    ]


def sure_label(text: str, a: int, b: int) -> int | None:
    """1 for a known form of secret or a hex value assigned to a telling name, 0 for addresses, numbers and placeholders, else None."""
    x = text[a:b].rstrip(".,;!?#$%&*")
    if _HARMLESS.fullmatch(x):
        return 0
    if _SURE.fullmatch(x) or _HEX.fullmatch(x) and _NAME.search(text[max(0, a - 24) : a]):
        return 1
    return None


def word_dictionary(docs: DataFrame, text: str = "text", words: int = 20_000, least: int = 5) -> set[str]:
    """The most frequent words of letters, ``words`` at most and no word without all that are as frequent, counted over all documents."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            part: Counter = Counter()
            for t in f["text"]:
                part.update(t.lower().split())
                if len(part) > 400_000:
                    yield pd.DataFrame({"word": list(part), "n": list(part.values())})
                    part = Counter()
            if part:
                yield pd.DataFrame({"word": list(part), "n": list(part.values())})

    rows = docs.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(count, "word string, n long")
    rows = rows.withColumn("word", F.regexp_replace("word", r"^[\p{P}]+|[\p{P}]+$", "")).filter(F.col("word").rlike(r"^\p{L}{2,40}$"))
    rows = cut(rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    # Words of nearly equal frequency form a class; classes are taken whole from the top while they fit, so a task sends only words that stay.
    rows = rows.withColumn("class", F.floor(F.log2("n") * 16).cast("int"))
    lowest, room = None, words
    for r in sorted(rows.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):  # at most 16 for each doubling
        if r["n"] > room:
            break
        lowest, room = r["class"], room - r["n"]
    return set() if lowest is None else {r["word"] for r in rows.filter(F.col("class") >= lowest).select("word").collect()}


def found_candidates(docs: DataFrame, dictionary: set[str], text: str = "text", key: str = "doc_id", path: str = "source") -> DataFrame:
    """(key, start, stop, finding, label, x) of all candidates in whole texts; label is the sure one or null.  A missing or null path counts as empty."""
    kind, known = dict(docs.dtypes)[key], frozenset(dictionary)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t, p in zip(f["key"], f["text"], f["path"], strict=True):
                out += [(k, a, b, t[a:b], sure_label(t, a, b), finding_features(t, a, b, p, known)) for a, b in candidates(t)]
            found = pd.DataFrame(out, columns=["key", "start", "stop", "finding", "label", "x"])
            yield found.assign(label=found["label"].astype("Int32"))

    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), where.alias("path")).filter("text is not null")
    return rows.mapInPandas(scan, f"key {kind}, start int, stop int, finding string, label int, x array<double>").withColumnRenamed("key", key)


def fit_forest(labelled: DataFrame, sample: int = 20_000, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel | None:
    """A balanced forest on labelled findings (label, x), a random sample of about ``sample`` of each label; None without both labels."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    rows = labelled.filter(F.rand(seed) < rate)
    taken = {k: min(n, sample) for k, n in sizes.items()}
    rows = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"), F.when(F.col("label") == 1, 0.5 / taken[1]).otherwise(0.5 / taken[0]).alias("weight"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", minInstancesPerNode=2, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "source", least: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """(key, start, stop, finding, score) of the candidates that the forest takes for secrets, with ``least`` or more of its votes.

    ``labelled`` (columns of ``found_candidates``, label not null) are findings to learn from; without it the candidates of ``docs`` of which the form
    leaves no doubt.  Texts that are null or hold no candidate give no row; repeated documents give their rows each.  Without findings
    of both labels the sure label alone decides.
    """
    found = cut(found_candidates(docs, word_dictionary(docs, text), text, key, path))
    model = fit_forest((found if labelled is None else labelled).filter("label is not null"))
    if model is None:
        return found.withColumn("score", F.coalesce(F.col("label"), F.lit(0)).cast("double")).filter(F.col("score") >= least).select(key, "start", "stop", "finding", "score")
    scored = model.transform(found.withColumn("features", array_to_vector("x"))).withColumn("score", vector_to_array("probability")[1])
    return scored.filter(F.col("score") >= least).select(key, "start", "stop", "finding", "score")
