"""Helpers that the text operators share: table access, cut lineage, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Words that one task remembers the hash of; the memory is emptied beyond it.
REMEMBERED = 300_000
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names, or one of our own where nothing is set and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "") or _OWN.get(spark.sparkContext.applicationId)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work starts from the files, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, df: DataFrame) -> str:
    """``name``, or it with underscores before it where ``df`` has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


class WordHash(dict):
    """XXH64 of a word's bytes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8; null counts as empty."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def batches(arrow_batches, *names: str) -> Iterator[tuple]:
    """The named columns of each Arrow batch as Python lists."""
    for b in arrow_batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
