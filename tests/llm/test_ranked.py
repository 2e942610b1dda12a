"""Ranked search against its SQL, full scores by plain Python, and hard inputs."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("emberline.llm")


def term_list(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def full(docs, items, k=50):
    counts = [(key, c, sum(c.values())) for key, text in docs if (c := Counter(term_list(text)))]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for key, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(term_list(text)) if c[t])
            if score > 0:
                rows.append((-score, key is None, key))
        rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k]
        out += [(item, i + 1, r[2], -r[0]) for i, r in enumerate(rows)]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_query_matches_sql(spark):
    import __spark_entry__ as entry

    path = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    want = duck.execute(f"select item_id, rank, doc_id, score from ({entry.oracle_sql()['op11_search']})").fetchall()
    assert found(entry.queries()["op11_search"](spark, path)) == sorted(map(repr, want))


def test_search_matches_full_scores_with_ties_shards_and_blocks(spark):
    from emberline.llm.ranked import ranked_search

    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(words, k=r.choice([1, 5, 40, 200])))) for i in range(700)]
    docs += [(1000 + i, "the very same copy w1 w2 w77") for i in range(120)]  # ties beyond the 50th rank
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 30])))) for i in range(25)] + [(90, "very same W77"), (91, "nowhere"), (92, "copy copy copy")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = full(docs, items)
    assert found(ranked_search(d, b)) == want
    assert found(ranked_search(d, b, shard=500)) == want
    assert found(ranked_search(d, b, block_chars=300)) == want


def test_hard_rows(spark):
    from emberline.llm.ranked import ranked_search

    docs = [(1, None), (2, ""), (3, " .,!\n"), (None, "alpha Beta"), (None, "alpha"), (5, "ALPHA beta-gamma_delta9"), (5, "alpha beta"), (7, "İ ÉCOLE école 漢字。x"), (8, "alpha " * 60_000), (9, "a\x00b beta"), (-3, "alpha beta")]
    items = [(1, "alpha BETA"), (1, "alpha BETA"), (2, None), (3, ""), (4, "École İ 漢字"), (None, "gamma b"), (6, "x" * 100_000)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, item int")
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, rank string")
    assert found(ranked_search(d, b)) == full(docs, items)
    assert ranked_search(d.limit(0), b).count() == 0 and ranked_search(d, b.limit(0)).count() == 0


def test_reads_stop_early_and_lose_nothing():
    from emberline.llm.ranked import no_random_access

    r = np.random.default_rng(8)
    n = 20_000
    lists = []
    for size in (n, 9000, 500, 30):
        docs = r.choice(n, size, replace=False).astype(np.int32)
        impacts = -np.sort(-r.integers(1, 1000, size))
        lists.append((docs, impacts))
    exact = np.zeros(n, np.int64)
    for docs, impacts in lists:
        exact[docs] += impacts
    docs, scores = no_random_access(lists, n, 50, 0)
    assert (exact[docs] == scores).all()
    limit = np.sort(exact)[-50]
    assert set(np.flatnonzero(exact >= limit)) <= set(docs.tolist()) and len(docs) < 2000
