"""Source mixing against its SQL, plain apportionment and hard inputs."""

import random

import duckdb
import pytest

pytest.importorskip("emberline.llm")


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query_matches_sql(spark, folder):
    import __spark_entry__ as entry

    path = f"/root/testdata/{folder}"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{path}/documents.parquet'")
    got = entry.queries()["op12_mixing"](spark, path)
    columns = "doc_id size source_size target taken".split()
    want = duck.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()['op12_mixing']})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)
    assert sorted(map(tuple, entry.queries()["op12_mixing"](spark, path).repartition(7).select(columns).collect())) == sorted(want)


def test_quotas_are_the_highest_quotients(spark):
    from emberline.llm.mixing import sainte_lague

    r = random.Random(4)
    groups = {0: [r.randrange(1, 1000) for _ in range(30)], 1: [5] * 7, 2: [10**9, 1, 1, 1], 3: [0, 0], 4: [3, 0, 9]}
    seats = {0: 777, 1: 10, 2: 50, 3: 5, 4: 0}
    rows = [(g, p, v, seats[g]) for g, votes in groups.items() for p, v in enumerate(votes)]
    got = {(x.g, x.p): x.quota for x in sainte_lague(spark.createDataFrame(rows, "g int, p int, v long, s long"), "g", "p", "v", "s").collect()}
    for g, votes in groups.items():
        have = [0] * len(votes)
        for _ in range(seats[g] if sum(votes) else 0):
            best = max(range(len(votes)), key=lambda p: (votes[p] / (2 * have[p] + 1), -p))
            have[best] += 1
        assert [got[g, p] for p in range(len(votes))] == have


def test_targets_are_filled_up_by_weight(spark):
    from emberline.llm.mixing import source_targets

    sizes = [("a", 10), ("b", 1000), ("c", 300), ("d", 0), (None, 50), ("Z", 700)]
    got = {x.source: (x.place, x.weight, x.target) for x in source_targets(spark.createDataFrame(sizes, "source string, source_size long"), (3, 1, 2), (3, 2), 2).collect()}
    order = ["Z", "a", "b", "c", "d", None]
    weight, size = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, dict(sizes)
    free, left, target = set(order), 1.5 * sum(size.values()), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    assert {s: x[:2] for s, x in got.items()} == {s: (i, weight[s]) for i, s in enumerate(order)}
    assert all(got[s][2] == pytest.approx(target[s]) for s in order)


def test_hard_rows(spark):
    from emberline.llm.mixing import mix_sources, words_taken

    rows = [(None, "some words here", "s"), (1, None, "s"), (1, "", None), (2, " \t\n\x0b\f\r ", "e"), (3, "x" * 100_000, "s"), (4, "w " * 50_000, "big"), (5, "same text", "s"), (5, "same text", "s"), (6, "漢字\x85é\xa0f g", "u")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, size string, place int")
    got = mix_sources(docs, shard=1000).withColumn("taken", words_taken(pytest.importorskip("pyspark.sql.functions").col("spans"))).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == [0, 0, 0, 1, 2, 2, 2, 3, 50_000]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got) and all(r.spans == [] for r in got if not r["size"])
    for r in got:
        assert all(0 <= s.start < s.stop <= r["size"] and 1 <= s.times <= 2 for s in r.spans)
    by_source = {s: (sum(r.taken for r in got if r.source == s), next(r.target for r in got if r.source == s)) for s in {r.source for r in got}}
    assert all(abs(taken - target) <= 32 for taken, target in by_source.values())
    assert mix_sources(docs.limit(0)).count() == 0
    empty = mix_sources(docs.filter("doc_id = 2")).collect()
    assert [(r.target, r.spans) for r in empty] == [(0.0, [])]
