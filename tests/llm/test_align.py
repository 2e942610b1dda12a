"""Cross-tokenizer alignment against both libraries run over whole texts and a plain two-pointer merge."""

import functools
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("emberline.llm")
P = pytest.importorskip("public_tokenizers")

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
HARD = [
    "a ", "  a", " ", " a\n b", "\n\n x", "don't stop'll 's", "漢字漢字 漢é", "x▁y ok", "<|endoftext|> <s></s> hi", "a\x1c b\x85 c\xa0 d", "tab\t tab\ttab", " \t \n ", "İstanbul 12345,678.", "a.b,c;d:e!f?", "é x",
    "word " * 5000, "x" * 5000, "漢" * 3000, "\x00 \x01a", "\r\n.\r\n", "mixed\nLine one\nTwo. Three\n\nFour", None, "", "ab", "ab", "foo  bar   baz　 q", "१२३ abc½ ²", "😀 😀😀 👍🏽",
]


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def encoded(text):
    """(ids, bytes) of all tokens of A and of B; nothing where a tokenizer doesn't give the text back."""
    a, b = libraries()
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    e, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    left = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    right = [(i, piece(i)) for i in ids]
    return (left, right) if text and all(b"".join(x for _, x in side) == (" " + text).encode() for side in (left, right)) else ([], [])


def plain(rows):
    each, counts = [], Counter()
    for key, text in rows:
        left, right = encoded(text) if text else ([], [])
        links, groups, own, i, j = [], [], ([], []), 0, 0
        x = y = 0  # bytes up to the tokens' ends
        while i < len(left):
            if not own[0] or own[0][-1][1] != i:
                own[0].append((left[i][0], i))
                x += len(left[i][1])
            if not own[1] or own[1][-1][1] != j:
                own[1].append((right[j][0], j))
                y += len(right[j][1])
            links.append((left[i][0], right[j][0]))
            if x == y:
                groups.append("|".join(",".join(str(t) for t, _ in side) for side in own))
                own = ([], [])
            i, j = i + (x <= y), j + (y <= x)
        counts.update(links)
        each.append((key, len(left), len(right), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(k, a, b, len(g), len(ln), sum(counts[p] == most[p[1]] for p in ln), sum(counts[p] for p in ln), digest(g)) for k, a, b, g, ln in each]


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


@pytest.mark.parametrize("remembered", [20, 400_000])
def test_hard_texts_match_whole_encoding(spark, remembered):
    from emberline.llm.align import alignment_counts

    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(HARD)], "doc_id long, text string, pair string, key long").repartition(3)
    assert rows_of(alignment_counts(docs, A, B, remembered=remembered)) == sorted(plain(enumerate(HARD)))


def test_query_matches_whole_encoding(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    from emberline.llm.align import alignment_counts

    assert rows_of(alignment_counts(spark.createDataFrame(docs, "doc_id long, text string"), A, B)) == sorted(plain(docs))
    got = entry.queries()["op13_alignment"](spark, folder)
    assert got.columns == COLUMNS and got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_null_keys_repeats_and_empty_tables(spark):
    from emberline.llm.align import aligned_groups, alignment_counts

    rows = [(None, "same words"), (1, "same words"), (1, "same words"), (None, None)]
    got = alignment_counts(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == [("1", got[0].n_links or 2), ("1", 2), ("None", 0), ("None", 2)] and len(got) == 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_counts(empty, A, B).count() == 0 and aligned_groups(empty, A, B).count() == 0


def test_groups_give_the_text_back(spark):
    from emberline.llm.align import aligned_groups

    docs = [(k, t) for k, t in enumerate(HARD) if t and len(t) < 100]
    for r in aligned_groups(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect():
        left, right = encoded(dict(docs)[r.doc_id])
        assert [x for g in r.groups for x in g.a] == [i for i, _ in left] and [x for g in r.groups for x in g.b] == [i for i, _ in right]
        if left:
            assert [g.start for g in r.groups] == [0, *(g.end for g in r.groups[:-1])] and r.groups[-1].end == len((" " + dict(docs)[r.doc_id]).encode())


def test_long_sequences_take_several_lanes():
    from emberline.llm.align import lockstep

    r = np.random.default_rng(3)
    total = 5000
    ends = [np.r_[np.sort(r.choice(np.arange(1, total), n, replace=False)), total] for n in (1500, 900)]
    whole = lockstep(*ends, np.array([0]), lane=10_000)
    lanes = lockstep(*ends, np.array([0]), lane=64)
    assert sorted(zip(*whole[:2], strict=True)) == sorted(zip(*lanes[:2], strict=True)) and all((x == y).all() for x, y in zip(whole[2:], lanes[2:], strict=True))
    starts = [np.r_[0, e[:-1]] for e in ends]
    overlap = {(i, j) for i in range(1501) for j in np.flatnonzero((starts[1] < ends[0][i]) & (ends[1] > starts[0][i])).tolist()}
    assert {(int(a), int(b)) for a, b in zip(*whole[:2], strict=True)} == overlap
