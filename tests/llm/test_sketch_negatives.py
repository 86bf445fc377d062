"""Paragraph sketches and hard negatives against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H
from tidemark.llm import paragraph_sketch as P

DOCS = "doc_id long, text string"


def brute_near(a, b):
    x, y = (set(P.digests(t or "").tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_chain(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(brute_near(text, changed), 9), round(brute_near(text, after), 9)))
    return sorted(out, key=repr)


def chained(df, **k):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in P.chained(df, **k).collect()), key=repr)


def nasty(r):
    texts = ["".join(r.choice("ab. !?é\n😀") for _ in range(r.randint(0, 90))) for _ in range(150)]
    return texts + [None, "", " \n ", "...", "same text. here", "same text. here", "x" * 5000, " ".join(f"Sentence {i}." for i in range(9000)), "a. " * 3000]


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_chain_equals_brute_force(spark, ranges):
    docs = list(enumerate(nasty(random.Random(ranges)), 10))
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("part", "opener", "fingerprint", "to")})
    assert chained(df, ranges=ranges) == brute_chain(docs)


def test_chain_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert P.chained(empty).count() == 0 and P.chained(empty).schema == P.chained(spark.createDataFrame([(1, "a")], DOCS)).schema
    for docs in ([(5, "only one. of them")], [(None, "b"), (None, "a"), (2, None), (2, "z. y"), (2, "z. y"), (-3, "c\nd")], [(None, "x"), (None, None)]):
        assert chained(spark.createDataFrame(docs, DOCS), ranges=4) == brute_chain(docs)


def test_equal_texts_have_equal_fingerprints_and_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "A b. C\nd"), (2, "A b. C\nd"), (3, "A b. C\nd."), (4, None), (5, "")], DOCS)
    rows = {r.doc_id: r for r in P.fingerprints(df).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint != rows[3].fingerprint and rows[4].fingerprint == rows[5].fingerprint
    assert rows[1].n_paragraphs == 3 and "Exchange" not in P.fingerprints(df)._jdf.queryExecution().toString()


def test_peeling_recovers_the_whole_difference(spark):
    r = random.Random(5)
    for shared, left, right in ((0, 0, 0), (40, 1, 0), (500, 12, 9), (30, 400, 300), (0, 3000, 1)):
        words = [f"piece {r.random()}" for _ in range(shared + left + right)]
        a, b = (P.Marked("\n".join(w)) for w in (words[: shared + left], words[:shared] + words[shared + left :]))
        only_a, only_b, cells = P.difference(a, b)
        assert set(only_a.tolist()) == set(a.keys.tolist()) - set(b.keys.tolist()) and set(only_b.tolist()) == set(b.keys.tolist()) - set(a.keys.tolist())
        assert cells == P.CELLS or left + right > 8, "small differences need no retry"
    row = P.compared(spark.createDataFrame([("v", "One. Two.\nThree", "One. Four.\nThree")], "id string, a string, b string"), "id", "a", "b").first()
    assert row.likeness == 0.5 and len(row.removed) == len(row.added) == 1 and row.cells == P.CELLS


def test_retries_grow_until_the_difference_is_found():
    a, b = P.Marked("\n".join(map(str, range(2000)))), P.Marked("\n".join(map(str, range(1000, 4000))))
    assert P.difference(a, b)[2] > P.CELLS * P.GROWTH and P.likeness(a, b) == 1000 / 4000


VECTORS = "vec_id long, label int, embedding array<float>"


def brute_negatives(rows, asked):
    ok = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in ok if asked(i)}:
        scored = sorted((-dot(v, w), j, m == lab) for j, m, w in ok if j != i)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            inside = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, p, k, n, -s, -t) for k, (t, n, _) in enumerate(inside[:3], 1)]
    return sorted(out)


def mined(df, asked="vec_id % 5 = 0", **k):
    rows = df.withColumn("embedding", H.scaled(F.col("embedding")))
    return sorted(tuple(r) for r in H.mine(rows, rows.where(asked), **k).collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(H, "ANCHORS", 16)
    monkeypatch.setattr(H, "PACK", 64)
    monkeypatch.setattr(H, "FIRST", 8)
    rows = [(i, int(r.integers(0, 4)), [float(np.float32(x)) for x in r.normal(size=7) * r.choice([0.01, 0.3, 40])]) for i in range(300)]
    rows += [(300 + i, i % 3, rows[7][2]) for i in range(60)]  # ties
    rows += [(400, None, rows[0][2]), (405, 1, None), (410, 1, [float("nan")] * 7), (415, 2, [None] * 7), (420, 0, [float("inf")] * 7), (None, 1, rows[3][2])]
    rows += [(425, 0, [1.0, 2.0]), (430, 1, []), rows[5], rows[5], rows[11]]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("id", "x", "key", "score", "codes")})
    expected = brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(df, tasks=3) == expected and len(expected) > 300
    monkeypatch.setattr(H, "SAMPLE", 3)  # a poor quantiser gives the same rows
    assert mined(df) == expected


def test_hard_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert mined(empty) == [] and mined(spark.createDataFrame([(5, 1, [1.0, 2.0])], VECTORS)) == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.125]), (2, 2, [0.875, 0.0]), (3, 2, [-1.0, 0.0]), (4, 2, [0.25, 0.0]), (6, 1, [-1.0, 0.0])]
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows, lambda i: i % 5 == 0)
    far = [(5 * i, i % 2, [1e6 * i, -3e5]) for i in range(8)]
    assert mined(spark.createDataFrame(far, VECTORS)) == brute_negatives(far, lambda i: i % 5 == 0)


def test_bounds_hold_for_every_pair():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(400, 9))).astype(np.int64)
    q = H.Quantiser(x[:100])
    codes, reach = q.encode(x)
    tables = q.tables(x[:50])
    middle = sum(tables[m][codes[:, m]] for m in range(codes.shape[1]))
    room = reach[:, None] * np.sqrt((x[:50] ** 2).sum(1)) + 1
    assert (np.abs(middle - x @ x[:50].T) <= room).all() and (reach < np.sqrt((x**2).sum(1))).mean() > 0.9
