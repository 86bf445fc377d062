"""Terms by blocks of documents against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, themes


def _grams(text):
    words = re.findall(r"[^\W\d_][\w-]+", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("chars", [40, 8_000_000])
def test_blocks_equal_plain_counts(spark, monkeypatch, chars):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", chars)
    texts = ["Rates rise again", "rates rise", None, "", "oil falls as rates rise", "lone", "oil oil oil", "rates fall"]
    rows = [(i, t, i % 2 == 0 if i < 6 else None) for i, t in enumerate(texts)] + [(4, "gas falls", True)]  # a document in two rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean")
    tf = Counter()
    for i, t, _ in rows:
        tf.update((i, g) for g in _grams(t))
    df, n = Counter(g for _, g in tf), Counter()
    for (_, g), k in tf.items():
        n[g] += k
    assert {(r.doc_id, r.term): r.tf for r in themes.term_rows(docs).collect()} == dict(tf)
    words = blocks.placed(docs, blocks.PORTABLE_TOKEN, None, "text", "is_target")
    found = blocks.parts(words, flag="is_target")
    assert {r.term: (r.df, r.n) for r in blocks.frequency(found).collect()} == {g: (df[g], n[g]) for g in df}
    w = {k: v * (math.log((1 + 8) / (1 + df[k[1]])) + 1) for k, v in tf.items() if df[k[1]] >= 2}
    norm = Counter()
    for (i, _), x in w.items():
        norm[i] += x * x
    got = {(r.doc_id, r.term): (r.tf, r.is_target, r.tfidf) for r in blocks.weights(words, blocks.fitted(found, 8), 1, 2, "is_target").collect()}
    assert got == {k: (tf[k], k[0] % 2 == 0 if k[0] < 6 else None, pytest.approx(x / math.sqrt(norm[k[0]]))) for k, x in w.items()}
    shown = {(r.doc_id, r.term): r.tfidf for r in blocks.weights(words, blocks.fitted(found, 8, flagged=2)).collect()}
    many = {g for g in df if sum((i, g) in tf for i in (0, 2, 4)) >= 2}
    assert shown == {k: pytest.approx(v[2]) for k, v in got.items() if k[1] in many}


def test_only_distinct_terms_of_a_block_meet(spark):
    """300 equal texts of 40 words: before, every document's terms were rows of a shuffle."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(" ".join(f"w{'abcdefghij'[i % 10]}{'klmn'[i // 10]}" for i in range(40))).alias("text"))
    words = blocks.placed(docs)
    found = blocks.parts(words)
    assert found.count() == 40 + 39
    plan = blocks.weights(words, blocks.fitted(found, 300))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 0 and themes.document_frequency(themes.term_rows(docs)).count() == 79
    assert themes.term_rows(docs.limit(0)).count() == 0 and blocks.weights(blocks.placed(docs.limit(0)), blocks.fitted(blocks.parts(blocks.placed(docs.limit(0))), 0)).count() == 0


def test_vectors_of_a_small_group_are_sent_once(spark, monkeypatch):
    """Before, a vector went out once for each of its prefix terms; both ways connect the same rows."""
    from tidemark.operators import linkage

    r = random.Random(5)
    rows = [("g", i, [(2, t, 1 / math.sqrt(6)) for t in r.sample(range(12), 6)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "group string, node long, v array<struct<df: long, t: long, w: double>>")

    def joined():
        return {(x.id, x.component) for x in linkage.components(linkage.near_links(vectors, 0.4)).collect()}

    whole = joined()
    with monkeypatch.context() as m:
        m.setattr(linkage, "BLOCK", 4)
        assert joined() == whole
    monkeypatch.setattr(linkage, "_compare", lambda cut: lambda batches: (pa.RecordBatch.from_arrays([b.column(3), b.column(3)], ["a", "b"]) for b in batches))
    assert linkage.near_links(vectors, 0.97).count() == 20


def test_feeds_are_given_on_in_small_frames(spark):
    """Before, a batch of feeds became one frame of all their items."""
    from tidemark.sources import feeds

    class Bodies:
        select = lambda self, *_: self
        mapInPandas = lambda self, run, schema: run  # noqa: E731, N815

    body = b"<rss><channel>" + b"<item><title>t</title></item>" * 300 + b"</channel></rss>"
    batch = pd.DataFrame({"feed": [str(i) for i in range(100)], "feed_ord": 0, "body": [body] * 100})
    sizes = [len(f) for f in feeds.parse(Bodies())(iter([batch]))]
    assert sum(sizes) == 100 * 301 and max(sizes) < feeds.HELD_ROWS + 301


def test_a_tasks_blocks_do_not_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 20)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    words = blocks.placed(docs)
    held = words.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("block").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert words.rdd.getNumPartitions() == 200 and held[0] > 80 and held[1] <= 6
    plan = blocks.weights(words, blocks.fitted(blocks.parts(words), 200))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(block") == 3 and plan.count(", 200)") == 3  # words twice, one exchange that is reused, and the vocabulary


def test_no_term_is_a_row_of_a_shuffle(spark, monkeypatch):
    """Before, a block's terms met the others' as rows, came back as rows, and words travelled as lists; terms of one hash keep an order of their own."""
    docs = spark.createDataFrame([(i, f"same words here and w{'abcde'[i % 5]}{'xyz'[i % 3]} again", None if i % 2 else True) for i in range(30)], "doc_id long, text string, is_target boolean")

    def rows():
        words = blocks.placed(docs, blocks.PORTABLE_TOKEN, None, "text", "is_target")
        found = blocks.parts(words, flag="is_target")
        out = blocks.weights(words, blocks.fitted(found, 30, flagged=3))
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (out, blocks.frequency(found))]
        assert not any("hashpartitioning(term" in p or "Window" in p for p in plans) and dict(words.dtypes)["words"] == "string"
        return {(r.doc_id, r.term): (r.tf, round(r.tfidf, 9)) for r in out.collect()}, sorted(map(tuple, blocks.frequency(found).collect()))

    whole = rows()
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 100)
    assert rows() == whole and len(whole[0]) > 200
    monkeypatch.setattr(blocks.pd.util, "hash_array", lambda x, categorize: np.array([len(w) for w in x], np.uint64))
    terms = [f"{a}{b}" for a in "abcdef" for b in ("", "x", "yy")]
    kept = [[pa.array(t).take(pa.array(o)).to_pylist(), ends.tolist()] for t in (terms, terms[::-1]) for o, ends in [blocks._ranged(pa.array(t), 2)]]
    assert kept[0] == kept[1] and kept[0][1] == [0, 6, 18]
