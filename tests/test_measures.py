"""Selection by rank, sweep choices, pins, label joins and the drift report against plain Python."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, classify, metrics, review, splits


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_and_ranks_equal_sorting(spark, monkeypatch, seed):
    monkeypatch.setattr(metrics, "RANGES", 5)
    r = random.Random(seed)
    draw = (lambda: r.choice([None, r.gauss(0, 1), 10 ** r.uniform(-9, 9), 3.0, 3.0]), lambda: float(r.randint(-3, 3)), lambda: r.choice([None, -1e300, 1e300, 0.0]))[seed]
    rows = [(r.choice(["a", "b", None]), draw()) for _ in range(400)] + [("alone", 7.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: x for x in metrics.percentiles(df, "v", "g").collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        values.sort()
        at = lambda q: (values[math.floor((len(values) - 1) * q)], values[math.ceil((len(values) - 1) * q)], (len(values) - 1) * q % 1)  # noqa: E731, B023
        want = [a + (b - a) * f for a, b, f in map(at, (0.5, 0.95))]
        assert (got[g].n, got[g].most) == (len(values), values[-1]) and [got[g].p50, got[g].p95] == pytest.approx(want, rel=1e-12)
    held = sorted(v for _, v in rows if v is not None)
    assert tuple(metrics.nearest_rank(df, "v", 0.9).first()) == (held[int(len(held) * 0.9)], len(held))
    assert metrics.nearest_rank(df, "v", 1.0).first()["value"] == held[-1] and metrics.nearest_rank(df.where("g = 'none'"), "v").count() == 0
    assert metrics.percentiles(df.limit(0), "v").where("n > 0").count() == 0


def test_selection_of_longs_lists_no_values(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"))
    held = sorted(i * 7919 % 100_003 for i in range(100_000))
    assert metrics.nearest_rank(df, "v").first()["value"] == held[95_000]
    plan = metrics.nearest_rank(df, "v")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile" not in plan


def swept(spark, rows):
    return spark.createDataFrame(rows, "pos_cut double, neg_cut double, accuracy double, macro_f1 double, negative_recall double")


def test_sweep_choices(spark):
    df = swept(spark, [(0.1, -0.1, 0.6, 0.5, 0.2), (0.2, -0.1, 0.7, 0.5, 0.9), (0.2, -0.2, 0.7, 0.5, 0.1), (0.05, -0.05, 0.4, 0.3, 0.5), (0.3, 0.0, 0.5, 0.4, 1.0)])
    pairs = lambda d: [(x.pos_cut, x.neg_cut) for x in d.collect()]
    assert pairs(metrics.best_of(df)) == [(0.2, -0.1), (0.2, -0.2), (0.1, -0.1)], "all that match, the most accurate first"
    assert pairs(metrics.best_of(df, "accuracy", "macro_f1")) == [(0.2, -0.1), (0.2, -0.2)]
    assert sorted(pairs(metrics.clearing(df, 0.6))) == [(0.2, -0.2), (0.2, -0.1)]
    assert pairs(metrics.beating(df, 0.05, -0.05)) == [(0.2, -0.1), (0.2, -0.2), (0.1, -0.1), (0.3, 0.0)]
    with pytest.raises(ValueError, match="was not swept"):
        metrics.beating(df, 0.9, 0.9)


def test_trees_name_the_changed_leaf(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id"), F.concat(F.lit("text "), F.col("id") % 1500).alias("text"), (F.col("id") % 2).cast("string").alias("label"))
    t = {x.path: x for x in splits.tree(rows, "id", "text", leaf_rows=20).collect()}
    assert max(map(len, t)) == 2 and t[""].n == 3000 and sum(x.n for p, x in t.items() if len(p) == 2) == 3000
    same = {x.path: x.hash for x in splits.tree(rows.repartition(7), "id", "text", leaf_rows=20).collect()}
    assert same == {p: x.hash for p, x in t.items()}
    other = {x.path: x.hash for x in splits.tree(rows.withColumn("text", F.when(F.col("id") == 17, "new").otherwise(F.col("text"))), "id", "text", depth=2).collect()}
    odd = {p for p in same.keys() | other.keys() if same.get(p) != other.get(p)}
    assert {len(p) for p in odd} == {0, 1, 2} and len([p for p in odd if len(p) == 2]) <= 2
    path, schema = str(tmp_path / "s"), "id long, text string, label string"
    splits.save(splits.stratified(rows), path)
    assert splits.load(spark, path, schema).count() == 3000
    (test,) = [f for f in (tmp_path / "s/rows/split=test").glob("*.json")][:1]
    lines = test.read_text().splitlines()
    lines[0] = json.dumps(json.loads(lines[0]) | {"label": "9"})
    test.write_text("\n".join(lines) + "\n")
    for crc in test.parent.glob(f".{test.name}.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match=r"leaf '.*' has \d+ rows, pinned were \d+; [12] leaves differ"):
        splits.load(spark, path, schema)
    empty = splits.tree(rows.limit(0), "id")
    assert empty.count() == 0
    splits.verify_tree(rows.limit(0), empty, "id")
    nulls = spark.createDataFrame([(None,), ("-",), ("",), ("1:-",)], "text string")
    assert nulls.select(splits.entry("text")).distinct().count() == 4


LABELS = "id long, label string"


def test_drift_with_and_without_columns(spark):
    r = random.Random(2)
    names = ["negative", "neutral", "positive"]
    hand = [(i, r.choice(names)) for i in range(80)]
    model = [(i, r.choice([la, la, r.choice(names)]), r.choice(["x", "y"]), "odd name") for i, la in hand]
    again = [(i, r.choice([la, r.choice(names)])) for i, la in hand[:20]]
    h, a = spark.createDataFrame(hand, LABELS), spark.createDataFrame(again, LABELS)
    m = spark.createDataFrame(model, LABELS + ", col string, `odd name` string")
    rows = {(x.part, x.value, x.measure): x.amount for x in review.drift(h, m, a, "col", "odd name").collect()}
    truth = dict(hand)
    share = lambda pairs: sum(x == y for x, y in pairs) / len(pairs)
    assert rows["model", "all", "accuracy"] == share([(truth[i], p) for i, p, _, _ in model]) and rows["model", "all", "n"] == 80
    for value in "xy":
        assert rows["model", f"col={value}", "accuracy"] == share([(truth[i], p) for i, p, c, _ in model if c == value])
    assert rows["self", "all", "accuracy"] == share([(truth[i], p) for i, p in again]) and rows["self", "all", "n"] == 20
    for label in names:
        assert rows["model", label, "support"] == sum(la == label for _, la in hand)
    bare = {(x.part, x.value, x.measure): x.amount for x in review.drift(h, m).collect()}
    assert bare == {k: v for k, v in rows.items() if k[0] == "model" and "=" not in k[1]}


def test_label_joins_and_keyed_files_name_what_is_odd(spark, tmp_path):
    hand, model = spark.createDataFrame([(1, "positive"), (2, "neutral")], LABELS), spark.createDataFrame([(1, "neutral", 0.5)], LABELS + ", confidence double")
    with pytest.raises(ValueError, match="only the hand labels hold 2"):
        review.joined(hand, model)
    assert [tuple(x) for x in review.joined(hand.where("id = 1"), model).collect()] == [(1, "positive", "neutral", 0.5)]
    with pytest.raises(ValueError, match="9 was labelled again but never before"):
        review.relabelled(hand, spark.createDataFrame([(9, "neutral")], LABELS))
    path = str(tmp_path / "a.json")
    write = lambda *rows: (tmp_path / "a.json").write_text("".join(json.dumps(x) + "\n" for x in rows))
    write({"id": 1, "label": "neutral"}, {"id": 2, "label": "positive"})
    assert review.read_keyed(spark, path, LABELS).count() == 2
    write({"id": 1, "label": "neutral"}, {"id": 1, "label": "positive"})
    with pytest.raises(ValueError, match="'?1'? occurs 2 times"):
        review.read_keyed(spark, path, LABELS)
    for bad in ({"id": 3, "label": "good"}, {"label": "neutral"}, {"id": 4}):
        write({"id": 1, "label": "neutral"}, bad)
        with pytest.raises(ValueError, match="has the label"):
            review.read_keyed(spark, path, LABELS)


def test_nesting_over_levels_and_samples(spark, tmp_path):
    level = lambda *x: spark.createDataFrame([(v,) for v in x], "text string")
    got = splits.nested([("s", level("a", "b")), ("m", level("a", "c")), ("l", level("a", "b"))]).collect()
    assert [tuple(x) for x in got] == [("s", "m", "b"), ("m", "l", "c")]
    with pytest.raises(ValueError, match="two levels"):
        splits.nested([("s", level("a"))])
    rows = spark.range(50).select("id", F.col("id").cast("string").alias("text"))
    assert splits.save_sample(rows, str(tmp_path / "p"), 7, 3) == 7
    assert splits.save_sample(rows, str(tmp_path / "q"), 7, 3) == 7
    read = lambda p: sorted(x.id for x in spark.read.json(str(tmp_path / p)).collect())
    assert read("p") == read("q")


def test_a_baseline_takes_the_commonest_terms_ties_by_length_then_term(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"][: r.choice([3, 7])]) for _ in range(r.randrange(0, 14))) for _ in range(60)] + ["all " * 3] * 3
    texts = [f"all {t}" for t in texts]
    counts, df = collections.Counter(), collections.Counter()
    for w in map(str.split, texts):
        grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        counts.update(grams)
        df.update(set(grams))
    rows = spark.createDataFrame([(t, "xy"[i % 2]) for i, t in enumerate(texts)] + [(None, "x")], "text string, label string").repartition(3)
    most = 0.95 * (len(texts) + 1)
    fit = sorted((t for t in counts if 2 <= df[t] <= most), key=lambda t: (-counts[t], t.count(" "), t))
    for features in (1, 4, 12, 40, 10000):
        model = classify.fit_baseline(rows, ("x", "y"), features=features)
        assert model.stages[0].vocabulary == fit[:features] and "all" not in fit
        given = [math.log((2 + len(texts)) / (1 + df[t])) + 1 for t in fit[:features]]
        assert list(model.stages[1].getScalingVec().toArray()) == pytest.approx(given)
    held = blocks.term_vectors(spark.createDataFrame([(1, ["aa", "bb", "aa", "bb"]), (2, []), (3, None)], "id long, words array<string>"), ["bb aa", "aa bb", "aa", "zz"])
    assert {x.id: dict(zip(x.tf.indices.tolist(), x.tf.values.tolist())) for x in held.collect()} == {1: {0: 1.0, 1: 2.0, 2: 2.0}, 2: {}, 3: {}}
    said = classify.predict_baseline(model, rows, ("x", "y"))
    assert said.columns == ["text", "label", "y_pred", "confidence"] and said.count() == len(texts) + 1


def test_tree_query_names_the_levels_of_its_sql_and_the_full_one_all(spark, tmp_path):
    """Before, ``split_tree`` gave a fifth level, the root, beyond 65,536 documents; its SQL names four."""
    from tidemark.plans.queries import ORACLE, QUERIES

    spark.range(66_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    four, full = ({r["path"]: (r["hash"], r["n"]) for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("split_tree", "split_tree_full"))
    assert {len(p) for p in four} == {1, 2, 3, 4} and {len(p) for p in full} == {0, 1, 2, 3, 4}
    assert full.pop("")[1] == 66_000 and full == four
    assert "split_tree_full" in ORACLE and "RECURSIVE" in ORACLE["split_tree_full"]
