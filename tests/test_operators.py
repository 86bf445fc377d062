import datetime as dt
import json
import math
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Explain
from tidemark.operators import classify, dedupe, gates, index, linkage, metrics, report, splits, themes
from tidemark.plans import queries

DAY = dt.date(2026, 10, 1)
SCORED = "id string, label string, confidence double, source string, published_at timestamp, day date"


def scored(spark, rows, day=DAY):
    return spark.createDataFrame([(i, la, c, s, None, day) for i, (la, c, s) in enumerate(rows)], SCORED.replace("id string", "id long")).withColumn("id", F.col("id").cast("string"))


SIGNS = {"negative": -1, "neutral": 0, "positive": 1}


def drawn(seed, n):
    """Rows of a made-up day: (id, label, confidence, source)."""
    r = random.Random(seed)
    return [(f"h{i:02}", r.choice(list(SIGNS)), r.randint(35, 99) / 100, r.choice(["alpha", "beta", "gamma", "delta"])) for i in range(n)]


def rounded(x, places=1):
    """Half away from zero, on the shortest decimal form."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0


@pytest.mark.parametrize("seed", range(4))
def test_index_equals_sums_by_hand(spark, seed):
    rows = drawn(seed, 3 + 8 * seed)
    r = index.daily_index(scored(spark, [(la, c, s) for _, la, c, s in rows])).first()
    total = math.fsum(c for _, _, c, _ in rows)
    assert abs(r["mood_index"] - 100 * math.fsum(SIGNS[la] * c for _, la, c, _ in rows) / total) < 1e-9 and abs(r["mean_confidence"] - total / len(rows)) < 1e-12
    count = Counter(la for _, la, _, _ in rows)
    assert (r["n_positive"], r["n_neutral"], r["n_negative"]) == tuple(count[x] for x in ("positive", "neutral", "negative"))
    assert r["n_low_conf"] == sum(c < 0.6 for _, _, c, _ in rows) and r["source_counts"] == Counter(s for *_, s in rows) and r["n_sources"] == len(r["source_counts"])


def test_index_extremes(spark):
    mood = lambda rows: index.daily_index(scored(spark, rows)).first()["mood_index"]
    assert (mood([("negative", 0.31, "a"), ("negative", 0.99, "a")]), mood([("neutral", 0.4, "b")])) == (-100, 0)
    assert mood([("positive", 0.0, "a")]) is None and index.daily_index(scored(spark, [])).count() == 0


def test_freeze(spark):
    days = [(DAY - dt.timedelta(days=k),) for k in range(5)]
    req = spark.createDataFrame(days, "day date")
    idx = lambda items: spark.createDataFrame(items, "day date, mood_index double, n_headlines long")
    stored = idx([(days[0][0], 1.0, 1), (days[2][0], 2.0, 2)])
    fresh = idx([(days[0][0], 10.0, 9), (days[1][0], 11.0, 9), (days[2][0], 12.0, 9), (days[3][0], 13.0, 9)])
    got = {r["day"]: (r["action"], r["mood_index"]) for r in index.freeze(req, stored, fresh, DAY).collect()}
    want = [("recomputed", 10.0), ("recomputed", 11.0), ("kept", 2.0), ("written", 13.0), ("empty", None)]
    assert [got[d[0]] for d in days] == want


@pytest.mark.parametrize("seed", range(4))
def test_report_aggregates_by_hand(spark, seed):
    day = drawn(20 + seed, [1, 6, 13, 40][seed])
    rows = spark.createDataFrame([(i, la, c, s, None, DAY) for i, la, c, s in day], SCORED)
    moved = math.fsum(c for _, la, c, _ in day if la != "neutral")
    got = {r["id"]: r["contribution_pct"] for r in report.contributions(rows).collect()}
    assert got == {i: None if la == "neutral" else rounded(100 * c / moved) for i, la, c, _ in day}
    count = {la: sum(x[1] == la for x in day) for la in report.ORDER}
    drawn_as = sorted((la for la in count if count[la]), key=lambda la: (-count[la], report.ORDER.index(la)))
    shares = {r["sentiment"]: (r["count"], r["share_pct"]) for r in report.slices(rows).collect()}
    assert shares == {la: (n, rounded(100 * n / len(day))) for la, n in count.items()}
    ranks = {r["sentiment"]: r["pie_rank"] for r in report.slices(rows).collect()}
    assert [count[la] for la in sorted(drawn_as, key=ranks.get)] == [count[la] for la in drawn_as] and all(ranks[la] is None for la in count if not count[la])
    by_source = {r["source"]: (r["total"], r["negative"], r["neutral"], r["positive"]) for r in report.sources(rows).collect()}
    assert by_source == {s: (sum(x[3] == s for x in day), *(sum(x[3] == s and x[1] == la for x in day) for la in ("negative", "neutral", "positive"))) for s in {x[3] for x in day}}
    wanted = {"negative": 3, "positive": 3, "neutral": 2}
    top = {la: [x[0] for x in sorted((x for x in day if x[1] == la), key=lambda x: (-x[2], x[0]))][:k] for la, k in wanted.items()}
    found = {la: [] for la in wanted}
    for r in report.recommended(rows).orderBy("label", "rank").collect():
        found[r["label"]].append(r["id"])
    assert found == top
    assert {r["label"]: r["n"] for r in report.shortfalls(rows).collect()} == {la: count[la] for la, k in wanted.items() if count[la] < k}
    assert by_source[report.top_source(rows).first()["source"]][0] == max(v[0] for v in by_source.values())


def test_order_ties_and_undated_last(spark):
    t = dt.datetime(2026, 10, 1, 9)
    rows = [("a", "positive", 0.9, "s", t, DAY), ("b", "positive", 0.9, "s", t, DAY), ("c", "positive", 0.9, "s", t - dt.timedelta(hours=1), DAY), ("d", "positive", 0.9, "s", None, DAY)]
    got = spark.createDataFrame(rows, SCORED).orderBy(*report.canonical()).collect()
    assert [r["id"] for r in got] == ["c", "a", "b", "d"]


@pytest.mark.parametrize("seed", range(3))
def test_previous_session_by_hand(spark, seed):
    r = random.Random(30 + seed)
    days = {DAY - dt.timedelta(days=k): (r.randint(-4000, 4000) / 64, r.choice([1, 4, 5, 30])) for k in r.sample(range(25), 14)}
    idx = spark.createDataFrame([(d, m, n) for d, (m, n) in days.items()], "day date, mood_index double, n_headlines long")
    for x in report.previous_session(idx).collect():
        back = [x["day"] - dt.timedelta(days=k) for k in range(1, 6)]
        prev = next((d for d in back if d in days and days[d][1] >= 5), None)
        assert x["prev_day"] == prev and x["prev_mood"] == (None if prev is None else rounded(days[prev][0]))
    pairs = [(r.randint(-90, 90) / 10, r.randint(-90, 90) / 10) for _ in range(40)] + [(None, 2.0), (2.0, None)]
    got = spark.createDataFrame(pairs, "a double, b double").select(report.change(F.col("a"), F.col("b"))).collect()
    assert [g[0] for g in got] == [None if None in (a, b) or abs(rounded(a - b)) < 5 else rounded(a - b) for a, b in pairs]


def brute_dedupe(rows):
    ids, titles, kept = {}, {}, []
    for r in rows:
        i, t, s, p = r
        hit = titles.get(t) or ids.get(i)
        if hit is None:
            hit = ids[i] = titles[t] = [i, t, s, p]
            kept.append(hit)
        elif p is not None and (hit[3] is None or p < hit[3]):
            hit[3] = p
    return sorted(map(tuple, kept))


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_agrees_with_sequential(spark, seed):
    r = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    rows = [(str(r.randint(0, 60)), f"t{r.randint(0, 60)}", k, r.choice([None, start + dt.timedelta(hours=r.randint(0, 500))])) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, title_norm string, seq long, published_at timestamp")
    got = sorted((x["id"], x["title_norm"], x["seq"], x["published_at"]) for x in dedupe.merge(df).collect())
    assert got == brute_dedupe(rows)
    assert dedupe.merge(df.limit(0)).count() == 0


NOW = dt.datetime(2026, 10, 1, 12)
HEALTHY = dict(
    day=DAY, is_today=True, now=NOW, last_fetched_at=NOW - dt.timedelta(hours=1), n_unscored=0,
    feeds=[("a", True, NOW), ("b", True, None)], n_headlines=10, top_source="alpha", top_count=7, n_low_conf=5,
)


@pytest.mark.parametrize("change, gate, status", [
    ({}, "pipeline_fresh", "pass"),
    ({"last_fetched_at": NOW - dt.timedelta(hours=36)}, "pipeline_fresh", "fail"),
    ({"last_fetched_at": NOW - dt.timedelta(hours=36) + dt.timedelta(seconds=1)}, "pipeline_fresh", "pass"),
    ({"last_fetched_at": None}, "pipeline_fresh", "fail"),
    ({"is_today": False}, "pipeline_fresh", "not_applicable"),
    ({"n_unscored": 1}, "all_scored", "fail"),
    ({"n_headlines": 7, "top_count": 1, "n_low_conf": 0}, "thin_day", "fired"),
    ({"n_headlines": 8, "top_count": 1, "n_low_conf": 0}, "thin_day", "pass"),
    ({"n_headlines": None}, "thin_day", "not_applicable"),
    ({"feeds": [("a", True, NOW), ("b", False, None)]}, "feeds_down", "fired"),
    ({"feeds": None}, "feeds_down", "not_applicable"),
    ({}, "single_source", "pass"),
    ({"top_count": 8}, "single_source", "fired"),
    ({}, "low_confidence", "pass"),
    ({"n_low_conf": 6}, "low_confidence", "fired"),
    ({"feeds": [("a", True, NOW - dt.timedelta(hours=36))]}, "stale_feed", "fired"),
    ({}, "stale_feed", "pass"),
])
def test_gates(spark, change, gate, status):
    row = HEALTHY | change
    names = [c.split()[0] for c in gates.INPUTS.replace("array<struct<name: string, responded: boolean, newest_published_at: timestamp>>", "x").split(", ")]
    got = gates.evaluate(spark.createDataFrame([tuple(row[n] for n in names)], gates.INPUTS)).orderBy("position").collect()
    assert [g["gate"] for g in got] == [n for n, *_ in gates.NAMES]
    assert {g["gate"]: g["status"] for g in got}[gate] == status


def test_published_confusion_matrices(spark):
    #: Published matrices and their accuracy, macro-F1 and weighted F1.
    published = {"a": ([[14, 17, 32], [19, 177, 126], [11, 33, 89]], (54.05, 45.83, 55.29)), "b": ([[61, 2, 0], [5, 300, 17], [9, 8, 116]], (92.08, 90.19, 92.16))}
    names = metrics.LABELS
    for matrix, want in published.values():
        rows = [(names[i], names[j]) for i in range(3) for j in range(3) for _ in range(matrix[i][j])]
        pred = spark.createDataFrame(rows, "y_true string, y_pred string")
        r = metrics.overall(pred).first()
        assert tuple(round(100 * r[k], 2) for k in ("accuracy", "macro_f1", "weighted_f1")) == want
        got = {x["y_true"]: [x[n] for n in names] for x in metrics.confusion(pred).collect()}
        assert [got[n] for n in names] == matrix


def test_wilson_kappa_weights(spark):
    low, high = spark.range(1).select(metrics.wilson(F.lit(59), F.lit(100)).alias("w")).select("w.*").first()
    assert (round(100 * low, 2), round(100 * high, 2)) == (49.20, 68.13)
    rows = spark.createDataFrame([(x,) for x in ("negative", "neutral", "neutral", "neutral", "positive", "positive")], "label string")
    assert {r["label"]: round(r["weight"], 6) for r in metrics.class_weights(rows).collect()} == {"negative": 2.0, "neutral": 0.666667, "positive": 1.0}
    with pytest.raises(ValueError):
        metrics.class_weights(rows.where("label <> 'negative'"))
    same = spark.createDataFrame([("neutral", "neutral")] * 3, "y_true string, y_pred string")
    assert metrics.kappa(same).first()["kappa"] is None
    with pytest.raises(ValueError):
        metrics.require_rows(same.limit(0))


def test_split_is_stratified_and_repeatable(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 600, "a").when(F.col("id") < 850, "b").otherwise("c").alias("label"))
    got = splits.stratified(rows)
    counts = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert counts == {("a", "test"): 90, ("a", "val"): 90, ("a", "train"): 420, ("b", "test"): 38, ("b", "val"): 37, ("b", "train"): 175, ("c", "test"): 23, ("c", "val"): 22, ("c", "train"): 105}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, splits.stratified(rows.repartition(7)).collect()))
    h = splits.set_hash(rows.select(F.col("label").alias("text"))).first()["set_hash"]
    splits.verify(rows.select(F.col("label").alias("text")).repartition(3), h)
    with pytest.raises(ValueError):
        splits.verify(rows.where("id > 0").select(F.col("label").alias("text")), h)


def brute_linkage(d, threshold):
    groups = [[i] for i in range(len(d))]
    while True:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                far = max(d[i, j] for i in groups[a] for j in groups[b])
                if far < threshold and (best is None or far < best[0] - 1e-15):
                    best = (far, a, b)
        if best is None:
            return sorted(map(sorted, groups))
        _, a, b = best
        groups[a] += groups.pop(b)
        groups.sort(key=min)


def drawn_rows(r, n, terms):
    """Sparse unit rows with copies and repeated entries: (row, column, value) and the matrix."""
    x = r.random((n, terms)) * (r.random((n, terms)) < 0.2)
    x[np.arange(n), r.integers(0, terms, n)] += 0.3
    x[n - n // 6 :] = x[r.integers(0, max(1, n // 3), n // 6)]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    at, col = np.nonzero(x)
    at, col = np.append(at, at[:9]), np.append(col, col[:9])
    return at, col, x[at, col], x


@pytest.mark.parametrize("room", [0, 1 << 20])
@pytest.mark.parametrize("cut", [0.3, 0.6, 0.97])
def test_linkage_agrees_with_brute_force(monkeypatch, cut, room):
    monkeypatch.setattr(linkage, "KEPT_BYTES", room)
    for seed in range(6):
        at, col, value, x = drawn_rows(np.random.default_rng(seed), 30, 12)
        label = linkage.complete_linkage(at, col, value, 30, cut)
        got = sorted(sorted(np.flatnonzero(label == k).tolist()) for k in set(label.tolist()))
        assert got == brute_linkage(np.round(1 - x @ x.T, 12), cut) and all(label[k] == k for k in label)


@pytest.mark.parametrize(("cut", "block"), [(0.6, 4), (0.97, 512), (0.2, 512), (1.0, 4), (1.5, 4)])
def test_clusters_of_drawn_groups_equal_brute_force(spark, monkeypatch, cut, block):
    monkeypatch.setattr(linkage, "BLOCK", block)
    rows, want = [], set()
    for g in range(50):
        r = np.random.default_rng(100 + g)
        n = int(r.integers(1, 24))
        at, col, value, x = drawn_rows(r, n, 10)
        order = r.permutation(n)  # places of rows that are not in the order of their names
        rows += [(g, int(order[i]), f"d{i:02}", f"t{c}", float(v)) for i, c, v in zip(at, col, value)]
        x = x[np.argsort(order)]
        names = np.argsort(order)
        want |= {(g, f"d{names[i]:02}", c[0]) for c in brute_linkage(np.round(1 - x @ x.T, 12), cut) if len(c) > 1 for i in c}
    df = spark.createDataFrame(rows, "group long, position int, doc_id string, term string, tfidf double").repartition(5)
    got = themes.clusters(df, Explain(cluster_distance=cut, min_cluster_size=2)).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(0, 60)] + [(1000, k) for k in range(900, 950)] + [(5000, 5000)]
    got = {x.id: x.component for x in linkage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys([*range(900, 950), 1000], 900) | {5000: 5000}
    assert linkage.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_driver_by_hand(spark, seed):
    r = random.Random(40 + seed)
    rows = [(str(i), r.choice(["negative", "negative", "neutral", "positive"]), r.randint(40, 99) / 100, i // 5) for i in range(30)]
    held = [x for x in rows if x[3] < 5]  # the last five rows are in no cluster
    members = spark.createDataFrame([("g", i, c) for i, _, _, c in held], "group string, doc_id string, cluster long")
    spots = spark.createDataFrame([("g", i, la, SIGNS[la] * w) for i, la, w, _ in rows], "group string, doc_id string, label string, term_weight double")
    stats = themes.cluster_stats(members, spots)
    moved = math.fsum(w for _, la, w, _ in rows if la != "neutral")
    share = {c: rounded(100 * math.fsum(SIGNS[la] * w for _, la, w, k in held if k == c) / moved) for c in range(5)}
    assert {x["cluster"]: x["share_pct"] for x in stats.collect()} == share
    for mood, side in ((-17.0, "negative"), (8.0, "positive"), (4.2, None)):
        pure = {c for c in share if side and sum(la == side for _, la, _, k in held if k == c) / 5 >= 0.7 and share[c] * mood > 0}
        best = min(pure, key=lambda c: (-abs(share[c]), c), default=None)
        found = themes.driver(stats, spark.createDataFrame([("g", mood)], "group string, mood double")).first()
        assert (found and found["cluster"]) == best


def test_names_agree_with_ranking_each_cluster(spark):
    r = random.Random(50)
    docs = spark.createDataFrame([(str(i), " ".join(r.choices(["steel", "oil", "gold", "rates", "chips"], k=4))) for i in range(30)], "doc_id string, text string")
    terms = themes.term_rows(docs)
    tfidf = themes.transform(terms, themes.vocabulary(terms, 30)).cache()
    members = spark.createDataFrame([(str(i), i // 4) for i in range(12)], "doc_id string, cluster long")
    background = docs.where("cast(doc_id as int) >= 12").select("doc_id")
    for by_count in (False, True):
        got = {x["cluster"]: x["name"] for x in themes.names(tfidf, members, background, by_count=by_count).collect()}
        for c in range(3):
            ranked = themes.rank_terms(tfidf, members.where(F.col("cluster") == c).select("doc_id"), background, by_count=by_count)
            key = F.col("n").desc() if by_count else F.col("lift").desc()
            assert got.get(c, []) == [x["term"] for x in ranked.orderBy(key, "term").limit(3).collect()]


def test_quality_documents(spark):
    names = [c.split()[0] for c in gates.INPUTS.replace("array<struct<name: string, responded: boolean, newest_published_at: timestamp>>", "x").split(", ")]
    rows = [HEALTHY, HEALTHY | {"day": DAY - dt.timedelta(days=1), "last_fetched_at": NOW - dt.timedelta(hours=50), "n_unscored": 3}, HEALTHY | {"day": DAY - dt.timedelta(days=2), "last_fetched_at": None, "top_source": 'q"\\x'}]
    results = gates.evaluate(spark.createDataFrame([tuple(x[n] for n in names) for x in rows], gates.INPUTS))
    docs = {x["day"]: json.loads(x["document"]) | {"said": x["blocked"]} for x in gates.documents(results, F.lit("2026-10-01T12:00:00")).collect()}
    for day, doc in docs.items():
        found = results.where(F.col("day") == F.lit(day)).orderBy("position").collect()
        want = [{"kind": x["kind"], "name": x["gate"], "observed": x["observed"] and json.loads(x["observed"]), "status": x["status"], "threshold": x["threshold"], "threshold_key": x["threshold_key"]} for x in found]
        assert doc["gates"] == want and doc["date"] == str(day) and doc["run_at"] == "2026-10-01T12:00:00"
        assert doc["blocked"] == doc["said"] == any(x["status"] == "fail" for x in found)
        assert [bool(x["reason"]) for x in found] == [x["status"] == "fail" for x in found]
    reasons = [x["reason"] for x in results.where("reason is not null").orderBy("day", "position").collect()]
    assert [("50.0 h old" in x, "no fetched" in x, x.startswith("3 headlines")) for x in reasons] == [(False, True, False), (True, False, False), (False, False, True)]
    assert gates.pretty('{"b": 1, "a": [2]}') == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'


def test_clusters_need_enough_rows(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(["steel prices fall again", "steel prices fall hard", "steel prices fall now", "garden party tonight"])], "doc_id string, text string")
    terms = themes.term_rows(docs)
    tfidf = themes.transform(terms, themes.vocabulary(terms, 4, 1)).withColumn("group", F.lit("g")).withColumn("position", F.col("doc_id").cast("int"))
    got = themes.clusters(tfidf, Explain(cluster_distance=0.8)).collect()
    assert sorted(r["doc_id"] for r in got) == ["0", "1", "2"]
    assert themes.clusters(tfidf.where("doc_id < '2'"), Explain()).count() == 0


def test_classifier_keeps_rows_together(spark):
    docs = spark.createDataFrame([("x" * i,) for i in range(1, 34)], "sentence string").repartition(3)
    got = classify.score_records(docs, classify.rule_classifier).collect()
    names = ("negative", "neutral", "positive")
    assert len(got) == 33 and all(r["pred_label"] == names[len(r["sentence"]) % 3] and r["confidence"] == 0.5 + (len(r["sentence"]) % 7) / 20 for r in got)


def test_early_stop():
    assert classify.early_stop([1.0, 0.9, 0.8999, 0.95, 0.91], patience=3) == (2, 5)
    assert classify.early_stop([1.0, 0.5]) == (2, 2)


def test_split_files_are_pinned(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), F.concat(F.lit("t"), F.col("id")).alias("text"), (F.col("id") % 2).cast("string").alias("label"))
    meta = splits.save(splits.stratified(rows), str(tmp_path / "s"))
    assert meta["counts"] == {"train": 70, "val": 14, "test": 16}
    assert splits.load(spark, str(tmp_path / "s"), "id long, text string, label string").count() == 100
    with pytest.raises(FileNotFoundError):
        splits.load(spark, str(tmp_path / "none"), "id long, text string, label string")


def test_losses_and_missing_tokens(spark):
    b = spark.createDataFrame([(1.0, 30, 2.0), (4.0, 10, 2.0)], "loss double, rows long, seconds double")
    assert tuple(metrics.weighted_loss(b).first()) == (1.75, 10.0)
    docs = spark.createDataFrame([("1", "steel steel banks chips"), ("2", "banks chips")], "doc_id string, text string")
    vocab = spark.createDataFrame([("banks",)], "term string")
    assert [tuple(r) for r in themes.top_missing(docs, vocab).collect()] == [("chips", 2), ("steel", 2)]
    o = themes.oov(docs, vocab).first()
    assert (o["n_tokens"], o["n_oov"], o["n_oov_types"], o["docs_all_oov"]) == (6, 4, 2, 0)


def test_disagreements_order(spark):
    rows = [("a", "negative", "neutral", 0.5), ("b", "negative", "neutral", 0.9), ("c", "neutral", "neutral", 0.9), ("d", "neutral", "positive", 0.7)]
    got = metrics.disagreements(spark.createDataFrame(rows, "id string, y_true string, y_pred string, confidence double")).collect()
    assert [r["id"] for r in got] == ["b", "a", "d"]


def test_lede(spark):
    day = dt.date(2026, 10, 1)
    import hashlib

    digest = hashlib.sha256(day.isoformat().encode()).digest()
    pick = lambda slot, values: values[digest[slot] % len(values)]
    c = lambda x, kind: F.lit(x).cast(kind)

    def lede(mood, band, n, change, when, k, terms, clustered):
        text = themes.lede(F.lit(day), c(mood, "double"), c(band, "string"), c(n, "long"), c(change, "double"), c(when, "string"), c(k, "long"), c(terms, "string"), F.lit(clustered))
        return spark.range(1).select(text).first()[0]

    moved = pick(1, themes.CHANGES)[1].format(d="12.8", when="yesterday")
    want = f"{pick(0, themes.SUBJECTS)} leaned moderately negative today (index -21.8, {moved}) {pick(2, themes.COUNTS).format(n='40 headlines')}, "
    assert lede(-21.8, "moderately negative", 40, -12.8, "yesterday", 3, "a and b", True) == want + pick(3, themes.DRIVERS).format(n="3 headlines", terms="a and b") + "."
    assert lede(1.0, "roughly flat", 1, None, None, 3, "a", True).endswith(f"(index +1.0) {pick(2, themes.COUNTS).format(n='1 headline')}, {pick(3, themes.NO_DRIVERS)}.")
    assert lede(1.0, "roughly flat", 2, None, None, None, None, False).endswith("2 headlines.")


def test_term_lift_takes_every_other_document_as_background(spark, tmp_path):
    texts = [("src1", "steel chips steel"), ("src1", "steel rates"), ("src2", "oil rates"), ("src17", "steel oil"), (None, "chips gold"), ("src9", "gold rates")]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.term: (r.n, r.lift) for r in queries.QUERIES["term_lift_all_others"](spark, str(tmp_path)).collect()}
    terms = themes.term_rows(docs)
    weights = {(r.doc_id, r.term): r.tfidf for r in themes.transform(terms, themes.vocabulary(terms, 6)).collect()}
    mean = lambda ids: sum(weights.get((i, "steel"), 0) for i in ids) / len(ids)
    assert got == {"steel": (2, round(mean([0, 1]) / mean([2, 3, 4, 5]), 4))}  # only src17 has it outside src1
    assert {r.term: r.lift for r in queries.QUERIES["term_lift"](spark, str(tmp_path)).collect()} == {"steel": -1.0}


def test_full_threshold_sweep_finds_optima_beyond_a_half(spark, tmp_path):
    score = {"negative": -60, "neutral": 60, "positive": 80}  # n_chars % 201 - 100, in hundredths
    kinds = [k for k in score for _ in range(4)]
    docs = [(i, "en", "src1", score[k] + 100) for i, k in enumerate(kinds)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(k == "positive"), int(k == "negative")) for i, k in enumerate(kinds)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r.pos_cut, r.neg_cut): r.accuracy for r in queries.QUERIES["threshold_sweep_full"](spark, str(tmp_path)).collect()}
    grid = [round(k * 0.05, 2) for k in range(-19, 20)]
    assert set(got) == {(p, n) for p in grid for n in grid if p >= n} and len(got) == 780
    said = lambda x, p, n: "positive" if x / 100 >= p else "negative" if x / 100 <= n else "neutral"
    for (p, n), accuracy in got.items():
        assert accuracy == round(sum(said(score[k], p, n) == k for k in kinds) / len(kinds), 6)
    assert got[0.7, -0.3] == 1.0 and max(a for (p, n), a in got.items() if p <= 0.5) < 1


def test_clusters_of_a_hot_group(spark):
    n = 50_000
    rows = [("hot", i, str(i), f"t{i // 2}", 0.6) for i in range(n)] + [("hot", i, str(i), f"u{i // 4}", 0.8) for i in range(n)]
    rows += [("other", i, f"o{i}", "t", 1.0) for i in range(3)]
    tfidf = spark.createDataFrame(rows, "group string, position int, doc_id string, term string, tfidf double")
    got = themes.clusters(tfidf.repartition(8), Explain()).toPandas()
    want = {("hot", str(i), i // 4 * 4) for i in range(n)} | {("other", f"o{i}", 0) for i in range(3)}
    assert {tuple(x) for x in got.itertuples(index=False)} == want and len(got) == len(want)


def test_registered_themes_at_default_distance_and_size(spark, tmp_path):
    texts = ["steel chips", "steel chips", "steel chips rates", "oil gold", "oil gold"]
    turns = [(1, i, "assistant", t) for i, t in enumerate(texts)]
    spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: sorted(r["size"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert (run("theme_clusters"), run("theme_clusters_default"), run("driver_default")) == ([2, 3], [3], [3])
