"""The two jobs: growing input, repeated and failed runs, odd rows, the command line."""

import datetime as dt
import glob
import json
import os
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import common, daily_mood, source_brief

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVENTS = "/root/testdata/sf0.001/events.parquet"


def events(rows):
    return [(i, t, u, kind, v, "{}") for i, t, u, kind, v in rows]


def put(spark, folder, rows, n):
    """A new file of event rows in a folder."""
    spark.createDataFrame(events(rows), daily_mood.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return n


def at(day, hour=12):
    return dt.datetime(2024, 3, day, hour)


def index_rows(spark, base):
    return {r["day"]: (r["n_headlines"], r["n_positive"], round(r["mood_index"], 6), r["written_by"]) for r in daily_mood.output(spark, f"{base}/out").collect()}


def run(spark, base, **cfg):
    return daily_mood.run(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", daily_mood.DEFAULTS | cfg)


def files(base, pattern):
    return {f for f in glob.glob(f"{base}/out/{pattern}/**/*.parquet", recursive=True)}


def test_two_runs_over_growing_input_equal_one(spark, tmp_path):
    whole = spark.read.parquet(EVENTS)
    grown, once = str(tmp_path / "grown"), str(tmp_path / "once")
    ordered = whole.where("event_id % 2 = 0"), whole.where("event_id % 2 = 1")
    cfg = {"recent_days": 10_000}  # no day is frozen
    for part in ordered:
        part.write.mode("append").parquet(f"{grown}/in")
        assert sum(a["read"] for a in run(spark, grown, **cfg)) == part.count()
    assert run(spark, grown, **cfg) == []
    whole.write.parquet(f"{once}/in")
    run(spark, once, **cfg)
    strip = lambda rows: {d: r[:3] for d, r in rows.items()}
    assert strip(index_rows(spark, grown)) == strip(index_rows(spark, once))
    local = daily_mood.headlines(whole, daily_mood.DEFAULTS).where("label is not null").groupBy("day").count().collect()
    assert {r["day"]: r["count"] for r in local} == {d: r[0] for d, r in index_rows(spark, once).items()}
    assert spark.read.parquet(f"{grown}/out/scored").count() == whole.count()


def test_frozen_days_late_rows_and_untouched_files(spark, tmp_path):
    base = str(tmp_path)
    put(spark, base, [(1, at(1), 1, "purchase", 1.0), (2, at(2), 1, "error", 1.0), (3, at(9), 1, "click", 2.0), (4, None, 1, "click", 2.0)], 0)
    assert run(spark, base) == [{"batch": 0, "read": 4, "new": 4, "days": 3, "late": 0}]
    first, before = index_rows(spark, base), files(base, "index")
    put(spark, base, [(5, at(1), 1, "error", 1.0), (6, at(9), 1, "purchase", 1.0), (3, at(9), 1, "click", 2.0), (7, at(8), 2, "signup", 200.0)], 1)
    assert run(spark, base) == [{"batch": 1, "read": 4, "new": 3, "days": 1, "late": 1}]  # 3 is held, 5 is late, 7 has no label
    after = index_rows(spark, base)
    assert after[dt.date(2024, 3, 1)] == first[dt.date(2024, 3, 1)] and after[dt.date(2024, 3, 2)] == first[dt.date(2024, 3, 2)]
    assert after[dt.date(2024, 3, 9)][:2] == (2, 1) and dt.date(2024, 3, 8) not in after
    gone = {f.split("/index/")[1].split("/")[0] for f in before - files(base, "index")}
    assert gone == {"day=2024-03-09"}, "only the day that the batch touches is replaced"
    assert [tuple(r) for r in spark.read.parquet(f"{base}/out/late").select("day", "n_late", "batch").collect()] == [(dt.date(2024, 3, 1), 1, 1)]
    put(spark, base, [(4, None, 1, "click", 2.0), (8, None, 1, "click", 2.0)], 2)
    assert run(spark, base)[0]["new"] == 1


def test_a_batch_taken_again_after_a_failure_gives_the_same(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    put(spark, base, [(i, at(1 + i % 9), i % 3, "purchase", float(i)) for i in range(20)], 0)
    run(spark, base)
    put(spark, base, [(i, at(1 + i % 9), i % 3, "error", float(i)) for i in range(15, 40)], 1)
    real = daily_mood.take
    shutil.copytree(f"{base}/in", f"{base}/copy/in")
    monkeypatch.setattr(daily_mood, "take", lambda *a: real(*a) and 1 / 0)  # all is written, then the run dies before its commit
    with pytest.raises(Exception, match="division"):
        run(spark, base)
    died = index_rows(spark, base)
    monkeypatch.setattr(daily_mood, "take", real)
    (again,) = run(spark, base)
    assert index_rows(spark, base) == died and again["batch"] == 1 and again["late"] == 16
    assert spark.read.parquet(f"{base}/out/scored").groupBy("id").count().where("count > 1").count() == 0


def test_files_per_batch(spark, tmp_path):
    base = str(tmp_path)
    for n in range(3):
        put(spark, base, [(n, at(1 + n), 1, "purchase", 1.0)], n)
    assert [a["new"] for a in run(spark, base, files_per_batch=1)] == [1, 1, 1]
    assert len(index_rows(spark, base)) == 3


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"recent_days": 3}')
    assert common.settings(str(tmp_path / "a.json"), daily_mood.DEFAULTS)["recent_days"] == 3
    (tmp_path / "a.json").write_text('{"recent": 3}')
    with pytest.raises(ValueError, match="unknown settings recent"):
        common.settings(str(tmp_path / "a.json"), daily_mood.DEFAULTS)
    for job, name in ((daily_mood, "daily_mood"), (source_brief, "source_brief")):
        assert common.settings(f"{REPO}/jobs/{name}.json", job.DEFAULTS) == job.DEFAULTS


DOCS = [
    (1, "Alpha beta alpha beta the", "a"), (2, "alpha BETA, alpha beta the!", "b"), (3, "gamma delta and", "b"), (4, "gamma delta idiot", "b"),
    (5, None, None), (6, "", "a"), (7, "alpha beta gamma", "a"), (8, "only here only here", " "), (9, "und der only here", ""), (10, "x " * 3000, "c"),
]


def test_source_brief_on_odd_rows_and_again(spark, tmp_path):
    docs, target = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("term", "group", "n", "key")}).repartition(3).write.parquet(docs)
    assert source_brief.run(spark, docs, target) == {"read": 10, "kept": 8, "sources": 4}
    rows = {r["source"]: r for r in source_brief.output(spark, target).collect()}
    assert {s: (r["n_docs"], r["n_kept"]) for s, r in rows.items()} == {"a": (3, 2), "b": (3, 2), "unknown": (3, 3), "c": (1, 1)}  # 2 equals 1, 6 equals 5
    assert rows["b"]["terms"] == "delta, gamma delta, gamma" and rows["unknown"]["terms"].startswith("here, only, only here") and rows["c"]["terms"] == ""
    assert rows["a"]["mood"] == 100 and rows["b"]["n_negative"] == 2
    first = sorted(map(str, rows.values()))
    parts = {os.path.basename(p) for p in glob.glob(f"{target}/scores/source=*")}
    assert parts == {"source=a", "source=b", "source=c", "source=unknown"}
    source_brief.run(spark, docs, target)
    assert sorted(map(str, source_brief.output(spark, target).collect())) == first
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none"))
    assert source_brief.run(spark, str(tmp_path / "none"), str(tmp_path / "out2")) == {"read": 0, "kept": 0, "sources": 0}


def test_lifts_equal_a_count_by_hand(spark):
    from tidemark.operators import themes

    tfidf = [(1, "x", 0.5), (1, "y", 0.1), (2, "x", 0.25), (3, "x", 0.5), (3, "z", 0.7), (4, "z", 0.2)]
    groups = {1: "a", 2: "a", 3: "b", 4: "b", 5: "b"}
    got = themes.lift_by_group(spark.createDataFrame(tfidf, "doc_id long, term string, tfidf double"), spark.createDataFrame(list(groups.items()), "doc_id long, group string"), 1)
    sizes, want = Counter(groups.values()), {}
    for g in sizes:
        for term in {t for d, t, _ in tfidf if groups[d] == g}:
            own, other = (sum(w for d, t, w in tfidf if t == term and (groups[d] == g) == mine) for mine in (True, False))
            want[g, term] = float("inf") if not other else (own / sizes[g]) / (other / (len(groups) - sizes[g]))
    assert {(r["group"], r["term"]): r["lift"] for r in got.collect()} == pytest.approx(want)
    top = themes.first_terms(got, 1).collect()
    assert {(r["group"], r["term"], r["rank"]) for r in top} == {("a", "y", 1), ("b", "z", 1)}


def test_command_line(tmp_path):
    args = [sys.executable, "-m", "jobs.daily_mood", "--source", EVENTS + "*", "--target", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/c"]
    done = subprocess.run(args, cwd=REPO, env=os.environ | {"PYTHONPATH": REPO}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1000 events, wrote 1000 new headlines" in done.stderr and glob.glob(f"{tmp_path}/out/index/day=*")
    with open(f"{REPO}/jobs/daily_mood.json", encoding="utf-8") as f:
        assert json.load(f)["recent_days"] == 1


def test_groups_of_a_term_meet_packed_in_parts_of_any_size(spark, monkeypatch):
    """Before, every group's term was a row of two shuffles."""
    from tidemark.operators import blocks, themes

    rows = [(f"t{i % 13}", "abc"[i % 3] if i % 7 else None, 1 / (1 + i)) for i in range(300)]
    tfidf = spark.createDataFrame(rows, "term string, group string, tfidf double").repartition(3)
    sizes = spark.createDataFrame([(g, 100) for g in "abc"], "group string, rows long")
    want = {(t, g): (sum(r[:2] == (t, g) for r in rows), sum(r[0] == t for r in rows), pytest.approx(sum(r[2] for r in rows if r[:2] == (t, g)), abs=1e-12)) for t, g, _ in rows}
    monkeypatch.setattr(blocks, "SUMMED_BYTES", 200)
    assert {(r["term"], r["group"]): (r["n"], r["all_n"], r["s"]) for r in blocks.group_sums(tfidf, 5).collect()} == want
    plan = themes.lift_of_groups(tfidf, sizes, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(range" in plan and "hashpartitioning(term" not in plan and "Window" not in plan
