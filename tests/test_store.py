"""The bucketed store against a sequential merge, and the files that a batch leaves alone."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import dedupe
from tidemark.sources.store import Store

NOW = dt.datetime(2026, 10, 1, 12)
BATCH = "id string, source string, title string, title_norm string, summary string, url string, published_at timestamp, fetched_at timestamp, seq long"


def row(i, title, published, seq):
    return (i, "s", title, title, "", f"https://x/{i}", published, NOW, seq)


def sequential(batches):
    ids, titles, kept, accounts = {}, {}, [], []
    for rows in batches:
        before = len(kept)
        for i, t, p in rows:
            hit = titles.get(t) or ids.get(i)
            if hit is None:
                hit = ids[i] = titles[t] = [i, t, p]
                kept.append(hit)
            elif p is not None and (hit[2] is None or p < hit[2]):
                hit[2] = p
        accounts.append({"received": len(rows), "inserted": len(kept) - before, "duplicates": len(rows) - len(kept) + before})
    return sorted(map(tuple, kept)), accounts


def files(path, table):
    """Data files of the live versions by bucket."""
    out, live = {}, Store(SparkSession.active(), path)._live(table)
    for f in (f for b, v in live.items() for f in glob.glob(f"{path}/{table}/data/bucket={b}/v={v}/*.parquet")):
        out.setdefault(f.split("bucket=")[1].split("/")[0], set()).add(f)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_batches_equal_the_sequential_merge(spark, tmp_path, seed):
    r = random.Random(seed)
    when = lambda: r.choice([None, dt.datetime(2026, 1, 1) + dt.timedelta(hours=r.randint(0, 500))])
    batches = [[(str(r.randint(0, 40)), f"t{r.randint(0, 40)}", when()) for _ in range(n)] for n in (40, 0, 1, 60)]
    store = Store(spark, str(tmp_path / "s"), buckets=7)
    want, accounts = sequential(batches)
    for rows, account in zip(batches, accounts):
        df = spark.createDataFrame([row(*x, k) for k, x in enumerate(rows)], BATCH)
        assert store.ingest(df) == account
    assert sorted((x.id, x.title_norm, x.published_at) for x in store.headlines().collect()) == want
    assert Store(spark, str(tmp_path / "s"), buckets=99).buckets == 7, "a store keeps its number of buckets"
    assert schema.violations(store.headlines()).count() == 0
    assert store.ingest(df)["inserted"] == 0


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, buckets=512)
    n = 1_000_000
    ids = spark.range(n).select(F.concat(F.lit("h"), F.col("id")).alias("id"))
    old = ids.select(
        "id", F.lit("s").alias("source"), F.lit("").alias("title"), F.concat(F.lit("t"), "id").alias("title_norm"), F.lit("").alias("summary"), F.lit("").alias("url"),
        F.lit(NOW).cast("timestamp").alias("published_at"), F.lit(NOW).cast("timestamp").alias("fetched_at"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("timestamp").alias("scored_at"), store.bucket(F.col("id")).alias("bucket"),
    )
    store._replace(old, "headlines", list(range(512)))
    store._replace(old.select("title_norm", "id", store.bucket(F.col("title_norm")).alias("bucket")), "titles", list(range(512)))
    before, named = files(path, "headlines"), files(path, "titles")
    earlier = NOW - dt.timedelta(days=1)
    rows = [row(f"h{i}", f"other {i}", earlier, i) for i in range(30)]  # stored ids, of which the date moves
    rows += [row(f"new {i}", f"th{1000 + i}", NOW, 100 + i) for i in range(30)]  # stored titles: nothing moves
    rows += [row(f"new {i}", f"new {i}", NOW, 200 + i) for i in range(40, 80)]
    batch = spark.createDataFrame(rows, BATCH)
    assert store.ingest(batch) == {"received": 100, "inserted": 40, "duplicates": 60}
    after = files(path, "headlines")
    place = lambda keys: {str(x[0]) for x in spark.createDataFrame([(k,) for k in keys], "k string").select(store.bucket(F.col("k"))).collect()}
    touched = place([f"h{i}" for i in range(30)] + [f"new {i}" for i in range(40, 80)])
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < 80
    assert {b for b, f in files(path, "titles").items() if f != named.get(b)} == place([f"new {i}" for i in range(40, 80)])
    assert store.headlines().count() == n + 40
    assert store.headlines().where(F.col("published_at") == F.lit(earlier)).count() == 30
    before = after
    scores = spark.createDataFrame([(f"h{i}", "positive", 0.5) for i in range(5)] + [("gone", "neutral", 0.5)], "id string, label string, confidence double")
    assert store.write_scores(scores, NOW) == 5 and store.write_scores(scores, NOW) == 0
    after = files(path, "headlines")
    assert {b for b in after if after[b] != before[b]} <= place([f"h{i}" for i in range(5)] + ["gone"])


def test_a_name_without_its_row_is_no_hit(spark, tmp_path):
    """A batch that died between its two writes enters whole when it is taken again."""
    store = Store(spark, str(tmp_path / "s"), buckets=3)
    batch = spark.createDataFrame([row("a", "t", NOW, 0)], BATCH)
    named = batch.select("title_norm", "id", store.bucket(F.col("title_norm")).alias("bucket"))
    store._replace(named, "titles", [named.first()["bucket"]])
    assert store.ingest(batch) == {"received": 1, "inserted": 1, "duplicates": 0}
    assert store.ingest(spark.createDataFrame([row("b", "t", NOW, 0)], BATCH))["inserted"] == 0
    assert store._read("titles").count() == 1


def test_readers_keep_their_version_until_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.ingest(spark.createDataFrame([row("a", "t", NOW, 0)], BATCH))
    old = store.headlines()
    store.ingest(spark.createDataFrame([row(f"b{i}", f"u{i}", NOW, i) for i in range(9)], BATCH))
    (tmp_path / "s/headlines/data/bucket=0/v=99").mkdir(parents=True)  # left by a write that failed
    assert old.count() == 1 and store.headlines().count() == 10
    store.vacuum()
    assert store.headlines().count() == 10 and len(glob.glob(str(tmp_path / "s/headlines/data/*/*"))) == 2


def test_rows_that_share_no_key_are_not_shuffled(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("a", "z", 3), ("c", "y", 4), ("d", "w", 5)], "id string, title_norm string, seq long").withColumn("published_at", F.lit(None).cast("timestamp"))
    keys = dedupe.shared(rows)
    assert [[x[0] for x in k.collect()] for k in keys] == [["a"], ["y"]]
    alone, together = dedupe.parted(rows, *keys)
    assert [x.seq for x in alone.collect()] == [5] and sorted(x.seq for x in together.collect()) == [1, 2, 3, 4]
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(x.seq for x in dedupe.merge(rows).collect()) == [1, 2, 5]
