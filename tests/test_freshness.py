"""Silent sources over batches of a file stream."""

import datetime as dt

import pytest

from tidemark.streaming import freshness

START = dt.datetime(2024, 3, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def test_a_silent_source_is_reported_once_and_when_it_is_back(rocks, tmp_path):
    spark, reports, dropped = rocks, [], 0
    hours = [
        [("a", 0), ("b", 1), ("a", 2), ("b", None)],
        [("a", 30), ("a", 31)],  # the watermark comes to 30 hours
        [("a", 45), ("b", 3), ("a", 30.5)],  # b's item is behind the watermark and dropped, a's is late; b's limit was at 37 hours
        [("a", 60)],  # the watermark was at 44 hours: b is stale
        [("a", 70), ("b", 69)],
        [("a", 200)],
        [("a", 201)],  # b is stale again
    ]
    for n, rows in enumerate(hours):
        at = [(s, None if h is None else START + dt.timedelta(hours=h)) for s, h in rows]
        spark.createDataFrame(at, "source string, published_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source string, published_at timestamp").parquet(str(tmp_path / "in"))
        found = freshness.silent_sources(stream, 36)
        query = found.writeStream.foreachBatch(lambda df, i: reports.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c"))  # noqa: B023
        done = query.trigger(availableNow=True).start()
        done.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in done.recentProgress for op in p["stateOperators"])
    got = [(r[1], r[2], (r[3] - START).total_seconds() / 3600, r[4], r[5]) for r in reports]
    assert got[:2] == [("b", "stale", 1.0, 1, 0), ("b", "back", 69.0, 2, 0)] and ("b", "stale", 69.0, 2, 0) in got[2:]
    assert dropped == 1 and all(n >= 2 for n, *_ in reports)
    assert {r for r in got[2:] if r[0] == "a"} <= {("a", "stale", 70.0, 7, 1), ("a", "back", 200.0, 8, 1)}
