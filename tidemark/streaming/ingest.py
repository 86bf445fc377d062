"""Micro-batch ingest: a stream of headline files into the store, index and late account.

Each micro-batch upserts into the snapshot (a batch seen twice changes nothing), fills scores
once, recomputes today and yesterday, leaves older stored days frozen, and counts the rows
that came too late for a frozen day. ``availableNow`` drains what has arrived and stops.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.calendar import civil_day
from tidemark.operators import classify, index
from tidemark.sources.store import Store

HEADLINE = "id string, source string, title string, title_norm string, summary string, url string, published_at timestamp, fetched_at timestamp, seq long"


def step(store: Store, batch: DataFrame, load: Callable, now: dt.datetime, today: dt.date, settings: Settings = Settings()) -> dict:
    """One micro-batch; returns its account."""
    account = store.ingest(batch)
    scores = classify.score_unscored(store.headlines(), load, settings.model.batch_size)
    account["scored"] = store.write_scores(scores, now)
    rows = store.headlines().where("label is not null and published_at is not null")
    rows = rows.withColumn("day", civil_day(rows, "published_at", settings.index.timezone))
    touched = batch.select(civil_day(batch, "published_at", settings.index.timezone).alias("day")).where("day is not null").distinct()
    stored = store.daily_index().withColumnRenamed("date", "day").drop("model_id", "computed_at")
    fresh = index.daily_index(rows.join(touched, "day", "left_semi"), settings.index)
    frozen = index.freeze(touched, stored, fresh, today, settings.index)
    write = index.to_write(frozen).drop("action")
    days = write.select("day")
    snap = index.snapshot_terms(rows.join(days, "day", "left_semi"))
    account["late"] = index.late(rows.join(frozen.where("action = 'kept'").select("day"), "day", "left_semi"), store.snapshot()).count()
    store.write_snapshot(snap)
    store.write_days(write, settings.model.id, now)
    return account


def run(spark: SparkSession, incoming: str, store: Store, checkpoint: str, load: Callable, now: dt.datetime, today: dt.date, settings: Settings = Settings()) -> list[dict]:
    """Drain the Parquet files of ``incoming`` that the checkpoint has not seen; accounts by micro-batch."""
    accounts: list[dict] = []
    stream = spark.readStream.schema(HEADLINE).parquet(incoming)
    query = (
        stream.writeStream.foreachBatch(lambda df, n: accounts.append({"batch": n} | step(store, df, load, now, today, settings)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return accounts


def event_days(events: DataFrame, tz: str = "America/New_York", watermark: str = "2 days") -> DataFrame:
    """Streaming counts by civil day and type with a watermark: late events beyond it are dropped by the engine."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return ts.groupBy(F.window("ts", "1 day"), civil_day(ts, "ts", tz).alias("day"), "event_type").agg(F.count("*").alias("n"))
