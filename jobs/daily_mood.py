"""Job 1, incremental: new event files become scored headlines and the daily mood index.

    python -m jobs.daily_mood --source EVENTS --target OUT --checkpoint DIR [--config FILE]

A file stream with a checkpoint takes the Parquet files that no earlier run has taken and ends
(availableNow). Each batch writes

* ``OUT/scored`` by day and batch: headlines that no earlier batch holds (the first one of an id stays),
* ``OUT/index`` by day: the mood index of the days that the batch touches. Days from the newest
  stored day less ``recent_days`` on are recomputed; an older day that has a row is frozen,
* ``OUT/late`` by batch: headlines that came for a frozen day, counted by day.

Of what earlier batches wrote only the partitions of touched days are read; a headline is known by its
id and day. Every write replaces the partitions that it names, and decisions look at earlier
batches alone, so a batch that is taken again after a failure gives the same files. Undated rows are kept and not indexed.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, new_folder, settings, stored
from tidemark.config import Index
from tidemark.functions.calendar import civil_day
from tidemark.operators import index
from tidemark.plans.views import EV

LOG = logging.getLogger("jobs.daily_mood")
DEFAULTS = {
    "timezone": "America/New_York", "recent_days": 1, "low_confidence": 0.6, "files_per_batch": 0,
    "labels": {"purchase": "positive", "signup": "positive", "error": "negative"}, "unscored_from": 150.0,
}
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SCORED = "id long, source string, label string, confidence double, published_at timestamp_ntz, day date, batch long"
INDEX = (
    "mood_index double, n_headlines long, n_positive long, n_neutral long, n_negative long, mean_confidence double, "
    "n_low_conf long, n_sources long, source_counts map<string, long>, written_by long, day date"
)


def headlines(events: DataFrame, cfg: dict) -> DataFrame:
    """Events as headlines: label by type, confidence in whole hundredths; the dearest ones have no label yet."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in cfg["labels"].items() for x in kv]), F.col("event_type")), F.lit("neutral"))
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.when(F.col("value") < cfg["unscored_from"], label).alias("label"), ((F.lit(34) + F.round(F.col("value") * 100).cast("long") % 67) / 100).alias("confidence"),
        F.col("ts").alias("published_at"), civil_day(events, "ts", cfg["timezone"]).alias("day"),
    )


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that the rows name; a day of any size is spread over files of a good size."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(batch: DataFrame, n: int, target: str, cfg: dict) -> dict:
    """One batch into the outputs; returns its account."""
    spark = batch.sparkSession
    scored, rules = f"{target}/scored", Index(timezone=cfg["timezone"], recent_days=cfg["recent_days"], low_confidence=cfg["low_confidence"])
    arriving = headlines(batch, cfg)
    days = [r["day"] for r in arriving.select("day").distinct().collect()]  # calendar days, whatever the rows
    dated = sorted(d for d in days if d is not None)
    touches = F.col("day").isin(dated) | (F.col("day").isNull() if None in days else F.lit(False))  # a filter on partitions
    seen = Observation()
    first = arriving.observe(seen, F.count("*").alias("read")).groupBy("id", "day").agg(F.min(F.struct("published_at", "source", "label", "confidence")).alias("r"))
    held = stored(spark, scored, SCORED, "day", "batch").where(touches & (F.col("batch") < n)).select(F.col("id").alias("_id"), F.col("day").alias("_day"))
    fresh = first.join(held, F.col("id").eqNullSafe(F.col("_id")) & F.col("day").eqNullSafe(F.col("_day")), "left_anti").select("id", "r.*", "day", F.lit(n).cast("long").alias("batch"))
    _replace(fresh, scored, "day", "batch")

    table = stored(spark, scored, SCORED, "day", "batch").where(touches)
    new = {r["day"]: r["n"] for r in table.where(F.col("batch") == n).groupBy("day").agg(F.count("*").alias("n")).collect()}
    account = {"batch": n, "read": seen.get["read"], "new": sum(new.values()), "days": 0, "late": 0}
    if not dated:
        return account
    before = stored(spark, f"{target}/index", INDEX, "day").where(F.col("written_by") < n).drop("written_by")
    newest = before.agg(F.max("day")).first()[0]
    today = max(d for d in (dated[-1], newest) if d is not None)
    touched = spark.createDataFrame([(d,) for d in dated], "day date")
    fresh = index.daily_index(table.where("day is not null and label is not null"), rules)
    decided = index.freeze(touched, before.where(F.col("day").isin(dated)), fresh, today, rules).cache()  # one row a day
    actions = {r["day"]: r["action"] for r in decided.select("day", "action").collect()}
    _replace(index.to_write(decided).drop("action").withColumn("written_by", F.lit(n).cast("long")), f"{target}/index", "day")
    decided.unpersist()
    late = [(d, new[d], n) for d, a in actions.items() if a == "kept" and d in new]
    _replace(spark.createDataFrame(late, "day date, n_late long, batch long"), f"{target}/late", "batch")
    return account | {"days": sum(a in ("recomputed", "written") for a in actions.values()), "late": sum(x[1] for x in late)}


def run(spark: SparkSession, source: str, target: str, checkpoint: str, cfg: dict = DEFAULTS) -> list[dict]:
    """Take what is new in ``source``; the accounts of the batches, none where nothing is new."""
    accounts: list[dict] = []

    def step(batch: DataFrame, n: int) -> None:
        accounts.append(take(batch, n, target, cfg))
        LOG.info("batch %(batch)d: read %(read)d events, wrote %(new)d new headlines and %(days)d days, %(late)d came late", accounts[-1])

    reader = spark.readStream.schema(EVENTS)
    if cfg["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", cfg["files_per_batch"])
    stream = reader.parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    LOG.info("%s: %d batches into %s", source, len(accounts), target)
    return accounts


def output(spark: SparkSession, target: str) -> DataFrame:
    return stored(spark, f"{target}/index", INDEX, "day")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after two runs over the whole table, a file or a folder of files (a stream takes a single file by a pattern)."""
    base = new_folder(spark, "job1-daily-mood")
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet*", f"{base}/out", f"{base}/checkpoint")
    found = output(spark, f"{base}/out").drop("source_counts", "written_by")
    return found.withColumns({"day": F.col("day").cast("string"), "mood_index": F.round("mood_index", 6), "mean_confidence": F.round("mean_confidence", 6)})


SQL = f"""WITH {EV}
SELECT day::VARCHAR AS day, round((100 * sum(c100 * s))::DOUBLE / sum(c100), 6) AS mood_index, count(*) AS n_headlines, count(*) FILTER (WHERE s = 1) AS n_positive,
       count(*) FILTER (WHERE s = 0) AS n_neutral, count(*) FILTER (WHERE s = -1) AS n_negative, round(sum(c100) / 100.0::DOUBLE / count(*), 6) AS mean_confidence,
       count(*) FILTER (WHERE confidence < 0.6) AS n_low_conf, count(DISTINCT source) AS n_sources FROM ev GROUP BY day"""


def main() -> None:
    a = arguments(__doc__.splitlines()[0], "daily_mood.json", ("source", "event files"), ("target", "output folder"), ("checkpoint", "checkpoint folder"))
    spark = SparkSession.builder.appName("daily_mood").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.source, a.target, a.checkpoint, settings(a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
