"""The daily mood index and its materialisation rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Index
from tidemark.functions.numbers import exact_sum
from tidemark.functions.scalars import sign


def term() -> Column:
    """A headline's signed weight."""
    return F.col("confidence") * sign(F.col("label"))


def daily_index(scored: DataFrame, cfg: Index = Index()) -> DataFrame:
    """One row a day of ``scored`` (day, source, label, confidence).

    mood = 100 * sum(confidence * sign) / sum(confidence) in exact decimals, null where there is no weight.
    Rows are first added up by day and source, so a busy day is one row a source and task when it meets.
    """
    by_source = scored.groupBy("day", "source").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == "positive").alias("p"),
        F.count_if(F.col("label") == "neutral").alias("u"),
        F.count_if(F.col("label") == "negative").alias("m"),
        F.count_if(F.col("confidence") < cfg.low_confidence).alias("low"),
        exact_sum(F.col("confidence")).alias("weight"),
        exact_sum(term()).alias("pull"),
    )
    counts = F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")), "n")))
    return by_source.groupBy("day").agg(
        (F.try_divide(F.sum("pull").cast("double"), F.sum("weight").cast("double")) * 100).alias("mood_index"),
        F.sum("n").alias("n_headlines"), F.sum("p").alias("n_positive"), F.sum("u").alias("n_neutral"), F.sum("m").alias("n_negative"),
        F.try_divide(F.sum("weight").cast("double"), F.sum("n").cast("double")).alias("mean_confidence"),
        F.sum("low").alias("n_low_conf"), F.count("*").alias("n_sources"),
        F.map_from_entries(counts).alias("source_counts"),
    )


def snapshot_terms(scored: DataFrame) -> DataFrame:
    """The rows behind an index: (date, published_at, id, term). A long table instead of an array a day, so a day may be of any size."""
    return scored.select(F.col("day").alias("date"), "published_at", "id", term().alias("term"))


def ordered_terms(snapshot: DataFrame) -> DataFrame:
    """One array a day in (published_at, id) order, for exports of days of bounded size."""
    listed = F.array_sort(F.collect_list(F.struct("published_at", "id", "term")))
    return snapshot.groupBy("date").agg(F.transform(listed, lambda t: F.struct(t["id"].alias("id"), t["term"].alias("term"))).alias("terms"))


def freeze(requested: DataFrame, stored: DataFrame, fresh: DataFrame, today: dt.date, cfg: Index = Index()) -> DataFrame:
    """Requested days with their action and the index that holds: stored rows of older days win.

    Days from today - recent_days on are recomputed; an older stored day is kept; an older day
    without a stored row is written; a day without headlines is empty and never stored.
    """
    recent = F.col("day") >= F.lit(today) - F.expr(f"INTERVAL '{cfg.recent_days}' DAY")
    s = stored.select("day", F.struct(*[c for c in stored.columns if c != "day"]).alias("s"))
    f = fresh.select("day", F.struct(*[c for c in fresh.columns if c != "day"]).alias("f"))
    both = requested.select("day").distinct().join(s, "day", "left").join(f, "day", "left")
    action = (
        F.when(~recent & F.col("s").isNotNull(), "kept").when(F.col("f").isNull(), "empty").when(recent, "recomputed").otherwise("written")
    )
    held = F.when(action == "kept", F.col("s")).otherwise(F.col("f"))
    return both.select("day", action.alias("action"), held.alias("held")).select("day", "action", "held.*")


def to_write(frozen: DataFrame) -> DataFrame:
    return frozen.where(F.col("action").isin("recomputed", "written"))


def late(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows of a day that its snapshot does not hold: they arrived after the day was frozen."""
    return rows.join(snapshot.select("id"), "id", "left_anti")


def counted(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows that the snapshot holds, with their stored term; raises where a stored id has no row."""
    missing = snapshot.join(rows.select("id"), "id", "left_anti").limit(1)
    if not missing.isEmpty():
        raise ValueError(f"the snapshot holds {missing.first()['id']!r}, which has no row")
    return rows.join(snapshot.select("id", "term"), "id")
