"""First-seen dedupe on two keys with earliest-date merge.

Rows come in order (seq). A row enters unless a row that has entered shares its id or its
title key; of a duplicate only an earlier published_at is kept. A dropped row blocks
nothing, so this is the ordered maximal independent set of the two-key graph: in rounds,
rows that lead both their groups among the undecided enter and rows that touch an entered
row drop. Rounds are few (the longest chain of alternating conflicts).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a session of one machine without one gets a temporary folder, a cluster an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table: write to the shared folder as Parquet and read it again."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entering(rows: DataFrame) -> DataFrame:
    """Of rows (id, title_norm, seq), those that enter."""
    shared_folder(rows.sparkSession)
    open_ = rows.select("id", "title_norm", "seq").checkpoint()
    entered = None
    while not open_.isEmpty():
        by_id = open_.groupBy("id").agg(F.min("seq").alias("id_lead"))
        by_title = open_.groupBy("title_norm").agg(F.min("seq").alias("title_lead"))
        lead = open_.join(by_id, "id").join(by_title, "title_norm").where("seq = id_lead and seq = title_lead").select("id", "title_norm", "seq").checkpoint()
        entered = lead if entered is None else entered.union(lead)
        rest = open_.join(lead.select("id"), "id", "left_anti").join(lead.select("title_norm"), "title_norm", "left_anti")
        open_ = rest.select("id", "title_norm", "seq").checkpoint()
    return entered if entered is not None else open_


def shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids and the title keys that more than one row (id, title_norm) has, as tables: only keys are shuffled to find them."""
    several = lambda key: written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1).where(F.col(key).isNotNull()).select(key), f"shared-{key}")
    return several("id"), several("title_norm")


def parted(rows: DataFrame, ids: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that share neither key with another, and the others. The keys' tables tell their size, so the planner need not shuffle rows where few are shared."""
    both = rows.join(ids.withColumn("_i", F.lit(True)), "id", "left").join(titles.withColumn("_t", F.lit(True)), "title_norm", "left")
    alone = F.col("_i").isNull() & F.col("_t").isNull()
    return both.where(alone).select(*rows.columns), both.where(~alone).select(*rows.columns)


def merge(rows: DataFrame) -> DataFrame:
    """The rows that enter, with the earliest published_at of themselves and of the duplicates that hit them.

    A duplicate that hits two entered rows updates the one that shares its title. A row that shares no key enters as it is.
    """
    alone, together = parted(rows, *shared(rows))
    return settled(together).unionByName(alone)


def settled(rows: DataFrame) -> DataFrame:
    """``merge`` of rows that share keys."""
    kept = entering(rows)
    by_title = kept.select("title_norm", F.col("seq").alias("title_seq"))
    by_id = kept.select("id", F.col("seq").alias("id_seq"))
    hits = rows.select("id", "title_norm", "seq", "published_at").join(by_title, "title_norm", "left").join(by_id, "id", "left")
    before = lambda c: F.when(F.col(c) < F.col("seq"), F.col(c))
    owner = F.when((F.col("title_seq") == F.col("seq")), F.col("seq")).otherwise(F.coalesce(before("title_seq"), before("id_seq")))
    earliest = hits.groupBy(owner.alias("seq")).agg(F.min("published_at").alias("published_at"))
    return rows.drop("published_at").join(kept.select("seq"), "seq", "left_semi").join(earliest, "seq")


def fill_scores(headlines: DataFrame, scores: DataFrame, scored_at, mark: str | None = None) -> DataFrame:
    """Set label, confidence and scored_at only where a row has none; scores are (id, label, confidence). ``mark`` names a column that says which rows got one."""
    s = scores.select("id", F.col("label").alias("_l"), F.col("confidence").alias("_c"))
    fresh = F.col("label").isNull() & F.col("_l").isNotNull()
    joined = headlines.join(s, "id", "left")
    filled = joined.withColumns(({mark: fresh} if mark else {}) | {
        "scored_at": F.when(fresh, F.lit(scored_at).cast("timestamp")).otherwise(F.col("scored_at")),
        "confidence": F.when(fresh, F.col("_c")).otherwise(F.col("confidence")),
        "label": F.when(fresh, F.col("_l")).otherwise(F.col("label")),
    })
    return filled.select(*headlines.columns, *([mark] if mark else []))
