"""Table schemas and their constraints as validation queries (Spark enforces none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("negative", "neutral", "positive")
HEADLINES = (
    "id string, source string, title string, title_norm string, summary string, url string, "
    "published_at timestamp, fetched_at timestamp, label string, confidence double, scored_at timestamp"
)
DAILY_INDEX = (
    "date date, mood_index double, n_headlines long, n_positive long, n_neutral long, n_negative long, mean_confidence double, "
    "n_low_conf long, n_sources long, source_counts map<string, long>, model_id string, computed_at timestamp"
)
SNAPSHOT_TERMS = "date date, published_at timestamp, id string, term double"
FEED_STATUS = "name string, received long, skipped long, newest_published_at timestamp, error string"


def violations(headlines: DataFrame) -> DataFrame:
    """(constraint, n) of a headlines table: no row for a constraint that holds."""
    unique = [
        headlines.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"unique {key}").alias("constraint"), "n")
        for key in ("id", "title_norm")
    ]
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("label", "confidence", "scored_at"))
    rows = headlines.agg(
        F.count_if(~F.col("label").isin(*LABELS)).alias("label domain"),
        F.count_if(~F.col("confidence").between(0, 1)).alias("confidence domain"),
        F.count_if(~filled.isin(0, 3)).alias("scored whole"),
    )
    checks = rows.unpivot([], rows.columns, "constraint", "n")
    for u in unique:
        checks = checks.unionByName(u)
    return checks.where("n > 0")


def index_violations(index: DataFrame) -> DataFrame:
    """Days whose counts or mood are out of their domains."""
    counts = F.col("n_headlines") == F.col("n_positive") + F.col("n_neutral") + F.col("n_negative")
    mood = F.col("mood_index").isNull() | F.col("mood_index").between(-100, 100)
    return index.where(~(counts & mood))
