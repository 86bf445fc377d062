"""Domain views over the driver's tables, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import civil_day

TZ = "America/New_York"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Events as headlines: label by type, confidence in whole hundredths, New York day; the dearest events are unscored."""
    e = table(spark, d, "events")
    label = F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    hundredths = F.lit(34) + F.round(F.col("value") * 100).cast("long") % 67
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.when(F.col("value") < 150, label).alias("label"), (hundredths / 100).alias("confidence"), F.col("ts").alias("published_at"),
        civil_day(e, "ts", TZ).alias("day"), "value", "user_id",
    )


def headlines(spark: SparkSession, d: str) -> DataFrame:
    return raw_headlines(spark, d).where("label is not null")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a rule's prediction."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    true = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    said = F.when(F.col("n_chars") < 900, "neutral").when(F.col("lang").isin("en", "fr"), "positive").otherwise("negative")
    return rows.select("doc_id", "lang", "source", "n_chars", true.alias("y_true"), said.alias("y_pred"))


RAW = """raw AS (
  SELECT event_id AS id, 'src' || (user_id % 3) AS source,
         CASE WHEN value >= 150 THEN NULL WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS label,
         (34 + round(value * 100)::BIGINT % 67) / 100::DOUBLE AS confidence, 34 + round(value * 100)::BIGINT % 67 AS c100,
         ts AS published_at, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS day, value, user_id
  FROM events)"""
EV = RAW + """,
ev AS (SELECT *, CASE label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS s FROM raw WHERE label IS NOT NULL)"""
IDX = EV + """,
idx AS (SELECT day, round((100 * sum(c100 * s))::DOUBLE / sum(c100), 9) AS mood, count(*) AS n, count(*) FILTER (WHERE confidence < 0.6) AS low FROM ev GROUP BY day)"""
GOLD = """gold AS (
  SELECT doc_id, d.lang, d.source, d.n_chars,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y_true,
         CASE WHEN n_chars < 900 THEN 'neutral' WHEN lang IN ('en', 'fr') THEN 'positive' ELSE 'negative' END AS y_pred
  FROM labels JOIN documents d USING (doc_id))"""
