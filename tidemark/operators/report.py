"""Report aggregates: ranking, shares, pivots and headers, for all days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Index, Report
from tidemark.functions.numbers import certainty, exact_sum, half_up, percent
from tidemark.functions.scalars import linkable, named_source
from tidemark.operators.index import term

#: Order of sentiments in the report.
ORDER = ("negative", "positive", "neutral")


def rank_of(label: Column) -> Column:
    out = F.lit(len(ORDER))
    for i, name in enumerate(ORDER):
        out = F.when(label == name, i).otherwise(out)
    return out


def canonical() -> tuple[Column, ...]:
    """Confidence falling, earliest first, undated last, id."""
    return F.col("confidence").desc(), F.col("published_at").asc_nulls_last(), F.col("id").asc()


def contributions(scored: DataFrame) -> DataFrame:
    """Rows with contribution_pct, their part of the day's movement; null for neutral ones.

    The day's sum joins back as a small table instead of a window, so a busy day stays spread out.
    """
    moved = scored.groupBy("day").agg(exact_sum(F.abs(term())).cast("double").alias("movement"))
    share = half_up(F.try_divide(F.abs(term()) * 100, F.col("movement")))
    return scored.join(moved, "day").withColumn("contribution_pct", F.when(F.col("label") != "neutral", share))


def finished(scored: DataFrame, cfg: Index = Index()) -> DataFrame:
    """Rows ready to print: whole percent, unsure, linked, source name, contribution."""
    rows = contributions(scored)
    return rows.select(
        "day", "id", "label", certainty(F.col("confidence")).alias("certainty_pct"), (F.col("confidence") < cfg.low_confidence).alias("unsure"),
        *[c for c in ("title", "url") if c in rows.columns], *([linkable(F.col("url")).alias("linked")] if "url" in rows.columns else []),
        named_source(F.col("source")).alias("source"), "contribution_pct", "confidence", "published_at",
    )


def recommended(scored: DataFrame, cfg: Report = Report()) -> DataFrame:
    """Top rows of each day and sentiment with their rank; the rank limit is pushed below the shuffle."""
    wanted = F.create_map(*[F.lit(x) for name in ORDER for x in (name, getattr(cfg, name))])
    most = max(getattr(cfg, n) for n in ORDER)
    w = Window.partitionBy("day", "label").orderBy(*canonical())
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= wanted[F.col("label")])


def shortfalls(scored: DataFrame, cfg: Report = Report()) -> DataFrame:
    """(day, label, n, wanted) where a day has fewer rows of a sentiment than the report asks for."""
    days = scored.select("day").distinct()
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(getattr(cfg, n)).alias("wanted")) for n in ORDER]))
    want = days.select("day", asked.alias("a")).select("day", "a.*")
    got = scored.groupBy("day", "label").agg(F.count("*").alias("n"))
    return want.join(got, ["day", "label"], "left").na.fill(0, ["n"]).where("n < wanted").select("day", "label", "n", "wanted")


def slices(scored: DataFrame) -> DataFrame:
    """Count and share of each sentiment a day, zero ones too; pie_rank orders the slices that are drawn."""
    counts = scored.groupBy("day").pivot("label", list(ORDER)).count().na.fill(0)
    total = F.col("negative") + F.col("positive") + F.col("neutral")
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("sentiment"), F.lit(i).alias("position"), F.col(n).alias("count")) for i, n in enumerate(ORDER)]))
    long = counts.select("day", total.alias("total"), one.alias("s")).select("day", "total", "s.*")
    by = Window.partitionBy("day").orderBy(F.col("count").desc(), "position")  # three rows a day
    pie = F.when(F.col("count") > 0, F.row_number().over(by))
    return long.select("day", "sentiment", "count", percent(F.col("count"), F.col("total")).alias("share_pct"), pie.alias("pie_rank"))


def sources(scored: DataFrame) -> DataFrame:
    """Headlines by day and source, in all and by sentiment (order: total falling, then source)."""
    named = scored.withColumn("source", named_source(F.col("source")))
    counts = named.groupBy("day", "source").pivot("label", ["negative", "neutral", "positive"]).count().na.fill(0)
    return counts.withColumn("total", F.col("negative") + F.col("neutral") + F.col("positive"))


def top_source(scored: DataFrame) -> DataFrame:
    """Each day's largest source (ties: alphabetical), its count and share."""
    counts = scored.groupBy("day", "source").agg(F.count("*").alias("n"))
    best = counts.groupBy("day").agg(F.sum("n").alias("n_headlines"), F.min_by(F.struct("source", "n"), F.struct(-F.col("n"), F.col("source"))).alias("t"))
    return best.select("day", F.col("t.source").alias("source"), F.col("t.n").alias("n"), "n_headlines", percent(F.col("t.n"), F.col("n_headlines"), 0).cast("int").alias("share_pct"))


def previous_session(index: DataFrame, lookback: int = 5, min_headlines: int = 5) -> DataFrame:
    """Each day with the latest earlier day, at most ``lookback`` days back, that has a mood and enough headlines.

    An equi-join on the candidate days instead of a window over all days in one task.
    """
    ok = index.where((F.col("n_headlines") >= min_headlines) & F.col("mood_index").isNotNull())
    ok = ok.select("day", half_up(F.col("mood_index")).alias("prev_mood"), F.col("n_headlines").alias("prev_n"))
    back = F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("k")
    asked = index.select("day", back).withColumn("prev_day", F.date_sub("day", F.col("k")))
    found = asked.join(ok.withColumnRenamed("day", "prev_day"), "prev_day")
    latest = found.groupBy("day").agg(F.max(F.struct("prev_day", "prev_mood", "prev_n")).alias("p")).select("day", "p.*")
    return index.join(latest, "day", "left")


def change(mood: Column, previous: Column, least: float = 5) -> Column:
    """Displayed mood minus displayed previous mood as exact decimals; null below ``least``."""
    delta = (mood.cast("decimal(6,1)") - previous.cast("decimal(6,1)")).cast("double")
    return F.when(F.abs(delta) >= least, delta)


def background(days: DataFrame, rows: DataFrame, length: int = 30) -> DataFrame:
    """Pairs (target day, row) with the row's day in the ``length`` days before: an equi-join on spread-out days."""
    spread = days.select(F.col("day").alias("target"), F.explode(F.sequence(F.date_sub("day", length), F.date_sub("day", 1))).alias("day"))
    return rows.join(spread, "day")


def history_days(days: DataFrame, first_day: DataFrame) -> DataFrame:
    """Days between the first fetch and each day, 0 at least; ``first_day`` is one row."""
    return days.crossJoin(F.broadcast(first_day.limit(1))).withColumn("history_days", F.greatest(F.lit(0), F.datediff("day", "first_day")))
