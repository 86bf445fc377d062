"""The daily run: ingest, score, blocking gates, index, disclosure gates, themes, report."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import render
from tidemark.config import Settings
from tidemark.functions.calendar import civil_day, when_text
from tidemark.functions.numbers import half_up
from tidemark.functions.scalars import band
from tidemark.functions.text import TOKEN, stop_words
from tidemark.operators import classify, gates, index, report, themes
from tidemark.sources.store import Store


class Blocked(RuntimeError):
    """A blocking gate failed; nothing was indexed or reported."""


def request(text: str | None, today: dt.date) -> dt.date:
    """A requested date: strictly YYYY-MM-DD, real, not in the future; none is today."""
    if text is None:
        return today
    day = dt.date.fromisoformat(text)
    if day.isoformat() != text or day > today:
        raise ValueError(f"not a past date: {text}")
    return day


def _dated(store: Store, s: Settings) -> DataFrame:
    rows = store.headlines().where("published_at is not null")
    return rows.withColumn("day", civil_day(rows, "published_at", s.index.timezone))


def civil_today(now: dt.datetime, s: Settings = Settings()) -> dt.date:
    """The date of an instant (without a zone: UTC) in the index's zone."""
    return (now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)).astimezone(ZoneInfo(s.index.timezone)).date()


def gate_rows(store: Store, day: dt.date, today: dt.date, now: dt.datetime, feeds: list[tuple] | None, idx, s: Settings) -> tuple[list, str]:
    """The seven results and the quality document."""
    spark = store.spark
    last = store.fetch_span().first()["last"]
    unscored = _dated(store, s).where((F.col("day") == F.lit(day)) & F.col("label").isNull()).count()
    n = low = top = count = None
    if idx is not None:
        n, low = idx["n_headlines"], idx["n_low_conf"]
        top, count = min(idx["source_counts"].items(), key=lambda kv: (-kv[1], kv[0])) if n else (None, None)
    row = [(day, day == today, now, last, unscored, feeds, n, top, count, low)]
    results = gates.evaluate(spark.createDataFrame(row, gates.INPUTS), s.gates, s.explain)
    found = results.orderBy("position").collect()
    document = gates.documents(spark.createDataFrame(found, results.schema), F.lit(now.isoformat(timespec="microseconds"))).first()["document"]
    return found, gates.pretty(document)


def _index_days(store: Store, day: dt.date, today: dt.date, now: dt.datetime, s: Settings) -> None:
    """Compute the requested day (and yesterday, if it is today) and the days a lookback needs, then write those not frozen."""
    spark = store.spark
    rows = _dated(store, s).where("label is not null")
    first = day - dt.timedelta(days=s.lede.lookback_days)
    wanted = spark.createDataFrame([(first + dt.timedelta(days=i),) for i in range((day - first).days + 1)], "day date")
    stored = store.daily_index().withColumnRenamed("date", "day").drop("model_id", "computed_at")
    fresh = index.daily_index(rows.join(F.broadcast(wanted), "day", "left_semi"), s.index)
    frozen = index.freeze(wanted, stored, fresh, today, s.index)
    found = {r["day"]: r for r in frozen.select("day", "action", "n_headlines", "mood_index").collect()}
    asked = {day, day - dt.timedelta(days=1)} if day == today else {day}
    for k in range(1, s.lede.lookback_days + 1):  # older days are written only until one qualifies
        back = day - dt.timedelta(days=k)
        asked.add(back)
        r = found.get(back)
        if r and r["mood_index"] is not None and r["n_headlines"] >= s.lede.min_headlines:
            break
    days = [d for d in asked if d in found and found[d]["action"] in ("recomputed", "written")]
    if days:
        keep = F.col("day").isin(*days)
        terms = index.snapshot_terms(rows.where(keep))
        store.write_snapshot(terms)
        store.write_days(fresh.where(keep), s.model.id, now)


def _themes(store: Store, r: render.Report, rows: DataFrame, s: Settings) -> DataFrame | None:
    """The day's named clusters with what they moved, in order; sets the report's line on the fit."""
    spark, day, e = store.spark, r.date, s.explain
    stop = stop_words()
    near = _dated(store, s).where("label is not null").where(F.col("day").between(F.lit(day - dt.timedelta(days=e.background_days)), F.lit(day)))
    ours = rows.select("id", F.lit(True).alias("ours"))
    near = near.join(ours, "id", "left").where((F.col("day") < F.lit(day)) | F.col("ours"))
    docs = near.select(F.col("id").alias("doc_id"), F.col("title").alias("text"), "day", "ours")
    terms = themes.term_rows(docs, e.ngram_lo, e.ngram_hi, stop, TOKEN)
    if e.vocabulary:
        vocab = themes.load_vocabulary(spark, e.vocabulary)
        out = themes.oov(docs.where("ours"), vocab, TOKEN, stop).select("n_oov", "n_tokens", half_up(100 * F.coalesce("oov_rate", F.lit(0.0))).alias("pct"), "oov_rate").first()
        r.oov = (out["pct"], out["n_oov"] or 0, out["n_tokens"] or 0)
        r.extra["advise_window"] = (out["oov_rate"] or 0) > e.oov_warn
    else:
        vocab = themes.vocabulary(terms, docs.count(), e.min_df)
        span = docs.agg(F.min("day").alias("a"), F.count("*").alias("n")).first()
        r.fit = (span["n"], span["a"] or day, day)
    if r.n_headlines < e.min_headlines:
        return None
    tfidf = themes.transform(terms, vocab).cache()
    place = F.row_number().over(Window.partitionBy("day").orderBy(*report.canonical()))
    spot = rows.withColumn("day", F.lit(day)).select(F.col("day").alias("group"), F.col("id").alias("doc_id"), "label", index.term().alias("term_weight"), place.alias("position"))
    members = themes.clusters(tfidf.join(spot.select("doc_id", "group", "position"), "doc_id"), e).cache()
    stats = themes.cluster_stats(members, spot.drop("position"))
    first = members.join(spot.select("doc_id", "position"), "doc_id").groupBy("cluster").agg(F.min("position").alias("first"))
    opened = store.fetch_span().first()["first"]
    by_count = opened is None or (day - civil_today(opened, s)).days < e.background_days
    names = themes.names(tfidf, members, docs.where(F.col("day") < F.lit(day)).select("doc_id"), e, by_count)
    found = stats.join(names, "cluster", "left").join(first, "cluster").orderBy(F.abs("share_pct").desc(), F.col("size").desc(), "first")
    kept = spark.createDataFrame(found.collect(), found.schema)  # of one day, at most its headlines / min_cluster_size
    tfidf.unpersist()
    members.unpersist()
    return kept


def _explain(store: Store, r: render.Report, rows: DataFrame, prev, s: Settings) -> None:
    spark, day = store.spark, r.date
    found = _themes(store, r, rows, s)
    best = None
    if found is not None:
        r.clusters = [c.asDict() | {"name": c["name"] or []} for c in found.collect()]
        mood = spark.createDataFrame([(day, r.mood)], "group date, mood double")
        best = themes.driver(found, mood, s.explain, s.lede.flat).first()
    moved = prev["change"] if prev else None
    one = spark.createDataFrame([(day, r.mood, r.band, r.n_headlines, moved, prev["prev_day"] if prev else None, best["size"] if best else None, best["name"] if best else None)],
                                "day date, mood double, band string, n long, change double, prev date, k long, names array<string>")
    c = F.col
    text = themes.lede(c("day"), c("mood"), c("band"), c("n"), c("change"), when_text(c("prev"), c("day")), c("k"), themes.joined(c("names")), F.lit(found is not None))
    r.lede = one.select(text).first()[0]


def build(store: Store, day: dt.date, s: Settings = Settings()) -> render.Report:
    """The finished report of an indexed day."""
    idx = store.day(day).first()
    empty = render.Report(day, None, None, 0, 0, 0, [], [], [], [], s.model.id)
    if idx is None:
        return empty
    rows = _dated(store, s).where((F.col("day") == F.lit(day)) & F.col("label").isNotNull())
    held = store.snapshot().where(F.col("date") == F.lit(day))
    n_late = index.late(rows, held).count()
    counted = index.counted(rows, held)
    totals = {x["label"]: x["count"] for x in counted.groupBy("label").count().collect()}
    if tuple(totals.get(k, 0) for k in ("positive", "neutral", "negative")) != (idx["n_positive"], idx["n_neutral"], idx["n_negative"]):
        raise ValueError(f"labels of {day} no longer recount to its stored index")
    lines = report.finished(counted, s.index).withColumn("rank", report.rank_of(F.col("label")))
    headlines = [x.asDict() for x in lines.orderBy("rank", *report.canonical()).collect()]
    slices = {x["sentiment"]: x.asDict() for x in report.slices(counted).collect()}
    sources = [x.asDict() for x in report.sources(counted).orderBy(F.col("total").desc(), "source").collect()]
    top = [(n, getattr(s.report, n), [h for h in headlines if h["label"] == n][: getattr(s.report, n)]) for n in report.ORDER]
    shown = store.spark.createDataFrame([(idx["mood_index"],)], "m double").select(half_up(F.col("m")).alias("m")).select("m", band(F.col("m"), s.lede)).first()
    out = render.Report(day, shown[0], shown[1], idx["n_headlines"], len(sources), idx["n_low_conf"], headlines, [slices[n] for n in report.ORDER], top, sources, idx["model_id"], n_late)
    out.extra["min_headlines"] = s.explain.min_headlines
    near = store.daily_index().withColumnRenamed("date", "day").where(F.col("day").between(F.lit(day - dt.timedelta(days=s.lede.lookback_days)), F.lit(day)))
    prev = report.previous_session(near, s.lede.lookback_days, s.lede.min_headlines).where(F.col("day") == F.lit(day))
    prev = prev.select("prev_day", report.change(half_up(F.col("mood_index")), F.col("prev_mood"), s.lede.change_min_delta).alias("change")).first()
    _explain(store, out, counted, prev if prev and prev["prev_day"] else None, s)
    return out


def run(
    store: Store, day: dt.date, now: dt.datetime, today: dt.date, load: Callable, out_dir: str, batch: DataFrame | None = None,
    feeds: list[tuple] | None = None, s: Settings = Settings(),
) -> str:
    """One daily run; returns the report's path. ``feeds`` are (name, responded, newest_published_at)."""
    if batch is not None:
        store.ingest(batch)
    store.write_scores(classify.score_unscored(store.headlines(), load, s.model.batch_size), now)
    quality = f"{out_dir}/quality/{day.isoformat()}.json"
    found, document = gate_rows(store, day, today, now, feeds, None, s)
    if reasons := [f"{g['gate']}: {g['reason']}" for g in found if g["reason"]]:
        render.write_atomic(quality, document)
        raise Blocked("; ".join(reasons))
    _index_days(store, day, today, now, s)
    second, document = gate_rows(store, day, today, now, feeds, store.day(day).first(), s)
    render.write_atomic(quality, document)
    r = build(store, day, s)
    block = [g for g in second if g["kind"] == "block"]
    notes = [(g["gate"], json.loads(g["observed"]) | {"hours": s.gates.staleness_hours}) for g in sorted(second, key=lambda g: g["position"]) if g["status"] == "fired"]
    r.gates = {
        "n_passed": sum(g["status"] == "pass" for g in block), "n_applicable": sum(g["status"] != "not_applicable" for g in block),
        "n_not_applicable": sum(g["status"] == "not_applicable" for g in block), "notes": notes,
    }
    path = f"{out_dir}/{day.isoformat()}.md"
    render.write_atomic(path, render.markdown(r))
    return path
