"""Scalar expressions over headlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import Lede


def sign(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "negative", -1).otherwise(0)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def linkable(url: Column) -> Column:
    """http or https with a host (parse_url gives null on spaces, so a pattern is used)."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def named_source(source: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("unknown"))


def threshold_label(score: Column, positive: float = 0.05, negative: float = -0.05) -> Column:
    return F.when(score >= positive, "positive").when(score <= negative, "negative").otherwise("neutral")


def band(mood: Column, cfg: Lede = Lede()) -> Column:
    """Band of a displayed mood; upper bounds are exclusive, null stays null."""
    size = F.abs(mood)
    side = F.when(mood > 0, "positive").otherwise("negative")
    name = F.when(size < cfg.mild, "mildly").when(size < cfg.moderate, "moderately").otherwise("strongly")
    return F.when(mood.isNull(), None).when(size < cfg.flat, "roughly flat").otherwise(F.concat_ws(" ", name, side))


def digest_pick(day: Column, slot: int, n: int) -> Column:
    """Variant of a date: byte ``slot`` of the date's SHA-256, modulo n."""
    byte = F.conv(F.substring(F.sha2(F.date_format(day, "yyyy-MM-dd"), 256), 2 * slot + 1, 2), 16, 10)
    return (byte.cast("int") % n).cast("int")


def stale(ts: Column, now: Column, hours: float) -> Column:
    """At least so many hours old (0 hours is always stale)."""
    return ts <= now - F.make_dt_interval(secs=F.lit(hours * 3600))


def softmax_label(logits: Column, labels: Column) -> Column:
    """struct(label, confidence) of parallel arrays; the label is the checkpoint's own, ties take the first."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.struct(F.element_at(labels, F.array_position(logits, top).cast("int")).alias("label"), (F.lit(1.0) / total).alias("confidence"))


def utc_text(ts: Column) -> Column:
    """Fixed-width ISO-8601 text in UTC, for exports (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def markdown(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), r"([\\`*_\[\]<>|~#])", r"\\$1")


def markdown_url(url: Column) -> Column:
    return F.regexp_replace(url, r"([\\<>|])", r"\\$1")
