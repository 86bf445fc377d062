"""Feed documents, JSON lines and delimited text as sources."""

from __future__ import annotations

import datetime as dt
import hashlib
import importlib
import io
import itertools
import json
import time
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.scalars import url_hash
from tidemark.functions.text import title_key
from tidemark.operators.dedupe import shared_folder

ITEM = "title string, link string, description string, summary string, pubDate string, published string, updated string"
FEED = "feed string, feed_ord int, item_ord int, " + ITEM


def published(text: Column) -> Column:
    """UTC instant of a feed date: with offset, with zone name, or without either (read as UTC); null where it is none."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z")]
    return F.coalesce(*tries, F.try_to_timestamp(bare))


def read_xml(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of RSS (``item``) or Atom (``entry``) documents."""
    return spark.read.format("xml").option("rowTag", tag).schema(ITEM).load(path)


def items_of(body: bytes) -> list[tuple]:
    """Items of one document, in order, for documents already fetched. Broken XML raises."""
    import xml.etree.ElementTree as ET

    name = lambda e: e.tag.rpartition("}")[2]
    out = []
    for e in ET.fromstring(body).iter():
        if name(e) in ("item", "entry"):
            part = {}
            for x in e:
                value = x.get("href") if name(x) == "link" and x.get("href") else "".join(x.itertext()).strip()
                part.setdefault(name(x), value)
            out.append(tuple(part.get(k) for k in ("title", "link", "description", "summary", "pubDate", "published", "updated")))
    return out


def headlines(items: DataFrame, fetched_at: dt.datetime, source: Column | None = None) -> DataFrame:
    """Valid items as headline rows; those without title, link or title key are left out."""
    title = F.coalesce(F.col("title"), F.lit(""))
    rows = items.withColumn("title_norm", title_key(title)).where((F.col("title_norm") != "") & (F.coalesce("link", F.lit("")) != ""))
    return rows.select(
        url_hash(F.col("link")).alias("id"), (source if source is not None else F.col("feed")).alias("source"), "title", "title_norm",
        F.coalesce("description", "summary", F.lit("")).alias("summary"), F.col("link").alias("url"),
        published(F.coalesce("pubDate", "published", "updated")).alias("published_at"), F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
        *[c for c in ("feed_ord", "item_ord") if c in items.columns],
    )


def fetch_url(url: str, user_agent: str, timeout: float) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as r:
        return r.read()


def fetch_all(
    spark: SparkSession, feeds: Sequence[tuple[str, str]], fetched_at: dt.datetime, fetch: Callable[[str, str, float], bytes] = fetch_url,
    sleep: Callable[[float], None] = time.sleep, user_agent: str = "tidemark", timeout: float = 15, delay: float = 2,
) -> tuple[DataFrame, DataFrame]:
    """(headlines with seq, feed status) of (name, url) feeds, in order; a feed's error is its own."""
    rows, status = [], []
    for i, (name, url) in enumerate(feeds):
        if i:
            sleep(delay)
        error, items = None, []
        try:
            items = items_of(fetch(url, user_agent, timeout))
            error = None if items else "no entries"
        except Exception as e:  # noqa: BLE001  whatever a feed does wrong is reported with it
            error = f"{type(e).__name__}: {e}"
        rows += [(name, i, j, *x) for j, x in enumerate(items)]
        status.append((name, len(items), error))
    found = headlines(spark.createDataFrame(rows, FEED), fetched_at)
    found = found.withColumn("seq", F.col("feed_ord").cast("long") * (1 << 32) + F.col("item_ord")).drop("feed_ord", "item_ord")
    return found, accounted(spark.createDataFrame(status, "name string, received long, error string"), found)


FEED_ROW = FEED + ", error string, received int"
#: Rows that a task holds before it gives them on; a feed is parsed as a whole.
HELD_ROWS = 2000


def feed_rows(name: str, order: int, load: Callable[[], bytes]) -> list[tuple]:
    """A feed's items, then its status (item_ord -1) with the error, if any, and the items received. Whatever a feed does wrong is its own."""
    error, items = None, []
    try:
        items = items_of(load())
        error = None if items else "no entries"
    except Exception as e:  # noqa: BLE001
        error = f"{type(e).__name__}: {e}"
    return [(name, order, j, *x, None, None) for j, x in enumerate(items)] + [(name, order, -1, *[None] * 7, error, len(items))]


def parse(bodies: DataFrame) -> DataFrame:
    """Items and status rows (FEED_ROW) of bodies (feed, feed_ord, body), a feed a row."""
    kinds = [f.split()[0] for f in FEED_ROW.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=kinds).astype({"received": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, order, body in zip(batch["feed"], batch["feed_ord"], batch["body"]):
                out += feed_rows(name, int(order), lambda: body or b"")  # noqa: B023
                if len(out) >= HELD_ROWS:
                    yield framed(out)
                    out = []
            yield framed(out)

    return bodies.select("feed", "feed_ord", F.col("body").cast("binary").alias("body")).mapInPandas(run, FEED_ROW)


def parted(rows: DataFrame, fetched_at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(headlines with seq, feed status) of items and status rows, which should be a table: both read it."""
    item = F.col("item_ord") >= 0
    found = headlines(rows.where(item), fetched_at)
    found = found.withColumn("seq", F.col("feed_ord").cast("long") * (1 << 32) + F.col("item_ord")).drop("feed_ord", "item_ord")
    return found, accounted(rows.where(~item).select(F.col("feed").alias("name"), F.col("received").cast("long").alias("received"), "error"), found)


class _Feed(InputPartition):
    def __init__(self, name: str, url: str, order: int):
        super().__init__(order)
        self.name, self.url, self.order = name, url, order


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.feeds = json.loads(options["feeds"])
        self.fetcher, self.agent, self.timeout = options.get("fetcher", f"{__name__}:fetch_url"), options.get("useragent", "tidemark"), float(options.get("timeout", 15))

    def partitions(self) -> list[InputPartition]:
        return [_Feed(name, url, i) for i, (name, url) in enumerate(self.feeds)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        yield from feed_rows(partition.name, partition.order, lambda: fetch(partition.url, self.agent, self.timeout))


class FeedSource(DataSource):
    """``spark.read.format("feeds")``: a partition a feed, so feeds are fetched side by side; FEED_ROW rows.

    Options: ``feeds`` (JSON list of name and address), ``fetcher`` (module:function of address, agent and timeout), ``useragent``, ``timeout``.
    """

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return FEED_ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, feeds: Sequence[tuple[str, str]], fetched_at: dt.datetime, fetcher: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``fetch_all`` by the feed source: every feed is fetched once, into a table that both results read."""
    shared_folder(spark)
    spark.dataSource.register(FeedSource)
    reader = spark.read.format("feeds").option("feeds", json.dumps([list(f) for f in feeds]))
    return parted((reader.option("fetcher", fetcher) if fetcher else reader).load().checkpoint(), fetched_at)


def accounted(received: DataFrame, found: DataFrame) -> DataFrame:
    """Feed status: (name, received, error) with the items that were skipped and the newest of the valid ones (undated ones aside)."""
    kept = found.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("kept"), F.max("published_at").alias("newest_published_at"))
    skipped = F.col("received") - F.coalesce("kept", F.lit(0))
    return received.join(kept, "name", "left").select("name", "received", skipped.alias("skipped"), "newest_published_at", "error")


def tallies(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if(F.col("error").isNull()).alias("live"), F.count("*").alias("feeds"), F.sum("received").alias("entries"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines from 1, of files of any size.

    Lines are counted by the blocks that a file is read in, sums over a file's blocks give each its first line number, and the number
    within a block is a line's place in its task.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.text(path).select("value", meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "_first", before.alias("_before"))  # a row a block
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def _record(lines: DataFrame, text: str) -> DataFrame:
    """Lines with their record (VARIANT), the text and why a line is no record."""
    parsed = lines.where(F.trim("value") != "").withColumn("record", F.try_parse_json("value"))
    got = F.try_variant_get(F.col("record"), f"$.{text}", "variant")
    kind = F.coalesce(F.schema_of_variant(got), F.lit(""))
    reason = F.when(F.col("record").isNull(), "not valid JSON").when(got.isNull(), f'missing "{text}" field').when(kind != "STRING", f'"{text}" is not a string')
    return parsed.withColumns({"reason": reason, text: F.try_variant_get(F.col("record"), f"$.{text}", "string")})


def read_jsonl(spark: SparkSession, path: str, text: str = "sentence") -> DataFrame:
    """Objects of JSON lines as (file, record) with record a VARIANT that keeps every key, and the text column.

    Blank lines are skipped; a line that is no object, or whose text is no string, stops the read with its file, line and reason.
    """
    found = _record(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), text)
    if not found.where("reason is not null").isEmpty():  # lines are numbered only to name the first bad one
        bad = _record(numbered_lines(spark, path), text).where("reason is not null").agg(F.min(F.struct("file", "line", "reason")).alias("x")).first()["x"]
        raise ValueError(f"bad record at {bad['file']}:{bad['line']}: {bad['reason']}")
    return found.select("file", "record", text)


def read_labelled_text(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", delimiter: str = "@") -> DataFrame:
    """(sentence, label) of lines ``sentence@label``: split at the last delimiter, blanks skipped, an error where there is none."""
    return split_labelled(spark.read.option("encoding", encoding).csv(path, sep="\x01", quote="", schema="value string"), delimiter)


def split_labelled(lines: DataFrame, delimiter: str = "@") -> DataFrame:
    """(sentence, label) of lines (value): split at the last delimiter, blanks skipped, an error where there is none."""
    lines = lines.where(F.trim("value") != "")
    pattern = f"^(.*){delimiter}([^{delimiter}]*)$"
    ok = F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no label in: "), F.col("value"))))
    part = lambda i: F.trim(F.regexp_extract(ok, pattern, i))
    return lines.select(part(1).alias("sentence"), part(2).alias("label"))


def archive_lines(spark: SparkSession, path: str, member: str, pinned: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(file, line, value) of a member of zip archives whose SHA-256 is pinned: another archive, or one without the member, stops before the first row.

    An archive is read by one task, as the format cannot be split; its member is decompressed line by line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                if (got := hashlib.sha256(content).hexdigest()) != pinned:
                    raise ValueError(f"{file} has the checksum {got}, not {pinned}")
                archive = zipfile.ZipFile(io.BytesIO(content))
                if member not in archive.namelist():
                    raise ValueError(f"{file} has no member {member}")
                with io.TextIOWrapper(archive.open(member), encoding) as lines:
                    for first in itertools.count(1, 10_000):
                        if not (some := [x.rstrip("\n") for x in itertools.islice(lines, 10_000)]):
                            break
                        yield pd.DataFrame({"file": file, "line": range(first, first + len(some)), "value": some})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line long, value string")


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_checksum(spark: SparkSession, path: str, pinned: str) -> None:
    """Stops where a file is not the one that was pinned."""
    for r in checksum(spark, path).collect():
        if r["sha256"] != pinned:
            raise ValueError(f"{r['path']} has the checksum {r['sha256']}, not {pinned}")
