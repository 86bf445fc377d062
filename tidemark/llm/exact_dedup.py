"""Exact duplicates through a log-structured merge index of text digests (DataFrame functions only).

* flush: each task is a memtable; it leaves one sorted run of (digest, id) in level 0.
* compact: runs merge into one run of the next level that replaces them: one entry a digest
  with the identifier that stays (the smallest under the chosen order) and the number of rows.
  Runs from level 1 on are in buckets of their digests, sorted within, so they merge bucket by bucket
  where they lie and only entries of level 0 are shuffled, partially aggregated (a hot digest sends
  one row a task). By tiers, a level is merged once it holds ``fan`` runs and no other is touched. A
  manifest names the live runs; replaced runs stay readable until ``vacuum``.
* lookup: a batch is screened by the runs' filters, joined with the live runs, and every hit is
  compared byte for byte with the text of the identifier that stays. A run's bit filter (see
  idfilter; none for a run too large for one) is made and kept beside it when a batch first asks.
* groups: the same for one table. A bit filter of the digests that occur more than once selects
  the rows whose bytes are compared; only those texts are shuffled, and grouping by digest
  *and text* compares them byte for byte.

Texts are equal when identical after lower-casing A-Z; null counts as empty, and long texts
are compared whole. Ties: rows with the same id and text are one document and share
``kept``; a null id ranks below every other one. Empty tables give empty results; other
columns are not read, and none is added to the rows of ``survivors``.
"""

from __future__ import annotations

import json
import string
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import idfilter
from tidemark.llm.common import hot_join, scratch, written


def normalised(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


ENTRY = "digest string, doc_id long, n long"


class DigestIndex:
    """Sorted runs by level under one folder of the shared store, and the manifest of the live ones."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", digest: Callable[[Column], Column] = sha256, buckets: int | None = None):
        self.spark, self.digest, self.keep = spark, digest, keep
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))  # of new runs, the number that their shuffle has
        self.stays = F.min if keep == "smallest" else F.max
        self.path = path or scratch(spark, "digests")

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema("version long, runs array<struct<name: string, level: int, rows: long, buckets: int>>").json(f"{self.path}/manifest/v*")

    def live(self) -> list[dict]:
        """Name, level and rows of the runs that hold the index: a few names, whatever the number of documents."""
        try:
            last = self._manifest().orderBy(F.desc("version")).first()
        except AnalysisException:  # no manifest yet
            return []
        return [r.asDict() for r in last.runs] if last else []

    def _publish(self, runs: list[dict]) -> None:
        """The next version; of two writers that make the same one, the second stops."""
        try:
            version = self._manifest().agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            version = 0
        line = json.dumps({"version": version + 1, "runs": runs})
        self.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("error").text(f"{self.path}/manifest/v{version + 1}")

    def _write(self, entries: DataFrame, level: int) -> dict:
        """A new run: sorted files as the tasks left them in level 0, sorted buckets above."""
        name, seen = f"level{level}-{uuid.uuid4().hex[:12]}", Observation()
        out = entries.select("digest", "doc_id", "n").observe(seen, F.count("*").alias("rows"))
        if level == 0:
            out.sortWithinPartitions("digest", "doc_id").write.parquet(f"{self.path}/{name}/entries")
        else:
            table = f"tidemark_{uuid.uuid4().hex}"
            out.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{name}/entries").saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")  # its files stay
        return {"name": name, "level": level, "rows": seen.get["rows"], "buckets": self.buckets if level else 0}

    def _entries(self, run: dict) -> DataFrame:
        if not run["buckets"]:
            return self.spark.read.schema(ENTRY).parquet(f"{self.path}/{run['name']}/entries")
        table = f"tidemark_{uuid.uuid4().hex}"  # a name for as long as the plan is made: it carries the buckets
        self.spark.sql(f"CREATE TABLE {table} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/{run['name']}/entries'")
        found = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def _screened(self, keys: DataFrame, run: dict) -> DataFrame:
        """The digests that may be in a run, by its filter."""
        if (size := idfilter.bits(run["rows"])) is None:
            return keys
        path, kind = f"{self.path}/{run['name']}/filter", "slot int, bitmap binary"
        try:
            held = self.spark.read.schema(kind).parquet(path)
        except AnalysisException:  # the first batch that asks
            idfilter.build(self._entries(run), "digest", size).write.mode("ignore").parquet(path)
            held = self.spark.read.schema(kind).parquet(path)
        return idfilter.screened(keys, F.col("digest"), held, size)

    def entries(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
        return rows.withColumn("digest", self.digest(F.col("norm")))

    def flush(self, docs: DataFrame, **cols: str) -> DataFrame:
        """Add the rows of a batch as sorted runs of level 0, one a task, and return them (digest, doc_id, n = 1)."""
        run = self._write(self.entries(docs, **cols).withColumn("n", F.lit(1).cast("long")), 0)
        self._publish([*self.live(), run])
        return self._entries(run)

    def runs(self) -> DataFrame:
        """The entries of all live runs."""
        found = [self._entries(r) for r in self.live()]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], ENTRY)

    def _merged(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(self.stays("doc_id").alias("doc_id"), F.sum("n").alias("n"))

    def _merge(self, runs: list[dict], level: int) -> dict:
        """Write the merge of runs: those of level 0 are brought into buckets first, the others are there."""
        flat, sorted_ = ([self._entries(r) for r in runs if bool(r["buckets"]) == b] for b in (False, True))
        parts = ([self._merged(reduce(DataFrame.unionByName, flat))] if flat else []) + sorted_
        return self._write(self._merged(reduce(DataFrame.unionByName, parts)) if len(parts) > 1 else parts[0], level)

    def compact(self, fan: int | None = None) -> DataFrame:
        """Merge the live runs into one that replaces them, or with ``fan`` by tiers; returns what is live then (digest, keep_id, n).

        By tiers, the runs of level 0 become one of level 1, and ``fan`` runs of a level one of the next; runs of other levels stay as they are.
        """
        live = self.live()
        if fan is None:
            if len(live) != 1 or live[0]["level"] == 0:
                live = [self._merge(live, 1 + max((r["level"] for r in live), default=0))] if live else []
                self._publish(live)
        else:
            level = 0
            while level <= max((r["level"] for r in live), default=-1):
                here = [r for r in live if r["level"] == level]
                if here and (level == 0 or len(here) >= fan):
                    live = [r for r in live if r["level"] != level] + [self._merge(here, level + 1)]
                    self._publish(live)
                level += 1
        return self.runs().withColumnRenamed("doc_id", "keep_id")

    def vacuum(self) -> None:
        """Delete the runs that the manifest no longer names; for times without readers of older versions."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = {r["name"] for r in self.live()} | {"manifest"}
        for status in store.listStatus(folder):
            if status.getPath().getName() not in names:
                store.delete(status.getPath(), True)

    def lookup(self, docs: DataFrame, store: DataFrame, **cols: str) -> DataFrame:
        """doc_id and keep_id of the rows of a later batch whose text the index holds.

        ``store`` has the indexed documents under the same column names; only the texts of hits are read from it.
        """
        batch = written(self.entries(docs, **cols), "batch")
        found = []
        for run in self.live():
            keys = self._screened(batch.select("digest").distinct(), run)
            found.append(self._entries(run).join(keys.select("digest"), "digest", "left_semi"))
        if not found:
            return batch.select("doc_id", F.col("doc_id").alias("keep_id")).limit(0)
        hits = written(self._merged(reduce(DataFrame.unionByName, found)).select("digest", F.col("doc_id").alias("keep_id")), "hits")
        asked = batch.join(hits, "digest").groupBy("digest", "norm").agg(F.first("keep_id").alias("keep_id"))  # a hot text is compared once
        ids = written(hits.select("keep_id").distinct(), "hit-ids")
        held = idfilter.semi(store, F.col(cols.get("id_col", "doc_id")).cast("long"), ids, "keep_id")
        held = written(self.entries(held, **cols).withColumnRenamed("doc_id", "keep_id"), "held")
        equal = written(asked.join(held.select("keep_id", "norm").distinct(), ["keep_id", "norm"]), "verified")
        other = written(asked.select("digest", "norm").join(equal, ["digest", "norm"], "left_anti"), "collided")
        if not other.isEmpty():  # another text has the digest: compared with all texts that have it
            rest = self.entries(store, **cols).join(other.select("digest").distinct(), "digest", "left_semi")
            rest = rest.groupBy("digest", "norm").agg(self.stays("doc_id").alias("keep_id")).join(other, ["digest", "norm"], "left_semi")
            equal = equal.select("digest", "norm", "keep_id").unionByName(rest)
        return batch.join(equal.select("digest", "norm", "keep_id"), ["digest", "norm"]).select("doc_id", "keep_id")


def groups(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = sha256, **cols: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    index = DigestIndex(docs.sparkSession, keep=keep, digest=digest)
    rows = index.flush(docs, **cols).select("digest", "doc_id")
    merged = index.compact().select("digest", "n")
    hits = written(merged.where("n > 1").select("digest"), "hits")
    suspects = idfilter.flagged(index.entries(docs, **cols), F.col("digest"), hits, "digest").where("maybe").select("row.*")
    equal = suspects.groupBy("digest", "norm").agg(index.stays("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_digest = written(
        equal.groupBy("digest").agg(
            F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ).where("texts > 1 or group_size > 1"),
        "verified",
    )
    one = by_digest.where("texts = 1").drop("texts")
    out = hot_join(rows, one, "digest", merged)
    split = by_digest.where("texts > 1")
    if not split.isEmpty():  # different texts under one digest: told apart by their bytes
        split = split.select("digest")
        apart = suspects.join(split, "digest", "left_semi").join(equal, ["digest", "norm"])
        out = out.join(split, "digest", "left_anti").unionByName(apart.select("digest", "doc_id", "keep_id", "group_size"))
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", "digest", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
    )


def survivors(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, columns unchanged.

    Rows whose id is clear of the filter are neither hashed again nor shuffled. Of repeated rows (equal id and
    text) one stays.
    """
    found = groups(docs, keep, id_col=id_col, text_col=text_col).where("group_size > 1")
    several = found.groupBy("doc_id", "digest").agg(F.first("kept").alias("stays"), F.count("*").alias("rows"))
    several = written(several.where("not stays or rows > 1").select(F.struct("doc_id", "digest").alias("name"), "stays", "doc_id"), "dropped")
    marked = idfilter.flagged(docs, F.col(id_col).cast("long"), several, "doc_id")
    name = F.struct(F.col("key").alias("doc_id"), sha256(normalised(F.col("row")[text_col])).alias("digest"))
    rest = marked.where("maybe").select("row", name.alias("name"))
    rest = rest.join(several.select(F.col("name").alias("dropped"), "stays"), F.col("name").eqNullSafe(F.col("dropped")), "left")
    once = rest.where("stays").dropDuplicates(["name"])
    return marked.where("not maybe").select("row.*").unionByName(rest.where("stays is null").select("row.*")).unionByName(once.select("row.*"))
