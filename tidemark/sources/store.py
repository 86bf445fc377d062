"""The headline store: headlines by bucket of their id, a title index by bucket of the title key, the index by date.

A batch writes new versions of the buckets that it touches and of no others, as partitions (bucket,
version); a commit names the live version of every bucket, so a failed write leaves the old state and
a reader keeps its files until ``vacuum``. Which stored rows a batch meets is found in the buckets
of its ids and titles, so the work of a batch goes with the batch and not with the history. One
writer at a time; a batch that is taken again changes nothing. All paths go through Spark's
file systems.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import dedupe

BUCKETS = 64
TABLES = {"headlines": schema.HEADLINES, "titles": "title_norm string, id string"}


class Store:
    """``buckets`` holds for a new store; one that is there keeps its own number. Each should be a file of some 100 MB."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        layout = f"{self.path}/layout"
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("ignore").json(layout)
        self.buckets = spark.read.schema("buckets int").json(layout).first()["buckets"]

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        """Committed versions of a table, from its folder of commits."""
        fs, p = self._fs(f"{self.path}/{table}/commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = lambda name: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/commits/{name}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and whole(n))

    def _live(self, table: str) -> dict[int, int]:
        """The live version of each bucket: as many numbers as the store has buckets."""
        if not (found := self.versions(table)):
            return {}
        last = self.spark.read.schema("live array<struct<bucket: int, v: int>>").json(f"{self.path}/{table}/commits/v{found[-1]}")
        return {r["bucket"]: r["v"] for r in last.first()["live"]}

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows with their bucket, of all or some buckets: only the folders of live versions are listed."""
        live, base = self._live(table), f"{self.path}/{table}/data"
        paths = [f"{base}/bucket={b}/v={v}" for b, v in sorted(live.items()) if buckets is None or b in buckets]
        kind = f"{TABLES[table]}, bucket int, v int"
        rows = self.spark.read.schema(kind).option("basePath", base).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.drop("v")

    def _replace(self, rows: DataFrame, table: str, buckets: list[int]) -> None:
        """Commit new versions of ``buckets``, the buckets of the rows: a file each, more where one has outgrown it."""
        v, live = (self.versions(table) or [0])[-1] + 1, self._live(table)
        dealt = rows.withColumn("v", F.lit(v)).hint("rebalance", "bucket").sortWithinPartitions("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(f"{self.path}/{table}/data")
        state = [(sorted((live | dict.fromkeys(buckets, v)).items()),)]
        self.spark.createDataFrame(state, "live array<struct<bucket: int, v: int>>").coalesce(1).write.mode("error").json(f"{self.path}/{table}/commits/v{v}")

    def vacuum(self) -> None:
        """Delete the versions that are no longer live; for times without readers of older ones."""
        for table in TABLES:
            live, (fs, p) = self._live(table), self._fs(f"{self.path}/{table}/data")
            for folder in fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/bucket=*/v=*")) or []:
                b, v = (part.split("=")[1] for part in folder.getPath().toString().rsplit("/", 2)[1:])
                if live.get(int(b)) != int(v):
                    fs.delete(folder.getPath(), True)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _buckets(*keyed: DataFrame) -> list[int]:
        """The buckets that rows fall in: at most as many numbers as the store has buckets."""
        return sorted({r[0] for d in keyed for r in d.select("bucket").distinct().collect()})

    def _met(self, table: str, keyed: DataFrame, key: str) -> DataFrame:
        """Stored rows that share a key with ``keyed`` (key, bucket); where its buckets hold none yet, nothing is joined."""
        buckets = self._buckets(keyed)
        found = self._read(table, buckets)
        return found.join(keyed.select(key), key, "left_semi") if self._live(table).keys() & set(buckets) else found

    def headlines(self) -> DataFrame:
        return self._read("headlines").drop("bucket")

    def ingest(self, batch: DataFrame) -> dict[str, int]:
        """Upsert a batch (headline columns and seq) and return its account.

        Stored rows come first. A row enters unless one that has entered shares its id or title key; of
        a duplicate only an earlier published_at is kept, by the row that shares its title, else its id.
        """
        seen, came = Observation(), Observation()
        columns = [f.split()[0] for f in schema.HEADLINES.split(", ")]
        given = [F.col(c) if c in batch.columns else F.lit(None).alias(c) for c in columns]
        dedupe.shared_folder(self.spark)
        rows = batch.observe(seen, F.count("*").alias("n")).select(*given, "seq", self.bucket(F.col("id")).alias("bucket")).checkpoint()
        received = seen.get["n"]
        asked = rows.select("title_norm", self.bucket(F.col("title_norm")).alias("bucket"))
        owners = self._met("titles", asked, "title_norm").checkpoint()
        keys = rows.select("id", "bucket").union(owners.select("id", self.bucket(F.col("id"))))
        met = self._met("headlines", keys, "id").select("id", "title_norm", "published_at", "bucket").checkpoint()

        first = F.struct(F.lit(0).alias("s"), F.lit("").alias("a"), F.col("id").alias("b"))
        then = F.struct(F.lit(1).alias("s"), F.lpad(F.col("seq").cast("string"), 20, "0").alias("a"), F.col("id").alias("b"))
        both = met.select("id", "title_norm", "published_at", first.alias("seq")).unionByName(rows.select("id", "title_norm", "published_at", then.alias("seq")))
        shared = dedupe.shared(both)
        merged = dedupe.settled(dedupe.parted(both, *shared)[1]).checkpoint()
        entering = merged.where("seq.s = 1").select(F.col("seq").alias("_at"), F.col("published_at").alias("_published"))
        alone, together = dedupe.parted(rows, *shared)  # rows that share no key enter where they are
        new = together.withColumn("_at", then).join(entering, "_at").withColumn("published_at", F.col("_published")).select(*columns, "bucket")
        new = alone.select(*columns, "bucket").unionByName(new).observe(came, F.count("*").alias("n")).checkpoint()
        earlier = merged.where("seq.s = 0").select("id", F.col("published_at").alias("_published")).join(met.select("id", "published_at", "bucket"), "id")
        earlier = earlier.where("_published < published_at or published_at is null and _published is not null").select("id", "_published", "bucket").checkpoint()

        named = new.select("title_norm", "id", self.bucket(F.col("title_norm")).alias("bucket"))
        if name_buckets := self._buckets(named):  # first: a name without its row is no hit
            kept = self._read("titles", name_buckets).join(named.select("title_norm"), "title_norm", "left_anti")
            self._replace(kept.unionByName(named), "titles", name_buckets)
        if buckets := self._buckets(new, earlier):
            touched = self._read("headlines", buckets).join(earlier.drop("bucket"), "id", "left")
            touched = touched.withColumn("published_at", F.coalesce("_published", "published_at")).select(*columns, "bucket")
            self._replace(touched.unionByName(new), "headlines", buckets)
        inserted = came.get["n"]
        return {"received": received, "inserted": inserted, "duplicates": received - inserted}

    def write_scores(self, scores: DataFrame, scored_at: dt.datetime) -> int:
        """Fill scores once; returns how many rows got one. Only the buckets of scored rows are rewritten."""
        dedupe.shared_folder(self.spark)
        filled, given = Observation(), scores.withColumn("bucket", self.bucket(F.col("id"))).checkpoint()
        buckets = sorted(self._live("headlines").keys() & set(self._buckets(given)))
        if not buckets:
            return 0
        out = dedupe.fill_scores(self._read("headlines", buckets), given.drop("bucket"), scored_at, "_fresh").observe(filled, F.count_if("_fresh").alias("n"))
        self._replace(out.drop("_fresh"), "headlines", buckets)
        return filled.get["n"]

    def unscored(self) -> DataFrame:
        return self.headlines().where("label is null").select("id", "title").orderBy("id")

    def scored_between(self, start: dt.datetime, end: dt.datetime) -> DataFrame:
        """Dated, scored rows of a half-open range; filters and columns reach the scan."""
        at = F.col("published_at")
        return self.headlines().where((at >= F.lit(start)) & (at < F.lit(end)) & F.col("label").isNotNull())

    def recent_titles(self, now: dt.datetime, days: int) -> DataFrame:
        return self.headlines().where(F.col("published_at") >= F.lit(now - dt.timedelta(days=days))).select("id", "title")

    def freshness(self) -> DataFrame:
        """Newest item and fetch of each source."""
        return self.headlines().groupBy("source").agg(F.max("published_at").alias("newest_published_at"), F.max("fetched_at").alias("newest_fetched_at"))

    def fetch_span(self) -> DataFrame:
        return self.headlines().agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))

    def daily_index(self) -> DataFrame:
        fs, p = self._fs(f"{self.path}/daily_index")
        return self.spark.read.schema(schema.DAILY_INDEX).parquet(f"{self.path}/daily_index") if fs.exists(p) else self.spark.createDataFrame([], schema.DAILY_INDEX)

    def day(self, date: dt.date) -> DataFrame:
        """One day's row: a partition filter."""
        return self.daily_index().where(F.col("date") == F.lit(date))

    def write_days(self, days: DataFrame, model_id: str, computed_at: dt.datetime) -> None:
        """Replace the partitions of the given index rows (column ``day``) and no others."""
        rows = days.withColumnRenamed("day", "date").withColumns({"model_id": F.lit(model_id), "computed_at": F.lit(computed_at).cast("timestamp")})
        names = [f.split()[0] for f in ("mood_index n_headlines n_positive n_neutral n_negative mean_confidence n_low_conf n_sources source_counts model_id computed_at").split()]
        rows.select(*names, "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.path}/daily_index")

    def write_snapshot(self, terms: DataFrame) -> None:
        """Replace the snapshot rows of the given days."""
        terms.select("published_at", "id", "term", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.path}/terms")

    def snapshot(self) -> DataFrame:
        fs, p = self._fs(f"{self.path}/terms")
        return self.spark.read.schema(schema.SNAPSHOT_TERMS).parquet(f"{self.path}/terms") if fs.exists(p) else self.spark.createDataFrame([], schema.SNAPSHOT_TERMS)
