"""Shared helpers: table access, scratch tables on the shared folder, word classes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset,
    a session of one machine (master ``local[..]``, as in tests) gets a temporary one; on a
    cluster there is no folder that all executors share, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later result reads: all that was made of them is written itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key is hot where it has over one row in so many; there are at most so many hot keys, whatever the input.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, how: str = "left") -> DataFrame:
    """rows left (or inner) joined with ``side``, which has at most one row a key, without sending a hot key's rows to one task.

    ``counts`` is (key, n): the rows of each key of ``rows``, a written table. Rows of hot keys
    stay where they are (at most HOT_SHARE rows of ``side`` are broadcast); others are joined by key.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * HOT_SHARE > total).select(key)
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    parted = marked.where("is_hot").drop("is_hot").join(F.broadcast(side.join(F.broadcast(hot), key, "left_semi")), key, how)
    return marked.where("is_hot is null").drop("is_hot").join(side, key, how).unionByName(parted)


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns whose names an operator is about to add (names match as Spark matches them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def lean(step: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """A batch function that, at the end of its task, calls ``forget`` (which empties caches) and returns freed memory to the system.

    Idle Python workers then leave an executor's memory to the stages that follow.
    """

    @functools.wraps(step)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            if forget:
                forget()
            trim()

    return run


def settle(spark: SparkSession) -> None:
    """Between the stages of a long session: the JVMs of driver and executors collect their garbage and return free heap.

    Without it a heap that one stage has filled stays as large beside the Python workers of the next.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.sparkContext._jvm.System.gc()
    spark.range(0, 2 * cores, 1, 2 * cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: What a task is to read of a shuffle, and what the planner may broadcast by its own estimate, at most.
TASK_BYTES, GUESSED_BYTES = 16 << 20, 1 << 20


@contextlib.contextmanager
def bounded_tasks(spark: SparkSession, partitions: int = 1) -> Iterator[None]:
    """Steps that run inside have small tasks, however large the session lets them grow, and at least so many partitions a shuffle.

    A task's hash tables and sorts take many times its compressed share of a shuffle. Sides are broadcast by hint, or where they are small for sure:
    an estimate from file sizes knows nothing of exploded lists. The session's settings come back in the end.
    """
    most = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.autoBroadcastJoinThreshold": GUESSED_BYTES}
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {k: spark.conf.get(k) for k in [*most, "spark.sql.shuffle.partitions"]}
    now = {k: str(v) for k, v in most.items() if not before[k].startswith("-") and size(before[k]) > v}
    if partitions > int(before["spark.sql.shuffle.partitions"]):
        now["spark.sql.shuffle.partitions"] = str(partitions)
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k in now:
            spark.conf.set(k, before[k])


def trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass
