"""Sharding by extendible hashing (DataFrame functions only).

A document's address is 60 hash bits. The directory starts as one bucket; a bucket over
the byte limit splits on its next bit, others stay as they are. Cells of ``depth`` bits are
summed first (partial aggregation, one row a cell), every split decision is made on those
sums, and only documents of cells that are still over the limit are looked at again, with
more bits. No document is moved to decide.

Defined results: a null text has 0 bytes; rows equal in id and text share an address and
cannot be parted, so their bucket, like that of one document over the limit, may exceed
it and is marked ``oversize``; a null id is an id of its own; an empty table has no shards.
Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

BITS = 60
#: Bits by which a round looks past the level where buckets would fit on average.
AHEAD = 3
SHARD_BYTES = 8 << 20


def address(id_col: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: str, depth: int) -> Column:
    return F.floor(F.col(h) / F.lit(1 << (BITS - depth))).cast("long") if depth < 8 else F.call_function("shiftright", F.col(h), F.lit(BITS - depth))


def _round(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Directory of one round: (cell -> leaf of depth low..high) and the cells still over the limit."""
    cells = rows.groupBy(_prefix("h", high).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1")
    )
    up = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    levels = cells.select("cell", "bytes", "h0", "h1", up).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    nodes = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
    # the bucket of a cell: its first level that fits, or that no bit can part
    fits = nodes.where((F.col("bytes") <= limit) | (F.col("h0") == F.col("h1")))
    near = levels.select("cell", "depth", "prefix").join(fits.select("depth", "prefix", F.col("bytes").alias("shard_bytes")), ["depth", "prefix"])
    leaf = near.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
    placed = written(cells.select("cell").join(leaf, "cell", "left"), "directory")
    return placed.where("leaf is not null"), placed.where("leaf is null").select("cell")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bytes, shard (its bits, '' for one bucket), depth, shard_bytes, oversize: one row for each row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"),
        address(F.col(id_col), F.col(text_col)).alias("h"),
    )
    rows = written(rows, "addresses")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(total, 1) / limit))) + AHEAD) if total > limit else 1
    out = None
    while True:
        placed, open_ = _round(rows, low, high, limit)
        at = rows.withColumn("cell", _prefix("h", high))
        found = at.join(placed, "cell").select(
            "doc_id", "bytes", F.expr("right(lpad(bin(leaf.prefix), 64, '0'), leaf.depth)").alias("shard"),
            F.col("leaf.depth").cast("int").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"),
        )
        found = found.withColumn("oversize", F.col("shard_bytes") > limit)
        out = found if out is None else out.unionByName(found)
        if high == BITS or open_.isEmpty():
            return out
        rows = written(at.join(open_, "cell").drop("cell"), "addresses")
        low, high = high + 1, min(BITS, high + 8)
