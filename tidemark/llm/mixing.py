"""Mixing sources to target weights by hash-random order and distributed prefix sums (DataFrame functions only).

Every document gets a pseudo-random key from its id. All planning is on one narrow written
table (id, source, size, key), for which texts are read once. Within a source the keys are
cut into ranges; token sums of the ranges give each range its offset (a window over at most
4096 rows a source), and a running sum inside the range gives each document its
position in the source's order. The source's budget is then cut exactly: whole epochs
first, then documents from the front of the order until the budget ends inside one.
A hot source is spread over its ranges, so no task holds a source.

The mix itself needs one row a source: its whole epochs and the place in its order where the
budget ends. Rows are compared with that place where they lie, so no text is shuffled.

Defined results: null texts have size 0, and long ones are counted whole; the null source is a
source of its own, last; a null id takes its key from the text; equal ids share a key and are
ordered by size; a source without words gets target 0; an empty table gives an empty result.
In ``mixture``, rows equal in source, id and size are taken or left together.
Columns that clash with the ones added (size, source_size, target, taken, copies) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, without, word_count, written

#: Hex digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3
WEIGHTS = (5, 2, 1)
ADDED = ("size", "source_size", "target", "taken", "copies")


def order_key(id_col: Column, text: Column, seed: str) -> Column:
    unnamed = F.concat(F.lit("null:"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), unnamed)).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> with target.

    Shares by weight, none above ``most`` times its source. Resharing the excess until none
    is above ends at one level L with target = min(most * size, L * weight): sources are
    taken by growing most * size / weight, and L is the first level that does not pass the
    source's own ratio. One row a source; no document is touched.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(down))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def _positions(narrow: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """The narrow rows (source, id, size, key) with their source's size and target, whole epochs, and ``rest``: the budget left at the row in the last epoch."""
    placed = narrow.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    plan = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "target")
    offsets = ranges.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(
        F.col("source").alias("o_source"), F.col("range").alias("o_range"), "range_before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = placed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("range_before") - F.col("inside")
    return rows.select("source", "id", "size", "key", *[F.col(c) for c in narrow.columns if c == "row"], "source_size", "target", epochs.alias("epochs"), rest.alias("rest"))


def _narrow(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *carry: Column) -> DataFrame:
    """The planning table, in as many files as its own size asks for (not as many as the texts had)."""
    return written(docs.select(
        F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"),
        order_key(F.col(id_col), F.col(text_col), seed).alias("key"), *carry,
    ).repartition("key"), "mix")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` without their text, with size, source_size, target, taken (words, repeats counted) and copies.

    A source ends inside the document where its budget ends. ``copies`` is the number of
    times the document appears, whole or in part.
    """
    kept = [c for c in without(docs, ADDED).columns if c != text_col]
    narrow = _narrow(docs, seed, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    rows = _positions(narrow, weights, share, most)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest")))
    return rows.select(
        "row.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("epochs") + F.when(part > 0, 1).otherwise(0)).cast("long").alias("copies"),
    )


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as it is taken; a source ends with the document that fills its budget."""
    rows = _positions(_narrow(docs, seed, id_col, text_col, source_col), weights, share, most)
    last = F.max(F.when((F.col("rest") > 0) & (F.col("size") > 0), F.struct("key", "id", "size")))
    plan = written(rows.groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("last")), "mix-plan")  # one row a source
    here = docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("r_source"), F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        order_key(F.col(id_col), F.col(text_col), seed).alias("key"),
    )
    joined = here.join(plan, F.col("r_source").eqNullSafe(F.col("source")))
    key, has_words = F.col("last.key"), F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    up_to_end = F.struct("id", word_count(F.col("text")).alias("size")) <= F.struct(F.col("last.id").alias("id"), F.col("last.size").alias("size"))
    taken = F.when(F.col("key") < key, has_words).when(F.col("key") == key, has_words & up_to_end).otherwise(False)
    copies = F.col("epochs") + F.when(taken, 1).otherwise(0)
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")
