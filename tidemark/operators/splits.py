"""Dataset administration: stratified splits, seeded samples and draws, hashes, nesting."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Split
from tidemark.functions.numbers import ratio
from tidemark.operators.dedupe import shared_folder


def order_hash(id_col: Column, seed: int) -> Column:
    """Hash that orders rows pseudo-randomly and alike on every engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256)


def unit(id_col: Column, seed: int) -> Column:
    """A pseudo-random number in [0, 1) from 52 bits of the hash."""
    return F.conv(F.substring(order_hash(id_col, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _rank_in_class(rows: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """Row number within the class in hash order, by ranges of the hash, so that a class is no single task's work."""
    h = rows.withColumn("_h", order_hash(F.col(id_col), seed)).withColumn("_r", F.substring("_h", 1, 2))
    sizes = h.groupBy(label, "_r").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a class
    sizes = sizes.select(F.col(label).alias("_l"), F.col("_r").alias("_rr"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(label, "_r").orderBy("_h", id_col)
    return (
        h.withColumn("_i", F.row_number().over(inside)).join(sizes, (F.col(label) == F.col("_l")) & (F.col("_r") == F.col("_rr")))
        .withColumn("_rank", F.col("_before") + F.col("_i")).drop("_h", "_r", "_l", "_rr", "_before", "_i")
    )


def stratified(rows: DataFrame, cfg: Split = Split(), id_col: str = "id", label: str = "label") -> DataFrame:
    """Adds ``split``: test is peeled off first, then validation from the rest, each a rounded share of every class."""
    ranked = _rank_in_class(rows, id_col, label, cfg.seed)
    sizes = rows.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    n_test = F.floor(F.col("_n") * cfg.test + 0.5)
    n_val = F.floor((F.col("_n") - n_test) * (cfg.val / (cfg.train + cfg.val)) + 0.5)
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.join(sizes, F.col(label) == F.col("_l")).withColumn("split", split).drop("_rank", "_l", "_n")


def sample(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows without replacement, in hash order (top-n by hash: no full sort)."""
    return rows.orderBy(order_hash(F.col(id_col), seed), id_col).limit(n)


def stratified_draw(rows: DataFrame, train: DataFrame, seed: int, id_col: str = "id", label: str = "label") -> DataFrame:
    """Adds y_pred: a label drawn with the shares that the labels have in ``train``."""
    counts = train.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    up = Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, 0)  # one row a class
    whole = Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = counts.select("_l", (F.sum("_n").over(up) / F.sum("_n").over(whole)).alias("_to"))
    table = cum.agg(F.array_sort(F.collect_list(F.struct("_to", "_l"))).alias("_cum"))
    drawn = rows.crossJoin(F.broadcast(table)).withColumn("_u", unit(F.col(id_col), seed))
    pick = F.element_at(F.filter("_cum", lambda c: c["_to"] > F.col("_u")), 1)["_l"]
    return drawn.withColumn("y_pred", pick).drop("_cum", "_u")


def set_hash(rows: DataFrame, text: str = "text") -> DataFrame:
    """SHA-256 of the sorted texts joined by line ends: the pin of an evaluation split.

    The published form of a pin: one hash over one string, so the split must fit a task. ``tree`` pins splits of any size.
    """
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("set_hash"), F.count("*").alias("n"))


def multiset_hash(rows: DataFrame, text: str = "text") -> DataFrame:
    """Order-independent hash of any number of texts: sums of digest parts, partially aggregated."""
    part = lambda i: F.sum(F.conv(F.substring(F.sha2(F.col(text), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)"))
    return rows.agg(F.sha2(F.concat_ws(":", *[part(i).cast("string") for i in range(5)]), 256).alias("set_hash"), F.count("*").alias("n"))


#: Rows that a leaf of a pin is to hold, and children of a node.
LEAF_ROWS, FAN = 256, 16
PIN = "path string, hash string, n long"


def entry(*columns: str) -> Column:
    """SHA-256 of a row: every value as its length in bytes and its text, null apart from any text."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)), 256)


def tree(rows: DataFrame, *columns: str, depth: int | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(path, hash, n): a hash tree over the rows, a pin for splits of any size. The root's path is empty.

    Leaves are ranges of row digests, named by their first hexadecimal digits, and there are enough of them that one holds about ``leaf_rows`` rows
    (equal rows are one entry with a count); a node hashes its FAN children. So no task sees a split, and a changed row is found by its leaf.
    """
    if depth is None:
        n, depth = rows.count(), 0
        while n > leaf_rows * FAN**depth:
            depth += 1
    joined = lambda key, value: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(":"), value))), "\n"), 256).alias("hash")
    entries = rows.groupBy(entry(*columns).alias("digest")).agg(F.count("*").alias("k"))
    level = entries.groupBy(F.substring("digest", 1, depth).alias("path")).agg(joined(F.col("digest"), F.col("k").cast("string")), F.sum("k").alias("n"))
    shared_folder(rows.sparkSession)
    level = out = level.checkpoint()
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("path", 1, d).alias("path")).agg(joined(F.col("path"), F.col("hash")), F.sum("n").alias("n"))
        out = out.unionByName(level)
    return out


def verify_tree(rows: DataFrame, pinned: DataFrame, *columns: str) -> None:
    """Stops where the rows are not those of a pin, and names the first leaf that differs."""
    depth = pinned.agg(F.max(F.length("path"))).first()[0]
    leaf = F.length("path") == (depth or 0)
    mine, theirs = (t.where(leaf).select("path", F.struct("hash", "n").alias(c)) for t, c in ((tree(rows, *columns, depth=depth or 0), "mine"), (pinned, "theirs")))
    odd = mine.join(theirs, "path", "full").where(~F.col("mine").eqNullSafe(F.col("theirs")))
    first = odd.agg(F.min(F.struct("path", F.coalesce("mine.n", F.lit(0)).alias("has"), F.coalesce("theirs.n", F.lit(0)).alias("had"))).alias("x"), F.count("*").alias("n")).first()
    if first["n"]:
        x = first["x"]
        raise ValueError(f"the split is not the pinned one: leaf {x['path']!r} has {x['has']} rows, pinned were {x['had']}; {first['n']} leaves differ")


def verify(rows: DataFrame, expected: str, text: str = "text") -> None:
    if (got := set_hash(rows, text).first()["set_hash"]) != expected:
        raise ValueError(f"the split's hash is {got}, not {expected}")


def nesting_violations(inner: DataFrame, outer: DataFrame, column: str = "text") -> DataFrame:
    """Rows of ``inner`` that ``outer`` lacks."""
    return inner.select(column).distinct().join(outer.select(column), column, "left_anti")


def same_ids(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that only one side has: (id, side)."""
    left = a.select(id_col).join(b.select(id_col), id_col, "left_anti").withColumn("side", F.lit("left"))
    return left.union(b.select(id_col).join(a.select(id_col), id_col, "left_anti").withColumn("side", F.lit("right")))


def nested(levels: list[tuple[str, DataFrame]], column: str = "text") -> DataFrame:
    """(inner, outer, value) of every value that a level has and the next one lacks, in order; levels go from the smallest to the largest."""
    out = None
    for i, ((inner, a), (outer, b)) in enumerate(zip(levels, levels[1:])):
        bad = nesting_violations(a, b, column).select(F.lit(i).alias("_i"), F.lit(inner).alias("inner"), F.lit(outer).alias("outer"), F.col(column).alias("value"))
        out = bad if out is None else out.unionByName(bad)
    if out is None:
        raise ValueError("nesting needs two levels")
    return out.orderBy("_i", "value").drop("_i")


def blind_export(headlines: DataFrame, n: int, seed: int, first_fetch) -> DataFrame:
    """A sample to label by hand, without the model's labels; refuses while a row of the pool is unscored."""
    pool = headlines.where(F.col("fetched_at") >= F.lit(first_fetch))
    if not pool.where("label is null").isEmpty():
        raise ValueError("the pool holds unscored headlines")
    if pool.count() < n:
        raise ValueError(f"the pool holds fewer than {n} headlines")
    return sample(pool, n, seed).select("id", "title", F.lit("").alias("label"), F.lit(False).alias("hard"))


def save_blind(export: DataFrame, path: str) -> None:
    """Write an export for labelling; one that holds labels already is never overwritten."""
    try:
        done = export.sparkSession.read.schema("label string").json(path).where("label <> ''").count()
    except AnalysisException:
        done = 0  # nothing there
    if done:
        raise ValueError(f"{path} holds {done} labels")
    export.coalesce(1).write.mode("overwrite").json(path)


def save_sample(rows: DataFrame, path: str, n: int, seed: int, id_col: str = "id") -> int:
    """Write a seeded sample as one file of JSON lines; returns how many rows it has."""
    picked = sample(rows, n, seed, id_col)
    picked.coalesce(1).write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(picked.schema).json(path).count()


def save(rows: DataFrame, path: str, cfg: Split = Split()) -> dict:
    """Write rows with ``split`` as JSON lines a split, and beside them, in the same file system, ratios, counts and the test split's pin, over all columns."""
    rows.write.mode("overwrite").partitionBy("split").json(f"{path}/rows")
    columns = sorted(c for c in rows.columns if c != "split")
    tree(rows.where("split = 'test'"), *columns).write.mode("overwrite").parquet(f"{path}/pin")
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    root = rows.sparkSession.read.schema(PIN).parquet(f"{path}/pin").where("path = ''").first()
    meta = {"train": cfg.train, "val": cfg.val, "test": cfg.test, "seed": cfg.seed, "counts": counts, "columns": columns, "test_root": root and root["hash"]}
    line = rows.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def read_meta(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(f"{path}/meta").first()["value"])
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} holds no splits: build them first") from e


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows written by ``save``; fails where the meta file is missing or the test split is not the one that was pinned."""
    meta = read_meta(spark, path)
    rows = spark.read.schema(f"{schema}, split string").json(f"{path}/rows")
    pinned = spark.read.schema(PIN).parquet(f"{path}/pin")
    if (root := pinned.where("path = ''").first()) and root["hash"] != meta["test_root"]:
        raise ValueError(f"the pin in {path} is not the one that its meta file names")
    verify_tree(rows.where("split = 'test'"), pinned, *meta["columns"])
    return rows


def build(rows: DataFrame, path: str, cfg: Split = Split(), n_sample: int = 100, id_col: str = "id", label: str = "label") -> dict:
    """Split rows, write the splits with their pin, and a sample of the test split beside them."""
    done = save(stratified(rows, cfg, id_col, label), path, cfg)
    again = load(rows.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
    save_sample(again.where("split = 'test'").drop("split"), f"{path}/sample", n_sample, cfg.seed, id_col)
    return done


def summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """(split, label, n, share) of each split's labels."""
    counts = rows.groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = counts.groupBy("split").agg(F.sum("n").alias("_all"))
    return counts.join(whole, "split").select("split", "label", "n", ratio(F.col("n"), F.col("_all")).alias("share"))
