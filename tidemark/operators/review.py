"""Hand labels against a model's: keyed files, joins that check their ids, and the drift report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.splits import same_ids
from tidemark.schema import LABELS


def read_keyed(spark: SparkSession, path: str, schema: str, key: str = "id", label: str = "label", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """JSON lines with one row a key; a repeated key, a missing one or a label outside ``labels`` stops with the first of them."""
    rows = spark.read.schema(schema).json(path)
    odd = rows.where(F.col(key).isNull() | ~F.coalesce(F.col(label).isin(*labels), F.lit(False))).select(F.col(key).cast("string"), F.col(label).cast("string"))
    if (bad := odd.first()) is not None:
        raise ValueError(f"{path}: row {bad[0]!r} has the label {bad[1]!r}")
    if (twice := rows.groupBy(key).count().where("count > 1").first()) is not None:
        raise ValueError(f"{path}: {key} {twice[0]!r} occurs {twice[1]} times")
    return rows


def joined(hand: DataFrame, model: DataFrame) -> DataFrame:
    """(id, y_true, y_pred and the model's other columns): hand labels (id, label) with the model's for exactly the same ids, else an error."""
    if (odd := same_ids(hand, model).first()) is not None:
        raise ValueError(f"only the {'hand' if odd['side'] == 'left' else 'model'} labels hold {odd['id']!r}")
    return hand.select("id", F.col("label").alias("y_true")).join(model.withColumnRenamed("label", "y_pred"), "id")


def relabelled(hand: DataFrame, again: DataFrame) -> DataFrame:
    """(id, y_true, y_pred) of rows labelled twice by hand, first and second label; every second label must have a first."""
    if (odd := again.join(hand, "id", "left_anti").first()) is not None:
        raise ValueError(f"{odd['id']!r} was labelled again but never before")
    return hand.select("id", F.col("label").alias("y_true")).join(again.select("id", F.col("label").alias("y_pred")), "id")


def measures(pairs: DataFrame, part: str, *columns: str) -> DataFrame:
    """(part, value, measure, amount) of label pairs in long form: agreement with bounds by each column, kappa, F1 and recall by label."""
    pairs = pairs.cache()
    head = (F.lit(part).alias("part"),)
    by = metrics.grouped_accuracy(pairs, *columns)
    shares = by.select(*head, F.when(F.col("part") == "all", "all").otherwise(F.concat_ws("=", "part", "value")).alias("value"), "n", "accuracy", "low", "high")
    cohen = metrics.kappa(pairs).select(*head, F.lit("all").alias("value"), "kappa")
    each = metrics.per_class(pairs).select(*head, F.col("label").alias("value"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    macro = metrics.overall(pairs).select(*head, F.lit("all").alias("value"), "macro_f1", "weighted_f1")
    long = None
    for table in (shares.withColumn("n", F.col("n").cast("double")), cohen, each, macro):
        rows = table.unpivot(["part", "value"], table.columns[2:], "measure", "amount")
        long = rows if long is None else long.unionByName(rows)
    return long


def drift(hand: DataFrame, model: DataFrame, again: DataFrame | None = None, *columns: str) -> DataFrame:
    """The drift report's numbers: ``model`` against ``hand``, in all and by ``columns`` of the model's rows, and the labeller's agreement with themselves."""
    out = measures(joined(hand, model), "model", *columns)
    return out if again is None else out.unionByName(measures(relabelled(hand, again), "self"))
