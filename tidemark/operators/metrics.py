"""Classification metrics over (y_true, y_pred) rows, optionally by group columns.

Everything starts from the confusion counts, at most classes ** 2 rows a group, so
predictions are read and shuffled once, partially aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.dedupe import shared_folder
from tidemark.schema import LABELS

Z95 = 1.959963984540054


def _by(group: tuple[str, ...]) -> list[Column]:
    return [F.col(g) for g in group]


def confusion(pred: DataFrame, *group: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Rows true, columns predicted, every label present in fixed order."""
    counts = pred.groupBy(*group, "y_true").pivot("y_pred", list(labels)).count().na.fill(0)
    frame = counts.select(*group).distinct() if group else counts.sparkSession.range(1).select()
    every = frame.select(*group, F.explode(F.array(*map(F.lit, labels))).alias("y_true"))
    return every.join(counts, [*group, "y_true"], "left").na.fill(0)


def per_class(pred: DataFrame, *group: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """label, precision, recall, f1 (0 where undefined) and support."""
    counts = pred.groupBy(*group, "y_true", "y_pred").agg(F.count("*").alias("n"))
    of = F.explode(F.array(*map(F.lit, labels))).alias("label")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    true, said = F.col("y_true") == F.col("label"), F.col("y_pred") == F.col("label")
    each = counts.select("*", of).groupBy(*group, "label").agg(n(true & said).alias("hit"), n(said).alias("said"), n(true).alias("support"))
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    f1 = ratio(F.col("hit") * 2, F.col("said") + F.col("support"))
    return each.select(*group, "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def overall(pred: DataFrame, *group: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """accuracy, macro_f1, weighted_f1, recall by label and n. Empty input gives no row (use require_rows)."""
    c = per_class(pred, *group, labels=labels)
    total = F.sum("support")
    recall = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "recall"))))
    return c.groupBy(*group).agg(
        F.try_divide(F.sum(F.round(F.col("recall") * F.col("support"))), total.cast("double")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), total.cast("double")).alias("weighted_f1"),
        recall.alias("recall"), total.alias("n"),
    ).where("n > 0")


def require_rows(pred: DataFrame) -> DataFrame:
    if pred.isEmpty():
        raise ValueError("metrics need at least one prediction")
    return pred


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high) of the Wilson interval; null where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = hits.cast("double") / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct((centre - half).alias("low"), (centre + half).alias("high"))


def grouped_accuracy(pred: DataFrame, *columns: str) -> DataFrame:
    """Accuracy with Wilson bounds over all rows and by each column, as grouping sets (one pass)."""
    sets = [[], *([F.col(f"`{c}`")] for c in columns)]
    counts = (F.count_if(F.col("y_true") == F.col("y_pred")).alias("hits"), F.count("*").alias("n"))
    grouped = pred.groupingSets(sets, *[F.col(f"`{c}`") for c in columns]) if columns else pred.groupBy()
    rows = grouped.agg(*[F.grouping(f"`{c}`").alias(f"g_{c}") for c in columns], *counts)
    part = reduce(lambda a, c: F.when(F.col(f"g_{c}") == 0, F.lit(c)).otherwise(a), columns, F.lit("all"))
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")) for c in columns], F.lit("all"))
    w = wilson(F.col("hits"), F.col("n"))
    return rows.select(part.alias("part"), value.alias("value"), "hits", "n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), w["low"].alias("low"), w["high"].alias("high"))


def kappa(pred: DataFrame, *group: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Cohen's kappa of two label columns; null where agreement by chance is complete."""
    counts = pred.groupBy(*group, "y_true", "y_pred").agg(F.count("*").alias("n"))
    side = lambda c, label: F.sum(F.when(F.col(c) == label, F.col("n")).otherwise(0))
    chance = reduce(lambda a, b: a + b, [side("y_true", x).cast("double") * side("y_pred", x) for x in labels])
    agg = counts.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("same"), chance.alias("chance"))
    po, pe = F.col("same") / F.col("n").cast("double"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return agg.select(*group, "n", po.alias("po"), pe.alias("pe"), F.try_divide(po - pe, F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def class_weights(rows: DataFrame, label: str = "label", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """n / (classes * count); raises where a class has no rows."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    found = {r["label"]: r["n"] for r in counts.where(F.col("label").isin(*labels)).collect()}  # one row a class
    if missing := [x for x in labels if x not in found]:
        raise ValueError(f"no rows of {missing}")
    total = sum(found.values())
    return rows.sparkSession.createDataFrame([(x, total / (len(labels) * found[x])) for x in labels], "label string, weight double")


def distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share and the majority rate."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    both = counts.crossJoin(F.broadcast(total))
    return both.select("label", "n", ratio(F.col("n"), F.col("total")).alias("share"), ratio(F.col("most"), F.col("total")).alias("majority_rate"))


def sweep(scores: DataFrame, positives: list[float], negatives: list[float], labels: tuple[str, ...] = LABELS) -> DataFrame:
    """accuracy, macro_f1 and negative recall for every pair of cut-offs with positive >= negative.

    Scores are first counted by label and the cells between the sorted cut-offs (a few hundred
    rows whatever the input); the grid is applied to those cells.
    """
    spark = scores.sparkSession
    cuts = sorted({*positives, *negatives})
    lit = F.array(*map(F.lit, cuts))
    below = F.size(F.filter(lit, lambda c: c < F.col("score")))
    at = F.size(F.filter(lit, lambda c: c <= F.col("score")))
    cells = scores.groupBy("y_true", below.alias("below"), at.alias("at")).agg(F.count("*").alias("n"))
    place = {c: i for i, c in enumerate(cuts)}
    grid = spark.createDataFrame([(p, m, place[p], place[m]) for p in positives for m in negatives if p >= m], "pos_cut double, neg_cut double, pi int, ni int")
    said = F.when(F.col("at") > F.col("pi"), "positive").when(F.col("below") <= F.col("ni"), "negative").otherwise("neutral")
    pred = cells.crossJoin(F.broadcast(grid)).withColumn("y_pred", said)  # cells x grid, both of fixed size
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    t, s = F.col("y_true"), F.col("y_pred")
    f1 = [F.coalesce(F.try_divide(2 * n((t == x) & (s == x)), n(t == x) + n(s == x)), F.lit(0.0)) for x in labels]
    return pred.groupBy("pos_cut", "neg_cut").agg(
        F.try_divide(n(t == s), F.sum("n").cast("double")).alias("accuracy"), (reduce(lambda a, b: a + b, f1) / len(labels)).alias("macro_f1"),
        F.coalesce(F.try_divide(n((t == "negative") & (s == "negative")), n(t == "negative")), F.lit(0.0)).alias("negative_recall"),
    )


def best_of(swept: DataFrame, metric: str = "macro_f1", then: str = "accuracy") -> DataFrame:
    """The pairs with the best metric, all that match it to 12 digits: by ``then`` falling, smaller positive cut-off, larger negative one."""
    shown = F.round(metric, 12)
    both = swept.crossJoin(F.broadcast(swept.agg(F.max(shown).alias("_top"))))  # one row
    return both.where(shown == F.col("_top")).drop("_top").orderBy(F.round(then, 12).desc(), "pos_cut", F.desc("neg_cut"))


def clearing(swept: DataFrame, floor: float) -> DataFrame:
    """The pairs that are more accurate than a floor, such as the majority rate."""
    return swept.where(F.round("accuracy", 12) > round(floor, 12))


def beating(swept: DataFrame, pos_cut: float, neg_cut: float, metric: str = "macro_f1") -> DataFrame:
    """The pairs whose metric is over that of the configured pair, which has to be among those swept, with the ``gain``, best first."""
    own = swept.where((F.round("pos_cut", 9) == round(pos_cut, 9)) & (F.round("neg_cut", 9) == round(neg_cut, 9))).first()
    if own is None:
        raise ValueError(f"the pair ({pos_cut}, {neg_cut}) was not swept")
    gain = F.round(metric, 12) - round(own[metric], 12)
    return swept.withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), F.round("accuracy", 12).desc(), "pos_cut", F.desc("neg_cut"))


#: Ranges that a pass of ``at_ranks`` counts.
RANGES = 1024


def at_ranks(values: DataFrame, column: str, ranks: DataFrame, *group: str) -> DataFrame:
    """The ranks (group columns, name, rank from 0) with the value at each rank of its group's sorted column; nulls of the column aside.

    A pass counts the rows of RANGES equal ranges between the least and the largest value left and keeps the range that
    holds the rank, until that is one value. A pass sends RANGES rows a task and rank at most; values are never listed or sorted.
    """
    shared_folder(values.sparkSession)
    key = F.to_json(F.struct(*_by(group))) if group else F.lit("")
    rows = values.where(F.col(column).isNotNull()).select(key.alias("_g"), F.col(column).alias("_v"))
    ends = rows.groupBy("_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    left = ranks.withColumn("_g", key).withColumn("_left", F.col("rank")).join(ends, "_g").withColumn("_n", F.monotonically_increasing_id()).checkpoint()
    done = left.where("lo = hi")
    while not (left := left.where("lo < hi")).isEmpty():
        spread = F.col("hi").cast("double") - F.col("lo").cast("double")
        near = rows.join(left.select("_g", "_n", "_left", "lo", "hi"), "_g").where("_v between lo and hi")
        at = F.floor((F.col("_v").cast("double") - F.col("lo").cast("double")) / spread * RANGES)
        at = F.when(F.col("_v") == F.col("hi"), RANGES).when(F.col("_v") == F.col("lo"), -1).otherwise(F.least(F.lit(RANGES - 1), at))  # the ends are ranges of their own
        counts = near.groupBy("_n", at.alias("at")).agg(F.count("*").alias("k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_left").alias("_was"))
        before = F.coalesce(F.sum("k").over(Window.partitionBy("_n").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("b", before).where((F.col("b") <= F.col("_was")) & (F.col("_was") < F.col("b") + F.col("k")))
        left = left.drop("lo", "hi", "_left").join(held.select("_n", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("_was") - F.col("b")).alias("_left")), "_n").checkpoint()
        done = done.unionByName(left.where("lo = hi"))
    return done.select(*_by(group), "name", "rank", F.col("lo").alias("value"))


def percentiles(values: DataFrame, column: str, *group: str) -> DataFrame:
    """n, p50 and p95 (linear interpolation) and the largest value of a column; nulls aside, a group of nulls alone has no row."""
    counts = values.where(F.col(column).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.max(column).alias("most"))
    wanted = [(name, (F.col("n") - 1) * q) for name, q in (("p50", 0.5), ("p95", 0.95))]
    each = [F.struct(F.lit(f"{name}_{side}").alias("name"), step(at).cast("long").alias("rank")) for name, at in wanted for side, step in (("low", F.floor), ("high", F.ceil))]
    found = at_ranks(values, column, counts.select(*group, F.explode(F.array(*each)).alias("r")).select(*group, "r.*"), *group)
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value").cast("double"))).alias(name)
    ends = found.groupBy(*group).agg(*[pick(f"{name}_{side}") for name, _ in wanted for side in ("low", "high")])
    same = reduce(lambda a, b: a & b, [F.col(f"c.{g}").eqNullSafe(F.col(f"e.{g}")) for g in group], F.lit(True))
    both = counts.alias("c").join(ends.alias("e"), same)
    between = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at))).alias(name) for name, at in wanted]
    return both.select(*[F.col(f"c.{g}").alias(g) for g in group], "n", *between, "most")


def summary_table(results: list[tuple[str, DataFrame]]) -> DataFrame:
    """Metric rows of several methods in the order given."""
    out = None
    for i, (name, pred) in enumerate(results):
        row = overall(require_rows(pred)).select(F.lit(i).alias("position"), F.lit(name).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def nearest_rank(values: DataFrame, column: str, q: float = 0.95) -> DataFrame:
    """The value at 0-based position int(n * q) of the sorted column, and n; nulls aside, no row where there is nothing else."""
    n = values.agg(F.count(column).alias("n"))
    rank = n.where("n > 0").select(F.lit("q").alias("name"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).cast("long").alias("rank"))
    return at_ranks(values, column, rank).crossJoin(n).select("value", "n")  # one row each


def weighted_loss(batches: DataFrame, *group: str) -> DataFrame:
    """Row-weighted mean of batch losses (loss, rows) and rows a second where ``seconds`` is there."""
    speed = [F.try_divide(F.sum("rows").cast("double"), F.sum("seconds")).alias("rows_per_second")] if "seconds" in batches.columns else []
    return batches.groupBy(*group).agg(F.try_divide(F.sum(F.col("loss") * F.col("rows")), F.sum("rows").cast("double")).alias("loss"), *speed)


def disagreements(labels: DataFrame) -> DataFrame:
    """Rows where hand and model labels differ, by both labels, then confidence falling."""
    return labels.where("y_true <> y_pred").orderBy("y_true", "y_pred", F.col("confidence").desc())
