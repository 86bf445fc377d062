"""Exact complete linkage of the rows of many groups by cosine distance.

* Two rows nearer than the cut share one of their rarest terms: with a row's terms from rare to common, the
  terms after its prefix have a norm under 1 - cut and cannot bring a pair over it alone. Rows that share a
  prefix term (in a group of at most BLOCK rows: all rows) are compared in blocks of BLOCK rows, a block (or pair of blocks) at a time, and leave a
  spanning forest of the pairs nearer than the cut: at most a link a row, never the pairs.
* The distance of clusters is that of their farthest rows, so no cluster reaches over two components of those
  links. Each component is linked alone, by the same algorithm whatever its size.

A component is one task's work, as linkage is sequential; everything before it is spread whatever the size of a
group. Cosines count to DIGITS digits, so results do not depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.dedupe import shared_folder, written

#: Digits of a cosine that count, rows of a block, terms of a block at once, bytes of distance rows that a component keeps.
DIGITS, BLOCK, TERMS, KEPT_BYTES = 12, 512, 4096, 128 << 20


def complete_linkage(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Cluster (its lowest row) of each of n sparse unit rows: the closest clusters merge while they are nearer than the threshold, ties take the lowest rows.

    The distance of clusters is that of their farthest rows; cosines count to 12 digits. There is no distance matrix: memory is the
    entries and KEPT_BYTES. Equal rows are one from the start (they merge first). Distances between clusters only grow, so a nearest
    neighbour of before is a lower bound: it is looked up again when it leads the list and a side has changed. Distance
    rows come from the terms' postings; those of the largest clusters are kept.
    """
    order = np.lexsort((col, row))
    once = np.append((np.diff(row[order]) != 0) | (np.diff(col[order]) != 0), True)[: len(order)]  # a repeated entry counts once
    order = order[once]
    row, col, value = row[order], col[order], value[order].astype(float)
    ends = np.searchsorted(row, np.arange(n + 1))
    first: dict[bytes, int] = {}
    same = np.empty(n, int)
    for i in range(n):
        a, b = ends[i], ends[i + 1]
        same[i] = first.setdefault(col[a:b].tobytes() + np.round(value[a:b], 12).tobytes(), i)
    kept = np.flatnonzero(same == np.arange(n))  # from here on rows are places in kept
    m = len(kept)
    alive = same[row] == row
    row, col, value = np.searchsorted(kept, row[alive]), col[alive], value[alive]
    shared = np.bincount(col, minlength=int(col.max()) + 1 if len(col) else 1)[col] > 1
    row, col, value = row[shared], col[shared], value[shared]
    ends = np.searchsorted(row, np.arange(m + 1))
    post = np.argsort(col, kind="stable")
    post_row, post_value = row[post], value[post]
    start = np.searchsorted(col[post], np.arange(int(col.max()) + 2 if len(col) else 1))

    def near_to(i: int) -> np.ndarray:
        """Cosine of row i with every row."""
        s = np.zeros(m)
        for t, w in zip(col[ends[i] : ends[i + 1]], value[ends[i] : ends[i + 1]]):
            a, b = start[t], start[t + 1]
            s[post_row[a:b]] += w * post_value[a:b]
        return np.round(s, DIGITS)

    members = {i: [i] for i in range(m)}
    rows: dict[int, np.ndarray] = {}
    label = np.arange(m)
    room = max(2, KEPT_BYTES // (8 * max(m, 1)))

    def least(i: int) -> np.ndarray:
        """The least cosine of cluster i's rows with every row."""
        if i in rows:
            return rows[i]
        s = near_to(members[i][0])
        for x in members[i][1:]:
            np.minimum(s, near_to(x), out=s)
        return s

    def look(i: int) -> None:
        far = np.full(m, -np.inf)
        np.maximum.at(far, label, 1 - least(i))
        far[far == -np.inf] = np.inf  # no longer a cluster
        far[i] = np.inf
        near[i] = int(far.argmin())
        gap[i] = far[near[i]] if far[near[i]] < threshold else np.inf
        seen[i] = version[i], version[near[i]]

    near, gap = np.zeros(m, int), np.full(m, np.inf)
    version, seen = np.zeros(m, int), np.zeros((m, 2), int)
    for i in range(m):
        look(i)
    while m > 1:
        i = int(gap.argmin())
        if gap[i] == np.inf:
            break
        if tuple(seen[i]) != (version[i], version[near[i]]):
            look(i)
            continue
        i, j = sorted((i, int(near[i])))
        together = np.minimum(least(i), least(j))
        rows.pop(j, None)
        rows[i] = together
        members[i] += members.pop(j)
        if len(rows) > room:
            del rows[min(rows, key=lambda k: len(members[k]))]
        label[label == j] = i
        gap[j] = np.inf
        version[i] += 1
        version[j] += 1
        look(i)
    return kept[label][np.searchsorted(kept, same)]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``edges`` (a, b): the smallest id that is connected.

    Every node takes the least label of its neighbours, then its label's label, until none changes: rounds go with the
    logarithm of a path's length, mostly. Lineage is cut each round.
    """
    shared_folder(edges.sparkSession)
    both = edges.union(edges.select("b", "a")).toDF("id", "other").distinct().checkpoint()
    label = both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")).checkpoint()
    while True:
        seen = label.withColumnsRenamed({"id": "other", "component": "c"})
        least = both.join(seen, "other").groupBy("id").agg(F.min("c").alias("c"))
        near = label.join(least, "id").select("id", F.least("component", "c").alias("via"), F.col("component").alias("was"))
        jump = label.select(F.col("id").alias("via"), F.col("component").alias("c"))
        now = near.join(jump, "via").select("id", F.least("via", "c").alias("component"), "was").checkpoint()
        label = now.select("id", "component")
        if now.where("component <> was").isEmpty():
            return label


def _forest(nodes: np.ndarray, ids: list[np.ndarray], weights: list[np.ndarray], cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to the first row that it is connected to, by pairs nearer than the cut."""
    n = len(nodes)
    term, col = np.unique(np.concatenate(ids), return_inverse=True)
    row, value = np.repeat(np.arange(n), [len(x) for x in ids]), np.concatenate(weights)
    shared = np.bincount(col, minlength=len(term)) > 1
    row, col, value = row[shared[col]], (np.cumsum(shared) - 1)[col[shared[col]]], value[shared[col]]
    cosine = np.zeros((n, n))
    for a in range(0, int(shared.sum()), TERMS):
        some = (col >= a) & (col < a + TERMS)
        x = np.zeros((n, min(TERMS, int(shared.sum()) - a)))
        x[row[some], col[some] - a] = value[some]
        cosine += x @ x.T
    near = 1 - np.round(cosine, DIGITS) < cut
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(near, label, n).min(1))
        if (least == label).all():
            break
        label = least[least]
    moved = np.flatnonzero(label != np.arange(n))
    return nodes[moved], nodes[label[moved]]


def _compare(cut: float):
    """Sorted (t, a, b, node, ids, weights) to links: the rows of one (t, a, b) are a block's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, ids, weights = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = _forest(np.array(nodes), ids, weights, cut)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            lists = [batch.column(i) for i in (4, 5)]
            ends = [x.offsets.to_numpy() for x in lists]
            flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            for i, node in enumerate(batch.column(3).to_pylist()):
                if keys[i] != key:
                    yield from done()
                    key, nodes, ids, weights = keys[i], [], [], []
                nodes.append(node)
                ids.append(flat[0][ends[0][i] : ends[0][i + 1]])
                weights.append(flat[1][ends[1][i] : ends[1][i + 1]])
        yield from done()

    return run


def near_links(vectors: DataFrame, cut: float) -> DataFrame:
    """(a, b): links that connect the rows nearer than the cut, of vectors (group, node, v: terms (df, t, w) from rare to common), a written table.

    A group of at most BLOCK rows is one block, so its vectors are shuffled once, however many prefix terms they have.
    """
    groups = vectors.groupBy("group").agg(F.count("*").alias("n"), F.min("node").alias("lead"))
    lists = [F.col("v.t").alias("ids"), F.col("v.w").alias("weights")]
    whole = vectors.join(groups.where(F.col("n").between(2, BLOCK)), "group").select((-1 - F.col("lead")).alias("t"), F.lit(0).alias("a"), F.lit(0).alias("b"), "node", *lists)
    vectors = vectors.join(groups.where(F.col("n") > BLOCK).select("group"), "group", "left_semi")
    left = F.lit(max(0.0, 1 - cut) ** 2 - 1e-9)
    walk = F.aggregate("v", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k")), lambda s, x: F.struct(
        (s["sum"] + x["w"] * x["w"]).alias("sum"), (s["k"] + F.when(1 - s["sum"] > left, 1).otherwise(0)).alias("k")))
    prefix = vectors.select("node", F.explode(F.slice("v", F.lit(1), walk["k"])).alias("x")).where("x.df > 1").select("node", F.col("x.t").alias("t"))
    sizes = prefix.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    placed = prefix.join(sizes, "t").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = placed.select("t", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node")
    work = keyed.join(vectors.select("node", *lists), "node").select("t", "a", "b", "node", "ids", "weights").unionByName(whole)
    return work.repartition("t", "a", "b").sortWithinPartitions("t", "a", "b").mapInArrow(_compare(cut), "a long, b long")


def linked(tfidf: DataFrame, cut: float, least: int) -> DataFrame:
    """(group, doc_id, cluster) of the clusters of at least ``least`` rows, from unit rows (group, position, doc_id, term, tfidf).

    A cluster is named by the place of its first row among its group's rows in (position, doc_id) order, from 0. An entry that is
    there twice counts once; an empty table gives no cluster.
    """
    rows = written(tfidf.groupBy("group", "doc_id", "term").agg(F.max("tfidf").alias("w"), F.min("position").alias("position")), "theme-rows")
    terms = written(rows.groupBy("group", "term").agg(F.count("*").alias("df")).withColumn("t", F.monotonically_increasing_id()), "theme-terms")
    vectors = rows.join(terms, ["group", "term"]).groupBy("group", "doc_id").agg(F.min("position").alias("position"), F.array_sort(F.collect_list(F.struct("df", "t", "w"))).alias("v"))
    vectors = written(vectors.withColumn("node", F.monotonically_increasing_id()), "theme-vectors")
    if cut > 1:  # rows without a common term are near too
        placed = vectors.withColumn("component", F.min("node").over(Window.partitionBy("group")))
    else:
        placed = vectors.join(components(near_links(vectors, cut)), vectors["node"] == F.col("id"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, least))
    work = placed.join(sizes, "component").select("component", "position", "doc_id", "node", F.col("v.t").alias("ids"), F.col("v.w").alias("weights"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "doc_id"])
        row = np.repeat(np.arange(len(pdf)), pdf["ids"].map(len))
        col = np.unique(np.concatenate(pdf["ids"].to_numpy()), return_inverse=True)[1]
        label = complete_linkage(row, col, np.concatenate(pdf["weights"].to_numpy()), len(pdf), cut)
        large = np.bincount(label, minlength=len(pdf))[label] >= least
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"node": node[large], "first": node[label[large]]})

    found = written(work.groupBy("component").applyInPandas(link, "node long, first long"), "theme-clusters")
    place = F.row_number().over(Window.partitionBy("group").orderBy("position", "doc_id")) - 1
    spots = vectors.select("node", "group", "doc_id", place.cast("long").alias("cluster"))
    firsts = spots.join(found.select(F.col("first").alias("node")).distinct(), "node").select(F.col("node").alias("first"), "cluster")
    return found.join(vectors.select("node", "group", "doc_id"), "node").join(firsts, "first").select("group", "doc_id", "cluster")
