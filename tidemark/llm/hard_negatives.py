"""Hard negatives of an anchor through product quantisation with stored residual norms.

* Vectors are integers. A quantiser with one codebook for each pair of components is fitted on at
  most SAMPLE rows (those with the smallest hashes of their ids); every row is indexed: its codes,
  a bound on the norm of what they leave out, and its exact components, in packs of PACK rows.
* The query set, the anchors, is asked in blocks of ANCHORS against all packs: each task takes
  some packs and one block. A lookup table a block (codeword x anchor) gives the score of
  the codes; by Cauchy-Schwarz the exact score lies within anchor norm x residual norm of it. A
  row whose upper bound is under what the task already holds, or whose lower bound is above the
  window, is left out; for all others the exact integer score is taken. The bounds hold
  for every row, so results are exact (recall 1) whatever the sample.
* Two passes: the best ``n_positives`` rows of the anchor's label give a score window each, then the
  best ``n_negatives`` rows of other labels within each window. Tasks give their best ones, which meet
  by anchor: at most tasks x n rows for each.

Higher scores come first, ties by smaller id. Rows with a null id, label or vector, or a null or
non-finite component take no part; shorter vectors are padded with zeros. Rows that share an
anchor's id are no others of it; repeated anchors (equal id, label and vector) are asked once,
other repeated rows count each. Vectors of any length are read whole. Scores must fit a long.
Empty tables give empty results; only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, written

#: Rows that the codebooks are fitted on, components a codebook, codewords a codebook, rounds of the fit.
SAMPLE, WIDTH, WORDS, ROUNDS = 20_000, 2, 256, 8
#: Rows of a pack, anchors of a block, rows that are scored at once (fewer at first, when no bar is set yet).
PACK, ANCHORS, STEP, FIRST = 2048, 1024, 1024, 128
#: Least and most share (in hundredths) of a positive's score that a negative's may have.
LOW, HIGH = 50, 95

_INDEX = "ids binary, labels binary, width int, vectors binary, codes binary, reach binary"
_NONE = -(1 << 62)


def _odd(v: Column) -> Column:
    return v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))


def scaled(x: Column, scale: float = 256) -> Column:
    """Components as floor(scale * x); null where not finite, so that the row takes no part."""
    return F.transform(x, lambda v: F.when(~_odd(v), F.floor(F.lit(float(scale)) * v.cast("double"))))


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, x) of the rows that take part, components unscaled."""
    x = F.col(vector_col)
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~F.exists(x, _odd))
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """int64 rows of a list column, padded with zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = values
    return out


class Quantiser:
    """A codebook (words x width) for each run of ``width`` components."""

    def __init__(self, sample: np.ndarray, width: int = WIDTH, words: int = WORDS, rounds: int = ROUNDS):
        self.dims, self.width = sample.shape[1], width
        self.parts = -(-self.dims // width)
        parts, r = self._split(sample), np.random.default_rng(0)
        self.books = np.zeros((self.parts, words, width))
        for p, book in zip(parts, self.books):
            some = np.unique(p, axis=0)
            some = some[r.permutation(len(some))[:words]]
            book[:] = np.resize(some, (words, width))
            for _ in range(rounds if len(some) == words else 0):
                near = self._nearest(p, book)
                n = np.bincount(near, minlength=words)
                for j in range(width):
                    sums = np.bincount(near, p[:, j], minlength=words)
                    book[n > 0, j] = sums[n > 0] / n[n > 0]

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * self.width))
        padded[:, : self.dims] = x
        return padded.reshape(len(x), self.parts, self.width).transpose(1, 0, 2)

    @staticmethod
    def _nearest(p: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book**2).sum(1) - 2 * p @ book.T).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and, for each row, a bound on the residual's norm with room for rounding."""
        parts = self._split(x)
        codes = np.stack([self._nearest(p, b) for p, b in zip(parts, self.books)], 1).astype(np.uint8)
        left = np.sqrt(sum(((p - b[codes[:, m]]) ** 2).sum(1) for m, (p, b) in enumerate(zip(parts, self.books))))
        return codes, left + 1e-5 * (np.sqrt((x.astype(float) ** 2).sum(1)) + left)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """Scores of every codeword with every anchor: parts x words x anchors."""
        return np.stack([b @ p.T for p, b in zip(self._split(anchors), self.books)]).astype(np.float32)


def _packer(quantiser: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), PACK):
                some = batch.slice(a, PACK)
                x = _matrix(some.column(2), quantiser.dims)
                codes, reach = quantiser.encode(x)
                width = next(w for w in (2, 4, 8) if w == 8 or np.abs(x).max(initial=0) < 1 << (8 * w - 1))
                ids, labels = (some.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(2))
                data = [ids.tobytes(), labels.tobytes(), width, x.astype(f"<i{width}").tobytes(), codes.tobytes(), reach.astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in data], _INDEX.replace(" binary", "").replace(" int", "").split(", "))

    return run


def _blocks(anchors: DataFrame, n: int, dims: int, fields: str) -> DataFrame:
    """Blocks (ids, labels, keys, vectors, and windows where the anchors have some) of at most ANCHORS anchors, about one a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (met := [b for b in batches if len(b)]):
            return
        table = pa.Table.from_batches(met)
        for a in range(0, table.num_rows, ANCHORS):
            some = table.slice(a, ANCHORS).combine_chunks().to_batches()[0]
            data = [some.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for i in range(3)] + [_matrix(some.column(3), dims).astype("<i8").tobytes()]
            for i in range(4, some.num_columns):
                sizes = np.diff(some.column(i).offsets.to_numpy())
                data += [sizes.astype("<i8").tobytes(), some.column(i).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in data], [f.split()[0] for f in fields.split(", ")])

    dealt = anchors.repartitionById(n, F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    return dealt.mapInArrow(run, fields)


_BLOCK = "b_ids binary, b_labels binary, b_keys binary, b_vectors binary"
_WINDOWS = _BLOCK + ", b_counts binary, b_positives binary, b_counts2 binary, b_scores binary"


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best (score falling, id) of each owner."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return order[place < n]


def _hundredths(n: int, x: np.ndarray) -> np.ndarray:
    """floor(n * x / 100) without leaving 64 bits."""
    return n * (x // 100) + n * (x % 100) // 100


class _Held:
    """The best n candidates of each owner so far, and the bar that another has to reach."""

    def __init__(self, owners: int, n: int):
        self.n, self.bar = n, np.full(owners, _NONE, np.int64)
        self.owner, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.bar[owner]
        owner, score, ids = np.r_[self.owner, owner[good]], np.r_[self.score, score[good]], np.r_[self.ids, ids[good]]
        keep = _best(owner, score, ids, self.n)
        self.owner, self.score, self.ids = owner[keep], score[keep], ids[keep]
        full = np.bincount(self.owner, minlength=len(self.bar)) == self.n
        least = np.full(len(self.bar), np.iinfo(np.int64).max)
        np.minimum.at(least, self.owner, self.score)
        self.bar = np.where(full, least, self.bar)


class _Block:
    """A block of anchors: its lookup tables and what one task has found for it."""

    def __init__(self, quantiser: Quantiser, data: dict[str, bytes], n: int):
        of = lambda c: np.frombuffer(data[c], "<i8")
        self.ids, self.labels, self.keys = of("b_ids"), of("b_labels"), of("b_keys")
        self.x = of("b_vectors").reshape(len(self.ids), quantiser.dims)
        self.norm = np.sqrt((self.x.astype(float) ** 2).sum(1))
        self.tables, self.most = quantiser.tables(self.x), int(np.abs(self.x).max(initial=0))
        self.windows = "b_counts" in data
        if self.windows:
            counts = of("b_counts")
            self.slots = int(counts.max(initial=0))
            at = np.repeat(np.arange(len(counts)) * self.slots - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shape = len(counts) * self.slots
            self.positive, self.score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            self.low, self.high = np.ones(shape, np.int64), np.zeros(shape, np.int64)  # empty where there is no positive
            self.positive[at], self.score[at] = of("b_positives"), of("b_scores")
            self.low[at], self.high[at] = -_hundredths(LOW, -of("b_scores")), _hundredths(HIGH, of("b_scores"))
        self.held = _Held(len(self.ids) * (self.slots if self.windows else 1), n)
        self.seen = 0

    def take(self, pack: dict) -> None:
        ids, labels = np.frombuffer(pack["ids"], "<i8"), np.frombuffer(pack["labels"], "<i8")
        x = np.frombuffer(pack["vectors"], f"<i{pack['width']}").reshape(len(ids), -1)
        codes, reach = np.frombuffer(pack["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(pack["reach"], "<f8")
        a = 0
        while a < len(ids):
            b = min(len(ids), a + max(FIRST, min(STEP, self.seen)))
            self._score(ids[a:b], labels[a:b], x[a:b], codes[a:b], reach[a:b])
            self.seen, a = self.seen + b - a, b

    def _score(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, reach: np.ndarray) -> None:
        middle = self.tables[0][codes[:, 0]]
        for m in range(1, codes.shape[1]):
            middle += self.tables[m][codes[:, m]]
        room = (reach[:, None] * self.norm + 1).astype(np.float32)
        upper, lower = middle + room, middle - room
        same = labels[:, None] == self.labels
        mine = ids[:, None] != self.ids
        mine &= ~same if self.windows else same
        held = self.held
        if not self.windows:
            rows, anchors = np.nonzero(mine & ~(upper < _under(held.bar)))
            held.add(anchors, self._exact(anchors, rows, x), ids[rows])
            return
        shape = (len(self.ids), self.slots)
        floor, high = np.maximum(held.bar, self.low).reshape(shape), self.high.reshape(shape)
        open_ = (self.low <= self.high).reshape(shape)
        wanted = np.zeros_like(mine)
        for w in range(self.slots):
            wanted |= ~(upper < _under(floor[:, w])) & ~(lower > _over(high[:, w])) & open_[:, w]
        rows, anchors = np.nonzero(mine & wanted)
        score = self._exact(anchors, rows, x)
        owners, scores, found = [], [], []
        for w in range(self.slots):
            inside = (score >= floor[anchors, w]) & (score <= high[anchors, w]) & open_[anchors, w]
            owners.append(anchors[inside] * self.slots + w)
            scores.append(score[inside])
            found.append(ids[rows[inside]])
        held.add(np.concatenate(owners), np.concatenate(scores), np.concatenate(found))

    def _exact(self, anchors: np.ndarray, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Integer scores of pairs, in doubles where these are exact."""
        kind = float if self.most * int(np.abs(x.astype(np.int64)).max(initial=0)) * max(1, x.shape[1]) < 1 << 53 else np.int64
        left, right, out = self.x.astype(kind), x.astype(kind), np.zeros(len(rows), np.int64)
        for a in range(0, len(rows), 1 << 15):
            out[a : a + (1 << 15)] = np.einsum("ij,ij->i", left[anchors[a : a + (1 << 15)]], right[rows[a : a + (1 << 15)]])
        return out


def _under(x: np.ndarray) -> np.ndarray:
    """float32 at or under integers."""
    y = x.astype(np.float32)
    return np.nextafter(y, np.float32(-np.inf))


def _over(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.nextafter(y, np.float32(np.inf))


_FOUND = "key long, anchor_id long, found_id long, score long"
_FOUND_IN = "key long, anchor_id long, slot int, positive_id long, positive_score long, found_id long, score long"


def _search(quantiser: Quantiser, n: int, windows: bool):
    fields = _FOUND_IN if windows else _FOUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[bytes, _Block] = {}  # those of one partition of blocks: one, seldom two
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                if row["b_keys"] not in blocks:
                    blocks[row["b_keys"]] = _Block(quantiser, row, n)
                blocks[row["b_keys"]].take(row)
        for b in blocks.values():
            held = b.held
            at = held.owner // b.slots if windows else held.owner
            columns = [b.keys[at], b.ids[at]]
            if windows:
                columns += [(held.owner % b.slots).astype(np.int32), b.positive[held.owner], b.score[held.owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, held.ids, held.score)], [f.split()[0] for f in fields.split(", ")])

    return run, fields


def _ask(index: DataFrame, blocks: DataFrame, quantiser: Quantiser, n: int, windows: bool, tasks: int) -> DataFrame:
    """The best n of each task for each owner: packs x blocks is a grid of tasks, a pack's and a block's rows are never paired as rows."""
    run, fields = _search(quantiser, n, windows)
    return index.coalesce(tasks).hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(lean(run), fields)


def mine(
    rows: DataFrame, anchors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", n_positives: int = 5,
    n_negatives: int = 3, tasks: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, a part of ``rows`` with the same columns.

    Vectors hold integers (see ``scaled``). ``tasks`` is the number of tasks that share the index for
    a block of anchors: twice the cluster's cores if not given.
    """
    spark = rows.sparkSession
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism
    all_rows = usable(rows, id_col, label_col, vector_col)
    asked = written(usable(anchors, id_col, label_col, vector_col).distinct().withColumn("key", F.monotonically_increasing_id()), "anchors")
    dims = all_rows.agg(F.max(F.size("x"))).first()[0] or 0
    n_asked = asked.count()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_asked or not dims:
        return spark.createDataFrame([], out)
    sample = all_rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()
    quantiser = Quantiser(_matrix(sample.column(0).combine_chunks(), dims))
    index = written(all_rows.select("id", "label", "x").mapInArrow(lean(_packer(quantiser)), _INDEX), "pq-index")
    n_blocks = -(-5 * n_asked // (4 * ANCHORS))
    blocks = _blocks(asked.select("id", "label", "key", "x"), n_blocks, dims, _BLOCK)
    found = _ask(index, blocks, quantiser, n_positives, False, tasks)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "found_id")
    best = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n_positives)
    listed = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "found_id", "score"))).alias("p"))
    windows = asked.join(listed, "key").select("id", "label", "key", "x", F.col("p.found_id").alias("positives"), F.col("p.score").alias("scores"))
    windows = written(windows, "windows")
    found = _ask(index, _blocks(windows, n_blocks, dims, _WINDOWS), quantiser, n_negatives, True, tasks)
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "found_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
