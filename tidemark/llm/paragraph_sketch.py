"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

* A text is cut into paragraphs: its lines, cut on after sentence ends and at PIECE code points,
  stripped of outer white space; what is empty then is left out. A paragraph's digest is the
  64-bit xxHash of its UTF-8 bytes, seeded by the number of its earlier occurrences in the text,
  so the digests of a text are a set that counts repetitions.
* A sketch has three parts of equally many cells (count, sum of digests, sum of checks); a digest
  enters one cell of each part. Sketches of one size subtract cell by cell, and digests that both
  texts hold vanish. Peeling takes cells that hold one digest, confirmed by its check, until
  nothing is left: what it took are the digests that differ, with their side.
* Where peeling ends early the two sketches are made again with GROWTH times the cells (and other
  cells for every digest) until it succeeds, so a result is always the whole difference.
* The fingerprint is the sketch of CELLS cells as text. The likeness of two fingerprints is
  shared / (shared + different) paragraphs, 1 where both have none.

``chained`` takes documents by ascending id. Texts are shuffled once, by ranges of ids whose heads
are found on the id column alone; the document that opens a range is also sent to the range
before. A task reads its range in order and holds two texts at a time.

Null texts count as empty, empty ones have the empty sketch; long texts are sketched whole. Equal
texts have equal fingerprints. Rows that share an id (null ids come first) follow each other by
text, repeated rows each get a row; rows of one id are in one range. Empty tables give empty
results, and only the id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean

#: Cells of a fingerprint, growth of a retry and code points of a piece of a sentence without an end.
CELLS, GROWTH, PIECE = 48, 4, 400
#: Rows of a result batch.
ROWS = 512

_PIECES = re.compile(rf"[^\n.!?]{{0,{PIECE}}}[.!?]+|[^\n.!?]{{1,{PIECE}}}")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def digests(text: str) -> np.ndarray:
    """Distinct paragraph digests of a text, repetitions told apart."""
    seen: dict[str, int] = {}
    out = []
    for piece in _PIECES.findall(text):
        piece = piece.strip()
        if piece:
            n = seen.get(piece, 0)
            seen[piece] = n + 1
            out.append(xxhash.xxh3_64_intdigest(piece.encode("utf-8", "replace"), n))
    return np.unique(np.array(out, np.uint64))


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(29)) ^ np.uint64(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _ODD[salt % 4]
    return (x ^ (x >> np.uint64(32))) * _ODD[(salt + 1) % 4] >> np.uint64(32)


def _check(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, 1001).astype(np.uint32)


class Sketch:
    """counts, sums of digests (modulo 2^64) and of checks (modulo 2^32) in ``cells`` cells."""

    __slots__ = ("cells", "n", "counts", "keys", "checks")

    def __init__(self, cells: int):
        self.cells, self.n = cells, 0
        self.counts, self.keys, self.checks = np.zeros(cells, np.int32), np.zeros(cells, np.uint64), np.zeros(cells, np.uint32)

    @classmethod
    def of(cls, keys: np.ndarray, cells: int = CELLS) -> Sketch:
        out = cls(cells)
        out.n = len(keys)
        out._add(keys, np.ones(len(keys), np.int32))
        return out

    def _add(self, keys: np.ndarray, signs: np.ndarray) -> None:
        part = self.cells // 3
        sums, checks = keys * signs.astype(np.uint64), _check(keys) * signs.astype(np.uint32)
        for j in range(3):
            at = (_mixed(keys, 3 * self.cells + j) % np.uint64(part)).astype(np.intp) + j * part
            np.add.at(self.counts, at, signs)
            np.add.at(self.keys, at, sums)
            np.add.at(self.checks, at, checks)

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.cells)
        out.n, out.counts, out.keys, out.checks = self.n - other.n, self.counts - other.counts, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(digests only of the left, only of the right) of a difference, or None where cells are left that hold several. Empties the sketch."""
        keys, signs = [], []
        for _ in range(self.cells + 1):
            at = np.flatnonzero(np.abs(self.counts) == 1)
            sign = self.counts[at]
            key = self.keys[at] * sign.astype(np.uint64)
            pure = _check(key) * sign.astype(np.uint32) == self.checks[at]
            key, first = np.unique(key[pure], return_index=True)
            if not len(key):
                break
            sign = sign[pure][first]
            self._add(key, -sign)
            keys.append(key)
            signs.append(sign)
        if self.counts.any() or self.keys.any() or self.checks.any():
            return None
        key, sign = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (signs, np.int32)))
        return key[sign > 0], key[sign < 0]

    def text(self) -> str:
        raw = self.counts.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u4").tobytes()
        return base64.b64encode(raw).decode()


class Marked:
    """A text's digests and its sketches by size, made as they are asked for."""

    __slots__ = ("keys", "made")

    def __init__(self, text: str):
        self.keys, self.made = digests(text), {}

    def sketch(self, cells: int = CELLS) -> Sketch:
        if cells not in self.made:
            self.made[cells] = Sketch.of(self.keys, cells)
        return self.made[cells]


def difference(a: Marked, b: Marked) -> tuple[np.ndarray, np.ndarray, int]:
    """Digests only in a, only in b, and the cells that it took."""
    cells = CELLS
    while (found := a.sketch(cells).minus(b.sketch(cells)).peel()) is None:
        cells *= GROWTH
    return *found, cells


def likeness(a: Marked, b: Marked) -> float:
    """Shared of all different paragraphs of two texts, from the counts of their sketches and the recovered difference."""
    left, right, _ = difference(a, b)
    together, apart = a.sketch().n + b.sketch().n, len(left) + len(right)
    return (together - apart) / (together + apart) if together else 1.0


def _texts(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def _bytes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and fingerprint of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Marked(t).sketch() for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.n for s in made], pa.int64()), pa.array([s.text() for s in made], pa.string())], ["doc_id", "n_paragraphs", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _bytes(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_paragraphs long, fingerprint string")


def compared(pairs: DataFrame, id_col: str, old: str, new: str) -> DataFrame:
    """id, likeness, removed and added (digests in hexadecimal, sorted) and the cells of the sketch that gave them, of two versions of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda keys: [f"{k:016x}" for k in keys.tolist()]
        for batch in batches:
            near, removed, added, used = [], [], [], []
            for a, b in zip(_texts(batch.column(1)), _texts(batch.column(2))):
                a, b = Marked(a), Marked(b)
                left, right, cells = difference(a, b)
                near.append(likeness(a, b))
                removed.append(listed(np.sort(left)))
                added.append(listed(np.sort(right)))
                used.append(cells)
            lists = [pa.array(x, pa.list_(pa.string())) for x in (removed, added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.float64()), *lists, pa.array(used, pa.int32())], ["id", "likeness", "removed", "added", "cells"])

    rows = pairs.select(F.col(id_col).cast("string").alias("id"), _bytes(old).alias("old"), _bytes(new).alias("new"))
    return rows.mapInArrow(lean(run), "id string, likeness double, removed array<string>, added array<string>, cells int")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


CHAINED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_CHAINED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _paired(rows: Iterable[tuple[int, int | None, bool, str]]) -> Iterator[tuple]:
    """Result rows of (range, id, opener, text) in order: own rows of a range, then the openers of the next one, of which the first counts."""
    last = None
    for part, doc, opener, text in rows:
        mark = None
        if last is not None and last[0] == part:
            _, was, before, own = last
            mark = Marked(text)
            changed = edited(before, text)
            new = Marked(changed)
            yield (
                was, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own.sketch().text(), new.sketch().text(),
                likeness(own, new), likeness(own, mark),
            )
        last = None if opener else (part, doc, text, mark or Marked(text))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                yield from zip(*(some.column(i).to_pylist() for i in range(3)), _texts(some.column(3)))

    held: list[tuple] = []
    for row in _paired(rows()):
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _CHAINED)], schema=_CHAINED)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _CHAINED)], schema=_CHAINED)


def _place(heads: list[int], doc: Column) -> Column:
    """Number of heads up to an id, by two short scans; null ids are at 0."""
    if not heads:
        return F.lit(0)
    step = max(1, int(len(heads) ** 0.5))
    groups = [heads[i : i + step] for i in range(0, len(heads), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda h: h <= doc))
    group = F.greatest(upto(F.array(*[F.lit(g[0]) for g in groups])), F.lit(1))
    table = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    return F.coalesce(F.when(doc.isNull(), 0).otherwise((group - 1) * step + upto(F.element_at(table, group))), F.lit(0))


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Every document against its edited text and the next document by id (CHAINED); after the last comes the first.

    ``ranges`` is the number of id ranges, a task each: spark.sql.shuffle.partitions if not given.
    """
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _bytes(text_col).alias("text"))
    spread = rows.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("at"))
    ends = spread.agg(F.min("doc_id").alias("head"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()  # one row a range
    heads = sorted({r["head"] for r in ends if r["head"] is not None})
    openers = heads[1:]  # range i holds the ids from openers[i - 1] up to openers[i]
    first = None if any(r["nulls"] for r in ends) or not heads else heads[0]
    doc, last = F.col("doc_id"), len(openers)
    own = rows.withColumn("part", _place(openers, doc))
    opens = F.when(doc.eqNullSafe(F.lit(first).cast("long")), F.lit(last))
    if openers:
        opens = opens.when((F.col("part") > 0) & (doc == F.element_at(F.array(*map(F.lit, openers)), F.greatest("part", F.lit(1)))), F.col("part") - 1)
    to = F.filter(F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("opener")), F.struct(opens.alias("to"), F.lit(True).alias("opener"))), lambda x: x["to"].isNotNull())
    sent = own.select("doc_id", "text", F.explode(to).alias("x")).select(F.col("x.to").alias("part"), "doc_id", F.col("x.opener").alias("opener"), "text")
    dealt = sent.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "opener", "doc_id", "text")
    return dealt.mapInArrow(lean(_chain), CHAINED)
