"""Quality rules as a bitmask ledger.

Each document is measured once and each rule evaluated once: the ledger stores the
measurements and one failure bit a rule. A policy is a versioned mask over those bits,
so a new policy, or an ablation of one, is bit arithmetic over the ledger and never
reads a text again.

Defined results: a null text has no words and fails ``few_words``; null ids are carried;
repeated rows give repeated ledger rows; an empty table gives an empty ledger; only the
id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import lean

SPACE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = tuple(bytes([c]) for c in b"#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` (SQL over the measurements) holds."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules that reject a document."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "20 * n_symbols > word_chars"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "capitals", "2 * n_upper > n_letters"),
    Rule(5, "word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", tuple(r.name for r in RULES))
POLICIES = {p.version: p for p in (BASE, V1)}


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: 1 << r.bit for r in rules}
    return reduce(lambda a, n: a | by_name[n], policy.rules, 0)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    if len(seen) == n:
        return 0
    if len(seen) < 1 << 21:  # three ids fit one integer: exact
        key = (ids[:-2] << np.uint64(42)) | (ids[1:-1] << np.uint64(21)) | ids[2:]
    else:
        at: dict[tuple, int] = {}
        key = np.fromiter((at.setdefault(t, len(at)) for t in zip(words, words[1:], words[2:])), np.uint64, n - 2)
    s = np.sort(key)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    again = again[np.concatenate(([True], again[1:] != again[:-1]))]
    at = np.minimum(np.searchsorted(again, key), len(again) - 1)
    hit = again[at] == key
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measure_text(raw: bytes | None) -> tuple[int, ...]:
    """All measurements of one text, given as UTF-8, in the order of MEASURES."""
    raw = raw or b""
    words = raw.split()
    points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    lines = n_lines = 0
    seen = set()
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                lines += 1
            else:
                seen.add(line)
    at = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((at >= 65) & (at <= 90)))
    lower = int(np.count_nonzero((at >= 97) & (at <= 122)))
    return (
        len(words),
        points - sum(map(raw.count, SPACE)),
        sum(map(raw.count, SYMBOLS)),
        n_lines,
        lines,
        repeat_words(words),
        upper,
        upper + lower,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure_text(x.as_py()) for x in batch.column(1)]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *MEASURES])


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One failure bit a rule, over the measurements of MEASURES."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: one row for each input row, one scan, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    measured = rows.mapInArrow(lean(_measure), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("fail_bits", fail_bits(rules))


def passing(docs: DataFrame, policy: Policy = V1, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the base and the policy keep, in one scan without a shuffle; columns are unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure_text(x.as_buffer() and x.as_buffer().to_pybytes()) for x in batch.column(0).field(at)]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", *MEASURES])

    packed = docs.select(F.struct("*").alias("row"))  # no column of docs can clash with a measurement
    measured = packed.mapInArrow(lean(run), T.StructType([*packed.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))
    book = measured.withColumn("fail_bits", fail_bits(rules))
    return book.where(~(failed(BASE, rules=rules) | failed(policy, rules=rules))).select("row.*")


def failed(policy: Policy, bits: str = "fail_bits", rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy, rules))) != 0


def apply_policy(book: DataFrame, policy: Policy = V1, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept; a document that fails the base is never kept."""
    base = failed(BASE, rules=rules)
    return book.withColumn("base_failed", base).withColumn("kept", ~base & ~failed(policy, rules=rules))


def ablation(book: DataFrame, policy: Policy = V1, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents it fails, those it alone rejects, and those kept without it.

    Documents are first counted by bit pattern (at most 2 ** rules rows leave each task).
    """
    m = mask(policy, rules)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    r = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return r.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(rest == 0).alias("n_kept_without"),
    )
