"""Token-id output: documents as range-coded id files in ascending id order, and reading them.

Write: rows are range-partitioned and sorted by document id, each task encodes its texts
and emits segments (see rangecoder), whole documents of SEGMENT ids or a little more.
A file set is a Parquet table of segments (part, seq, doc_ids, n_tokens, data): Spark's
commit makes it appear whole or not at all, retried tasks replace their own output, and it
reads from any store. (part, seq) is the order of ids in the file set.

Read: segments are decoded and checked block by block; a document's start is the number of
ids before it, from sums by part, then by segment, then within the segment.

Encoding keeps the tokenizer's results for words between single spaces, which its pattern
never joins, in a bounded cache, whose rare words go first. New words of common characters are cut by that pattern, and only new pieces go through
the library's merges. Other words are encoded by the whole tokenizer; so are whole texts with other white space next to a space, or with the string
of a special token. The tokenizer's settings are its file's: the string of a special
token in a text becomes that token.

Defined results: null and empty texts have the end id only; equal ids are ordered by text;
null ids come first; a repeated row is a document of its own; an empty table writes no
segment; long texts are encoded whole. Only id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import rangecoder
from tidemark.llm.common import lean, scratch

END_ID = 0
SEGMENT = rangecoder.BLOCK * rangecoder.LANES
#: Words kept in a worker's cache, the pieces that are encoded in one call, and the bytes of texts that are split at once.
CACHE, CALL, CHUNK = 1_000_000, 4096, 6_000_000
SCHEMA = "part int, seq int, doc_ids array<long>, n_tokens array<int>, data binary"

#: White space of Unicode and of Python.
_WHITE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPLIT_ALONE = rf"{_WHITE}\x20|\x20{_WHITE}|\A\x20|\x20\z"
#: Words of characters whose classes no version of Unicode changes, with single line ends inside, and the tokenizer's pattern on
#: them, behind spaces and separated by _CUT.
_LETTERS, _NUMBERS, _CUT = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\x01"
_COMMON = r"\A (?:[!-~\x{a1}-\x{24f}]+(?:\n[!-~\x{a1}-\x{24f}]+)*)\z"
_PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^ \n{_CUT}{_LETTERS}{_NUMBERS}]+|\n|{_CUT}")
_loaded: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return at


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class _Store:
    """Strings and their 16-bit ids, all in one array."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint16)
        self.starts, self.sizes, self.asked = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Codes of new entries, whose ids follow each other."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(sizes) > len(self.sizes):
            self.starts, self.sizes, self.asked = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes, self.asked))
        new = slice(self.n, self.n + len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[new] = sizes
        self.starts[new] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = new.stop, self.used + len(ids)
        return np.arange(new.start, new.stop)

    def get(self, codes: np.ndarray) -> np.ndarray:
        """Ids of entries, one entry after the other."""
        sizes = self.sizes[codes]
        found, a = np.empty(int(sizes.sum()), np.uint16), 0
        for i in range(0, len(codes), 1 << 16):
            at = _ranges(self.starts[codes[i : i + (1 << 16)]], sizes[i : i + (1 << 16)])
            found[a : a + len(at)] = self.ids[at]
            a += len(at)
        return found

    def often(self, most: int) -> _Store:
        """A store of the strings that were asked for more than once; empty if they are more than ``most``."""
        store = _Store()
        kept = [(x, i) for x, i in self.codes.items() if self.asked[i] > 1]
        if kept and len(kept) <= most:
            codes = np.array([i for _, i in kept], np.int64)
            store.codes = dict(zip((x for x, _ in kept), store.add(self.get(codes), self.sizes[codes]).tolist()))
        return store


class Encoder:
    """Ids of texts, as 16-bit numbers."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.t, self.merges = (Tokenizer.from_file(path or tokenizer_path()) for _ in range(2))
        # pieces are of one match of the pattern each and come as the characters of their bytes, so the second looks for spaces only
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = (b for b in range(256) if b not in same)
        self.byte_chars = {b: b for b in same} | {b: 256 + i for i, b in enumerate(other)}
        special = [re.escape(t.content) for t in self.t.get_added_tokens_decoder().values()]
        self.alone = "|".join([_SPLIT_ALONE, *special])
        vocab = self.t.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # byte-level tokens: one character a byte
            self.width[i] = len(token)
        self.store = _Store()

    def _add(self, ids: list[int], lengths: list[int]) -> np.ndarray:
        """Codes of strings that were encoded in one call, cut at their ends."""
        ids = np.array(ids, np.int64)
        cut = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(lengths)) + 1
        return self.store.add(ids, np.diff(cut, prepend=0))

    def _learn_pieces(self, pieces: list[str]) -> None:
        for ascii_only in (True, False):
            those = [x for x in pieces if x.isascii() == ascii_only]
            for i in range(0, len(those), CALL):
                some = those[i : i + CALL]
                if ascii_only:
                    lengths, text = list(map(len, some)), _CUT.join(some).replace(" ", "Ġ").replace("\n", "Ċ").replace(_CUT, " ")
                else:
                    lengths = [len(x.encode()) for x in some]
                    text = " ".join(x.encode().decode("latin-1").translate(self.byte_chars) for x in some)
                found = self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids
                self.store.codes.update(zip(some, self._add(found, lengths).tolist()))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts and the number of each text's."""
        found = [x.ids for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)

    def _learn(self, words: pa.Array) -> None:
        """Take up new words, each with the space before it."""
        known = self.store.codes
        common = pc.match_substring_regex(words, _COMMON)
        letters = pc.and_(common, pc.utf8_is_alpha(pc.utf8_slice_codeunits(words, 1)))
        plain, mixed = _list(words.filter(letters)), _list(words.filter(pc.and_not(common, letters)))
        pieces = _PIECE.findall("".join(f"{x}{_CUT}" for x in mixed))
        self._learn_pieces(list(dict.fromkeys([*plain, *(x for x in pieces if x not in known and x != _CUT)])))
        codes = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        ends = codes < 0  # only the cuts are no pieces
        codes = codes[~ends]
        self.store.asked += np.bincount(codes, minlength=len(self.store.asked))
        owner = np.cumsum(ends)[~ends]
        sizes = np.bincount(owner, self.store.sizes[codes], len(mixed)).astype(np.int64)
        known.update(zip(mixed, self.store.add(self.store.get(codes), sizes).tolist()))
        rest = _list(words.filter(pc.invert(common)))
        for i in range(0, len(rest), CALL):
            some = rest[i : i + CALL]
            found = self.t.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            known.update(zip(some, self._add(found, [len(x.encode()) for x in some]).tolist()))

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Codes of words behind a space."""
        named = words.dictionary_encode()
        spaced, known = pc.binary_join_element_wise(" ", named.dictionary, ""), self.store.codes
        strings = _list(spaced)
        codes = np.fromiter(map(known.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(codes < 0)
        if len(new):
            self._learn(spaced.take(pa.array(new)))
            codes[new] = [known[strings[i]] for i in new.tolist()]
        self.store.asked[codes] += 1
        return codes[named.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (no null), with the end id behind each, and the number of each text's."""
        if len(self.store.codes) > CACHE:
            self.store = self.store.often(CACHE // 2)
        alone = pc.match_substring_regex(texts, self.alone)
        kept, alone = pc.if_else(alone, "", texts), alone.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(kept, " ")
        words, offsets = split.values, split.offsets.to_numpy()
        heads = np.zeros(len(words), bool)
        heads[offsets[:-1]] = True
        codes = np.zeros(len(words), np.int64)
        codes[~heads] = self._codes(words.filter(pa.array(~heads)))
        n, used = self.store.n, self.store.used
        first = _list(words.filter(pa.array(heads)))
        for i in np.flatnonzero(alone).tolist():
            first[i] = texts[i].as_py()
        codes[offsets[:-1]] = self.store.add(*self._whole(first))
        end = self.store.add(np.array([END_ID]), np.array([1]))
        codes = np.insert(codes, offsets[1:], end)
        at = offsets[1:] + np.arange(1, len(texts) + 1)
        ids, ends = self.store.get(codes), np.cumsum(self.store.sizes[codes])[at - 1]
        self.store.n, self.store.used = n, used  # first words and whole texts are not kept
        return ids, np.diff(ends, prepend=0)


def _encoder(path: str | None) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _strings(texts: pa.Array) -> pa.Array:
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of CHUNK bytes of text or a little more."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            m = min(len(batch), int(np.searchsorted(sizes, CHUNK - n)) + 1)
            held.append(batch.slice(0, m))
            n, batch = n + int(sizes[m - 1]), batch.slice(m)
            if n >= CHUNK:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _segments(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        ids, docs, sizes, n = [], [], [], 0

        def segment() -> pa.RecordBatch:
            data = rangecoder.encode(np.concatenate(ids))
            own = np.concatenate(sizes)
            lists = (pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), x) for x in (pa.concat_arrays(docs), pa.array(own, pa.int32())))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *lists, pa.array([data], pa.binary())], ["part", "seq", "doc_ids", "n_tokens", "data"])

        for some in _chunks(batches):
            found, each = encoder.encode(_strings(some.column(1)))
            while len(each):  # whole documents up to the segment's size or a little more
                m = min(len(each), int(np.searchsorted(np.cumsum(each), SEGMENT - n)) + 1)
                k = int(each[:m].sum())
                ids.append(found[:k])
                docs.append(some.column(0)[:m])
                sizes.append(each[:m])
                n += k
                found, each, some = found[k:], each[m:], some.slice(m)
                if n >= SEGMENT:
                    yield segment()
                    seq += 1
                    ids, docs, sizes, n = [], [], [], 0
        if docs:
            yield segment()

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Write the file set of all documents to ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(lean(_segments(tokenizer)), SCHEMA).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            ids = rangecoder.decode(row.column("data")[0].as_py())
            sizes = np.array(row.column("n_tokens")[0].as_py(), np.int64)
            if sizes.sum() != len(ids):
                raise rangecoder.Damaged("the documents' sizes do not add up to the segment")
            first = row.column("before")[0].as_py()
            starts = np.cumsum(sizes) - sizes
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(starts.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [row.column("doc_ids")[0].values, pa.array(starts + first), pa.array(sizes), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the number of ids before each."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    sizes = segments.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("part_n"))  # one row a task of the write
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier(Window.orderBy("part"), "part_n").alias("part_before"))
    inside = sizes.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq"), "n").alias("seq_before"))
    at = inside.join(parts, "part").select("part", "seq", (F.col("part_before") + F.col("seq_before")).alias("before"))
    return segments.join(at, ["part", "seq"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in a file set, from its decoded ids."""
    placed = _placed(spark, path).select("doc_ids", "n_tokens", "data", "before")
    return placed.mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (with the end id) of every document in a file set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                found = rangecoder.decode(row.column("data")[0].as_py()).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(row.column("n_tokens")[0].as_py()))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([row.column("doc_ids")[0].values, pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], ["doc_id", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).select("doc_ids", "n_tokens", "data").mapInArrow(lean(run), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the documents and read them back."""
    path = path or scratch(docs.sparkSession, "token-files")
    write(docs, path, tokenizer=tokenizer)
    return read(docs.sparkSession, path)
