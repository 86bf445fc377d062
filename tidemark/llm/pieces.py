"""SentencePiece encoding and decoding, with sampled segmentations.

``encode`` and ``decode`` are the library's own. ``sample`` draws, for every text, k
different segmentations without replacement from the vocabulary's lattice (see lattice):
exact Gumbel top-k, seeded by the row's key, so a row gets the same samples whatever the
partitioning. Each sample has its log-probability, its perturbed value and its inclusion
probability 1 - exp(-exp(logp - bound)), bound being the maximum of all that was not taken;
weighting a sample by p / inclusion gives unbiased estimates.

Defined results: null and empty texts have no pieces and one sample, the empty one, of
probability 1; a text with fewer than k segmentations gets them all, with inclusion 1;
a null key counts as 0; repeated rows get equal samples, or, numbered as copies, samples of their
own; an empty table gives an empty result; long texts are worked on whole. Only key and text are read. A literal U+2581 in a text reads back as a space, as in the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lattice
from tidemark.llm.common import lean

SAMPLES = 2
_loaded: dict = {}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _tools(path: str | None, theta: float, cache: int = lattice.CACHE):
    """The processor and the lattices, loaded once a worker."""
    if (path, theta, cache) not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        n = sp.vocab_size()
        vocab = lattice.Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], theta)
        _loaded[path, theta, cache] = sp, lattice.Lattices(vocab, cache)
    return _loaded[path, theta, cache]


def decode_ids(ids: list[int], vocab: lattice.Vocabulary) -> str:
    """Text of a list of ids: bytes of the pieces without the first space."""
    raw = b"".join(map(vocab.bytes.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    at, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        texts.append(_text(t))
        size += len(texts[-1])
        if size >= lattice.CHUNK:
            yield batch.slice(at, len(texts)), texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield batch.slice(at, len(texts)), texts


def sample_texts(texts: list[str], keys: np.ndarray, k: int, path: str | None = None, theta: float = 1.0, cache: int = lattice.CACHE) -> list[list[dict]]:
    _, lattices = _tools(path, theta, cache)
    s = lattice.Sampler(lattices, texts, keys)
    paths, bound = s.top(k)
    chars = np.frombuffer("".join(lattice.SPACE + t.replace(" ", lattice.SPACE) for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    out: list[list[dict]] = [[] for _ in texts]
    for p in paths:
        ids, at = s.ids(p, chars)
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(p.logp - bound))
        for i in np.flatnonzero(np.isfinite(p.gumbel)).tolist():
            out[i].append({"ids": ids[at[i] : at[i + 1]], "logp": float(p.logp[i]), "gumbel": float(p.gumbel[i]), "inclusion": float(inclusion[i])})
    return out


def _arrow(found: list[list[dict]]) -> pa.ListArray:
    flat = [s for f in found for s in f]
    ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    ids = pa.ListArray.from_arrays(ends([len(s["ids"]) for s in flat]), pa.array(np.concatenate([s["ids"] for s in flat]) if flat else [], pa.int32()))
    numbers = [pa.array([s[key] for s in flat], pa.float64()) for key in ("logp", "gumbel", "inclusion")]
    return pa.ListArray.from_arrays(ends([len(f) for f in found]), pa.StructArray.from_arrays([ids, *numbers], ["ids", "logp", "gumbel", "inclusion"]))


_COPY = np.uint64(0xC2B2AE3D27D4EB4F)


def _sampler(k: int, path: str | None, theta: float, use: Callable | None, cache: int = lattice.CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _runs(batch):
                keys = np.array([x or 0 for x in rows.column(0).to_pylist()], np.int64).view(np.uint64)
                keys ^= np.array(rows.column(2).to_pylist(), np.int64).view(np.uint64) * _COPY
                found = sample_texts(texts, keys, k, path, theta, cache)
                if use is None:
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), _arrow(found)], ["doc_id", "copy", "samples"])
                else:
                    yield use(rows, texts, found, _tools(path, theta, cache)[1].vocab)

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("copy"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Number equal rows from 0. They are counted as they are met, so of copies that lie together one text is shuffled."""
    counted = rows.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    return counted.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


def sample(
    docs: DataFrame, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, theta: float = 1.0, copies: bool = False,
    cache: int = lattice.CACHE,
) -> DataFrame:
    """doc_id, copy and samples (ids, logp, gumbel, inclusion), best first: one row for each row.

    One scan without a shuffle; ``copies`` numbers rows equal in id and text (else 0) and gives
    each number samples of its own, at the price of a shuffle. ``cache`` is the number of lattice
    nodes that a worker keeps; results do not depend on it.
    """
    schema = "doc_id long, copy long, samples array<struct<ids: array<int>, logp: double, gumbel: double, inclusion: double>>"
    rows = _rows(docs, id_col, text_col)
    return (_numbered(rows) if copies else rows).mapInArrow(lean(_sampler(k, path, theta, None, cache)), schema)


def sample_digests(docs: DataFrame, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, theta: float = 1.0) -> DataFrame:
    """doc_id, n_samples, n_ids (of each sample), ids_crc32, logp, gumbel, inclusion, distinct, round_trip (every sample decodes to the text)."""
    return _rows(docs, id_col, text_col).mapInArrow(
        lean(_sampler(k, path, theta, _digest)),
        "doc_id long, n_samples int, n_ids array<long>, ids_crc32 array<long>, logp array<double>, gumbel array<double>, inclusion array<double>, distinct boolean, round_trip boolean",
    )


def _digest(rows: pa.RecordBatch, texts: list[str], found: list[list[dict]], vocab: lattice.Vocabulary) -> pa.RecordBatch:
    import zlib

    raw = [[s["ids"].astype("<u4").tobytes() for s in f] for f in found]
    whole = [all(decode_ids(s["ids"].tolist(), vocab) == t.replace(lattice.SPACE, " ") for s in f) for f, t in zip(found, texts)]
    numbers = lambda key: pa.array([[s[key] for s in f] for f in found], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([[len(s["ids"]) for s in f] for f in found], pa.list_(pa.int64())),
            pa.array([[zlib.crc32(x) for x in f] for f in raw], pa.list_(pa.int64())), numbers("logp"), numbers("gumbel"), numbers("inclusion"),
            pa.array([len(set(f)) == len(f) for f in raw]), pa.array(whole),
        ],
        ["doc_id", "n_samples", "n_ids", "ids_crc32", "logp", "gumbel", "inclusion", "distinct", "round_trip"],
    )


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids, the library's own encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _runs(batch):
                ids = _tools(path, 1.0)[0].encode(texts, num_threads=1)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and text of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _tools(path, 1.0)[0].decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
