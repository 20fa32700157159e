"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text; where its top bits are zero a chunk ends, so ends depend on
the bytes just before them and an insertion shifts no chunk but its own. Chunks are compared
by a 128-bit digest. The document with the smallest doc_id that holds a chunk keeps it; elsewhere runs of such
chunks are removed. Only digests move, counted before the shuffle, and the digests that two
documents share are joined back, so no group of equal chunks is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import flat_bytes, if_small, save, text_slices

#: A chunk ends with probability 2 to the power of -MASK_BITS a byte, not before LEAST bytes,
#: and at MOST at the latest.
MASK_BITS, LEAST, MOST = 4, 12, 128
#: Shorter runs of removable chunks inside a text stay: a few words meet by chance.
SHORTEST_RUN = 48
#: Bytes that the rolling hash looks back on.
REACH = 32

_GEAR = np.random.default_rng(6).integers(0, 2**32, 256, np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear values of the last REACH bytes, each shifted by its distance."""
    rolled, span = _GEAR[data], 1
    while span < REACH:
        before = np.zeros_like(rolled)
        before[span:] = rolled[:-span]
        rolled, span = rolled + (before << np.uint32(span)), span * 2
    return rolled


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every chunk of the texts that lie one after the other in `data`."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(gear_hash(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    text = np.searchsorted(offsets, ends, "left") - 1
    # The hash knows the text's own bytes only from REACH on, and a new end needs room.
    ends = ends[(ends - offsets[text] >= REACH) & (offsets[text + 1] - ends >= LEAST)]
    ends = ends[np.diff(ends, prepend=-LEAST) >= LEAST]
    marks = np.union1d(ends, offsets)
    gaps = np.diff(marks)
    forced = np.repeat(marks[:-1], gaps // MOST) + MOST * _counts(gaps // MOST)
    marks = np.union1d(marks, forced)
    return marks[:-1], marks[1:]


def _counts(repeats: np.ndarray) -> np.ndarray:
    """1 to n for each n."""
    total = np.cumsum(repeats)
    return np.arange(1, (total[-1] if len(total) else 0) + 1) - np.repeat(total - repeats, repeats)


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of every chunk its text's number, begin, end and digest (two columns); and all bytes."""
    data, offsets = flat_bytes(texts)
    begins, ends = chunk_bounds(data, offsets)
    raw = data.tobytes()
    view, digest = memoryview(raw), hashlib.blake2b
    digests = b"".join(digest(view[a:b], digest_size=16).digest()
                       for a, b in zip(begins.tolist(), ends.tolist(), strict=True))
    owner = np.searchsorted(offsets, begins, "right") - 1
    return owner, begins, ends, np.frombuffer(digests, np.int64).reshape(-1, 2), raw


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different chunk of each document once."""
    for piece in text_slices(batches, "text"):
        owner, _, _, digest, _ = chunks(piece.column("text"))
        order = np.lexsort((digest[:, 1], digest[:, 0], owner))
        key = np.column_stack((owner[order], digest[order]))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        ids = piece.column("doc_id").cast(pa.int64()).take(pa.array(key[new, 0]))
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "a": key[new, 1], "b": key[new, 2]})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, known): remove runs of the chunks whose digests (a) are known."""
    for piece in text_slices(batches, "text"):
        owner, begins, ends, digest, raw = chunks(piece.column("text"))
        first = np.searchsorted(owner, np.arange(piece.num_rows + 1))
        columns: dict[str, list] = {n: [] for n in ("n_removed", "spans", "kept")}
        for i, known in enumerate(piece.column("known")):
            low, high = first[i], first[i + 1]
            gone = np.isin(digest[low:high, 0], known.values.to_numpy())
            spans = runs(begins[low:high], ends[low:high], gone)
            start = begins[low] if high > low else 0
            text = raw[start : ends[high - 1]] if high > low else b""
            spans = [(a - start, b - start) for a, b in spans]
            columns["n_removed"].append(sum(b - a for a, b in spans))
            columns["spans"].append(",".join(f"{a}:{b}" for a, b in spans))
            columns["kept"].append(remaining(text, spans))
        yield pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id").cast(pa.int64()),
            "n_removed": pa.array(columns["n_removed"], pa.int64()),
            "spans": pa.array(columns["spans"], pa.string()),
            "kept": pa.array(columns["kept"], pa.binary())})


def runs(begins: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of neighbouring chunks that go, of at least SHORTEST_RUN bytes or the whole text."""
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    pairs = zip(begins[np.flatnonzero(edge == 1)].tolist(),
                ends[np.flatnonzero(edge == -1) - 1].tolist(), strict=True)
    return [(a, b) for a, b in pairs if b - a >= SHORTEST_RUN or gone.all()]


def remaining(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for begin, end in spans:
        kept.append(text[at:begin])
        at = end
    return b"".join([*kept, text[at:]])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, known): the first halves of digests of chunks of the document that also occur in
    one with a smaller doc_id."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(
        "doc_id is not null").mapInArrow(_digests, "doc_id bigint, a bigint, b bigint")
    held = own.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = save(held.filter("first < last").select("a", "b", "first"), "chunk-shared")
    later = own.join(if_small(shared), ["a", "b"]).filter("first < doc_id")
    return later.groupBy("doc_id").agg(F.collect_set("a").alias("known"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, spans, kept) of the documents that hold a repeated chunk: what goes, as byte
    ranges begin:end, and the bytes that stay."""
    known = save(repeated_chunks(docs), "chunk-known")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.join(known, "doc_id").mapInArrow(
        _cut_out, "doc_id bigint, n_removed bigint, spans string, kept binary")


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (byte ranges begin:end, comma-joined) and
    kept_sha256 of the remaining bytes.

    Text counts as UTF-8, null as empty. The document with the smallest doc_id keeps a chunk,
    and repeats within one document stay. Rows that repeat a doc_id are one document; a row
    without doc_id loses nothing and takes nothing from others. An empty table gives no rows; other columns are not
    looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.octet_length(text).cast("bigint").alias("n_bytes"),
                       F.sha2(text, 256).alias("whole"))
    cut = without_repeats(docs).filter("n_removed > 0").select(
        F.col("doc_id").alias("cut_id"), "n_removed", "spans", F.sha2("kept", 256).alias("left"),
        (F.octet_length("kept") + F.col("n_removed")).alias("cut_bytes"))
    # Rows of one doc_id may differ in text, and then in length or not at all in what is cut.
    cut = save(cut, "chunk-cut").distinct()
    same = (rows.doc_id == cut.cut_id) & (rows.n_bytes == cut.cut_bytes)
    return rows.join(cut, same, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("left", "whole").alias("kept_sha256"))
