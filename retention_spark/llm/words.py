"""Words of many texts at once: maximal runs of bytes other than space and 0x09-0x0D."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .shared import flat_bytes

#: The same words as a pattern for Spark's regular expressions.
PATTERN = r"[^\x20\x09-\x0D]+"
GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90),
                 np.arange(256) + 32, np.arange(256)).astype(np.uint8)


@dataclass
class Words:
    """`ids` numbers each word into `distinct`; the words of text i are first[i] to first[i + 1]."""

    ids: np.ndarray
    distinct: pa.Array
    first: np.ndarray


def split(texts: pa.Array) -> Words:
    """The words of each text, A-Z lower-cased, in order."""
    data, offsets = flat_bytes(texts)
    data = LOWER[data]
    inside = ~GAP[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    tails = heads[heads > 0] - 1
    ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    array = pa.Array.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = array.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary,
                 np.searchsorted(starts, offsets))


def hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the splitmix finaliser; its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
