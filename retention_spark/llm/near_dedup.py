"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document is its set of distinct word shingles. Its signature is CHUNKS * SLOTS min-hashes cut
to 16 bits. Two signatures at a Hamming distance (in slots) of at most CHUNKS * (ERRORS + 1) - 1
have, by the pigeonhole principle, a chunk with at most ERRORS differing slots; every chunk is
filed under all choices of the slots that may differ, so any such pair meets under a key. Documents at
similarity 0.75 meet with a probability of all but 8e-7, and those above more surely.

Texts with equal sets are one node from the start. Nothing lists all pairs of a key's documents:

1. each is compared with the smallest node of its keys; links are confirmed on full sets;
2. only keys whose documents are still in different components are looked at again, each set
   of documents once. A task gets the full sets of one such group, large groups as pairs of
   bounded blocks, and reports a link only where it connects what is not yet connected. An exact
   prefix filter (rare shingles first) leaves few pairs to compare, so no link is lost there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import smallest_reachable
from .shared import if_small, save, text_slices

SHINGLE = 5
#: Documents are linked at 100 * intersection >= PERCENT * union.
PERCENT = 75
CHUNKS, SLOTS, ERRORS = 14, 5, 1
#: Members of a group, or shingles of them, that one block of a second look holds.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 20

_MASKS = np.random.default_rng(10).integers(1, 2**63, (3, CHUNKS * SLOTS), np.uint64) | np.uint64(1)
_KEPT = list(combinations(range(SLOTS), SLOTS - ERRORS))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    found = words.split(texts)
    hashed = words.hashes(found.distinct)[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    rolled = np.zeros(len(hashed), np.uint64)
    for step in range(width):  # a shingle's hash stands where it begins
        shifted = np.zeros_like(hashed)
        shifted[: len(hashed) - step] = hashed[step:]
        rolled = words.mix(rolled + shifted + np.uint64(step))
    sets, bounds = [], [0]
    for low, high in zip(found.first[:-1], found.first[1:], strict=True):
        if high - low >= width:
            sets.append(np.unique(rolled[low : high - width + 1]))
        elif high > low:  # a short text is one shingle; its length keeps it apart from others
            short = np.array([high - low], np.uint64)
            for h in hashed[low:high]:
                short = words.mix(short + h)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
        bounds.append(bounds[-1] + len(sets[-1]))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(bounds)


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of CHUNKS * SLOTS 16-bit min-hashes; no set may be empty."""
    out = np.empty((len(bounds) - 1, CHUNKS * SLOTS), np.uint16)
    for slot in range(CHUNKS * SLOTS):
        scrambled = (shingles ^ _MASKS[0, slot]) * _MASKS[1, slot]
        scrambled ^= scrambled >> np.uint64(32)
        least = np.minimum.reduceat(scrambled * _MASKS[2, slot], bounds[:-1])
        out[:, slot] = words.mix(least) >> np.uint64(48)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text"):
        shingles, bounds = shingle_sets(piece.column("text"))
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        digests = np.zeros((2, len(sizes)), np.int64)
        marks: list[bytes | None] = [None] * len(sizes)
        if len(full):
            starts = bounds[:-1][full]
            # Two sums over well mixed hashes tell sets apart like a 128-bit hash.
            for row, salt in enumerate((np.uint64(0x51ED), np.uint64(0xC0FFEE))):
                digests[row, full] = np.add.reduceat(
                    words.mix(shingles ^ salt), starts).view(np.int64)
            for i, mark in zip(full, signatures(shingles, np.append(starts, bounds[-1])),
                               strict=True):
                marks[i] = mark.tobytes()
        yield pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id").cast(pa.int64()), "n_shingles": sizes.astype(np.int64),
            "set_a": digests[0], "set_b": digests[1], "signature": pa.array(marks, pa.binary())})


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 2000):
            batch = whole.slice(low, 2000)
            marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16)
            marks = marks.reshape(-1, CHUNKS, SLOTS).astype(np.uint64)
            keys = []
            for chunk in range(CHUNKS):
                for turn, kept in enumerate(_KEPT):
                    key = np.full(len(marks), chunk * len(_KEPT) + turn + 1, np.uint64)
                    for slot in kept:
                        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + marks[:, chunk, slot])
                    keys.append(key.view(np.int64))
            nodes = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {"key": np.concatenate(keys), "node": np.tile(nodes, len(keys))})


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text"):
        shingles, bounds = shingle_sets(piece.column("text"))
        yield pa.RecordBatch.from_pydict({
            "node": piece.column("doc_id").cast(pa.int64()),
            "shingles": pa.array([shingles[a:b].tobytes() for a, b in
                                  zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets are linked; both are sorted and not empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                 for x, y in zip(batch.column("set_of_a").to_pylist(),
                                 batch.column("set_of_b").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def connecting_links(sets: list[np.ndarray], labels: list[int], percent: int = PERCENT,
                     sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (positions) that connect members of different components; none is missed.

    Shingles are ordered from rare to common. Linked sets share one among the first
    size - ceil(percent% of size) + 1 of each, so only members that do are compared. With
    `sides`, members of one side aren't compared with each other.
    """
    parent = {label: label for label in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((np.arange(len(often)), often))
    rank = np.empty(len(often), np.int64)
    rank[order] = np.arange(len(often))
    ranked, at = [], 0
    for s in sets:
        ranked.append(np.sort(rank[code[at : at + len(s)]]))
        at += len(s)
    filed: dict[int, list[int]] = {}
    links = []
    for i in sorted(range(len(sets)), key=lambda k: (len(sets[k]), k)):
        size = len(ranked[i])
        prefix = ranked[i][: size - -(-size * percent // 100) + 1].tolist()
        seen = set()
        for token in prefix:
            for j in filed.get(token, ()):
                if j in seen or (sides and sides[i] == sides[j]):
                    continue
                seen.add(j)
                if root(labels[i]) != root(labels[j]) and similar(ranked[i], ranked[j], percent):
                    parent[root(labels[i])] = root(labels[j])
                    links.append((i, j))
        for token in prefix:
            filed.setdefault(token, []).append(i)
    return links


def _second_look(group: pa.Table) -> pa.Table:
    nodes, labels = group.column("node").to_pylist(), group.column("component").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    sides = group.column("side").to_pylist()
    across = sides if len(set(sides)) > 1 else None
    found = connecting_links(sets, labels, sides=across) if len(sets) > 1 else []
    return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()),
                     "b": pa.array([nodes[j] for _, j in found], pa.int64())})


def _blocks(members: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (key, node, component) dealt to tasks (key, left, right): a group within bounds
    is one task, a larger one a task for each pair of its blocks."""
    sized = members.join(groups, "key").join(sizes, "node")
    bulk = sized.groupBy("key").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
    ).alias("blocks"))
    dealt = sized.join(bulk, "key").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).select(
        "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        F.col("block").alias("side"), "node", "component")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are maximal runs of other than white space, A-Z lower-cased; a text with fewer than
    SHINGLE words is one shingle, and one without words, or null, is linked with nothing.
    component_id is the smallest doc_id that links reach, the document's own included; kept marks rows whose
    doc_id it is. Rows that repeat a doc_id are one node. A null doc_id gets the component of its
    equals if any has an id, else null; it is kept only in the latter case. An empty table gives no rows; other
    columns are not looked at.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = save(source.mapInArrow(
        _signed, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary"),
        "near-signatures")
    equal = ["set_a", "set_b", "n_shingles"]
    nodes = save(signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*equal).agg(
        F.min_by("signature", "doc_id").alias("signature"), F.min("doc_id").alias("node")),
        "near-nodes")
    keyed = nodes.select("node", "signature").mapInArrow(_index_keys, "key bigint, node bigint")
    lowest = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    members = save(keyed.join(lowest.filter("low < high"), "key").select("key", "node", "low"),
                   "near-members")
    pairs = save(members.filter("node <> low").select(
        F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "near-pairs")
    sought = save(members.select("node").distinct(), "near-sought")
    sets = save(source.join(if_small(sought), source.doc_id == sought.node, "left_semi").mapInArrow(
        _full_sets, "node bigint, shingles binary"), "near-sets")
    linked = _confirm(pairs, sets)
    # Rows of one doc_id with different texts are one node under several sets.
    first = smallest_reachable(linked)
    named = members.join(first, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("held"), F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.sum(F.xxhash64("node") % 1_000_000_007).alias("mark"),
        F.bit_xor(F.xxhash64("node")).alias("mark_too"))
    # Two members have been compared already; a set of members is looked at under one key.
    groups = mixed.filter("low < high and held > 2").groupBy("held", "mark", "mark_too").agg(
        F.min("key").alias("key")).select("key")
    sizes = nodes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    tasks = _blocks(named, groups, sizes).join(sets, "node")
    more = save(tasks.groupBy("key", "left", "right").applyInArrow(
        _second_look, "a bigint, b bigint"), "near-more-links")
    labels = smallest_reachable(linked.unionByName(more))
    ends = nodes.join(labels, "node", "left").select(
        *equal, F.col("node").alias("low"), F.coalesce("component", "node").alias("component"))
    same = [signed[c] == ends[c] for c in equal]
    rows = signed.join(ends, same, "left").select(
        signed.doc_id, signed.n_shingles, F.coalesce(
            "component", signed.doc_id).alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_of_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_of_b"))
    return save(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "set_of_a", "set_of_b")
                .mapInArrow(_confirmed, "a bigint, b bigint"), "near-links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each component the rows with the
    smallest doc_id. Rows without a doc_id stay, as nothing could name them."""
    drop = save(near_groups(docs).filter("not kept").select(F.col("doc_id").alias("gone_id"))
                .distinct(), "near-dropped")
    return docs.join(if_small(drop), docs.doc_id == drop.gone_id, "left_anti")
