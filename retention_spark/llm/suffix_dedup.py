"""Substring deduplication with enhanced suffix arrays.

Every string of LENGTH bytes is filed under its anchor, the least of the hashes of its GRAM-byte
substrings, so equal strings have equal anchors wherever they stand. Neighbouring strings
mostly share one; they make a stretch of at most 2 * LENGTH - GRAM bytes, and there is
about one for 15 bytes of text. Suffixes never have to be moved one by one:

1. anchors are counted; those in one document only can't be part of a repeat and go no further;
2. equal stretches of the others are combined, with the smallest doc_id that has them. A stretch
   whose anchor has no other stretch goes on without a shuffle;
3. the different stretches of an anchor meet in a task. Their suffixes, sorted, with the lengths of
   common prefixes of neighbours (an enhanced suffix array), give the tree of common-prefix
   intervals. An interval of at least LENGTH bytes is a group of repeats with all its occurrences; it is
   maximal if the bytes before them differ. The least document of a group is brought up the tree to
   the outermost interval, which holds every place of its first LENGTH bytes, and down to its suffixes;
4. each document learns which of its stretches have strings that stand in an earlier one.

`maximal_repeats` gives the groups as such: whole maximal repeats of any length, with every document and
place. A string of LENGTH bytes that begins one stands after different bytes, or where a text begins;
only from such strings on texts are sorted, as far as several documents share them.

Documents with equal texts are combined beforehand. An anchor with more than GROUP_LIMIT different stretches
is dealt anew by whole strings, whose equals combine before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, flat_bytes, if_small, save, save_by_key, text_slices
from .words import mix

LENGTH, GRAM = 50, 24
#: Different stretches of one anchor that a task sorts.
GROUP_LIMIT = 50_000
#: Suffixes that one array holds, but for a larger group.
ARRAY = 200_000
#: Bytes of text hashed at once: arrays so small come from the heap and stay in the cache (five
#: times as fast as arrays of a megabyte).
BLOCK = 1 << 14
#: Text in a bucket of the table that keeps the texts by document.
BUCKET_BYTES = 32 << 20

_SPAN = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15


def _later(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[: max(0, len(values) - by)] = values[by:]
    return out


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hash of the `width` bytes from each place on (places near the end are of no use)."""
    power, size, length, rolled = data.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        if width & size:
            if rolled is None:
                rolled = power
            else:
                rolled = rolled * np.uint64(pow(_BASE, size, 2**64)) + _later(power, length)
            length += size
        if size * 2 > width:
            return mix(rolled)
        power = power * np.uint64(pow(_BASE, size, 2**64)) + _later(power, size)
        size *= 2


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place on (of no use near the end)."""
    span = 1
    while span < width:
        step = min(span, width - span)
        least = values.copy()
        np.minimum(values[:-step], values[step:], out=least[:-step])
        values, span = least, span + step
    return values


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every stretch its text's number, its anchor, where it begins, and how many strings of
    LENGTH bytes begin in it."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64),
              np.zeros(0, np.int64))]
    for text, low, bounds in _blocks(offsets):
        own, anchor, first, count = _block_stretches(data[low : low + bounds[-1]], bounds)
        found.append((own + text, anchor, first + low, count))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts in blocks of about BLOCK bytes: (first text, its begin, bounds from there). A longer
    text is cut at fixed places, and the parts overlap by LENGTH - 1 bytes."""
    at, texts = 0, len(offsets) - 1
    while at < texts:
        low = int(offsets[at])
        until = max(at + 1, int(np.searchsorted(offsets, low + BLOCK, "right")) - 1)
        size = int(offsets[until]) - low
        if size <= BLOCK:
            yield at, low, offsets[at : until + 1] - low
        else:
            for cut in range(0, size, BLOCK):
                yield at, low + cut, np.array([0, min(BLOCK + LENGTH - 1, size - cut)])
        at = until


def _block_stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    if len(data) < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, empty
    least = _sliding_least(gram_hashes(data), _SPAN)
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = offsets[1:] - LENGTH + 1  # no string begins in a text from here on
    for low, high in zip(np.maximum(last, offsets[:-1]).tolist(), offsets[1:].tolist(), strict=True):
        new[low:high] = False
    first = np.flatnonzero(new)
    text = np.searchsorted(offsets, first, "right") - 1
    count = np.minimum(np.append(first[1:], len(data)), last[text]) - first
    if len(count) and count.max() > _SPAN:  # texts that repeat themselves
        parts = -(-count // _SPAN)
        of = np.repeat(np.arange(len(first)), parts)
        skip = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * _SPAN
        first, text, count = first[of] + skip, text[of], np.minimum(count[of] - skip, _SPAN)
    return text, least[first], first, count


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor of each document once."""
    for piece in text_slices(batches, "text"):
        text, anchor, _, _ = stretches(*flat_bytes(piece.column("text")))
        order = np.lexsort((anchor, text))
        text, anchor = text[order], anchor[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
        ids = piece.column("doc_id").take(pa.array(text[new]))
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "anchor": anchor[new].view(np.int64)})


def _keys(raw: bytes, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each stretch; with the anchor it names the stretch."""
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter(
        (digest(view[b : b + n + LENGTH - 1]) for b, n in
         zip(begins.tolist(), counts.tolist(), strict=True)), np.uint64, len(begins)
    ).view(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text, anchors): where the text's stretches under these anchors begin."""
    yield from _shared_stretches(batches, contents=False)


def _shared_stretches(batches: Iterator[pa.RecordBatch], contents: bool = True
                      ) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, anchors): the document's stretches under these anchors, by place, with
    their contents or where they begin."""
    for piece in text_slices(batches, "text"):
        data, offsets = flat_bytes(piece.column("text"))
        text, anchor, begin, count = stretches(data, offsets)
        raw, first = data.tobytes(), np.searchsorted(text, np.arange(piece.num_rows + 1))
        sought = np.zeros(len(text), bool)
        for i, known in enumerate(piece.column("anchors")):
            low, high = first[i], first[i + 1]
            sought[low:high] = np.isin(anchor[low:high].view(np.int64), known.values.to_numpy())
        at = np.flatnonzero(sought)
        key = _keys(raw, begin[at], count[at])
        if not contents:
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id").take(pa.array(text[at])),
                "part": piece.column("part").take(pa.array(text[at])),
                "anchor": anchor[at].view(np.int64), "key": key,
                "begin": begin[at] - offsets[text[at]]})
            continue
        before = [raw[b - 1] if b > offsets[t] else -1
                  for t, b in zip(text[at].tolist(), begin[at].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id").take(pa.array(text[at])),
            "anchor": anchor[at].view(np.int64), "key": key,
            "bytes": pa.array([raw[b : b + n + LENGTH - 1] for b, n in zip(
                begin[at].tolist(), count[at].tolist(), strict=True)], pa.binary()),
            "before": pa.array(before, pa.int32())})


def enhanced_suffix_array(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The suffixes of at least LENGTH bytes of all texts in order: (text, place, length), and
    the length of the prefix that each has in common with the one before."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    counts = np.maximum(sizes - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = sizes[text] - place
    # A shorter one stands first among those that zeros at the end would make equal.
    order = np.argsort(length, kind="stable")
    text, place, length = text[order], place[order], length[order]
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(flat, width)[starts[text] + place]
    rows[np.arange(width) >= length[:, None]] = 0
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    text, place, length, rows = text[order], place[order], length[order], rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(length[1:], length[:-1]))
    return text, place, length, np.concatenate(([0], common))


def outermost(common: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """First and last (columns) of the intervals that no other of at least `least` is around."""
    inside = np.concatenate((common >= least, [False]))
    edge = np.diff(inside.astype(np.int8))
    return np.column_stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))


def interval_tree(common: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The tree of all common-prefix intervals of a suffix array: (prefix length, first, last, parent or
    -1) of each, outer ones first; and the innermost one around each suffix, or -1. It is built level by
    level, of which stretches have few."""
    inner, nodes, size = np.full(len(common), -1), [np.zeros((0, 4), np.int64)], 0
    padded = np.append(common, 0)
    for depth in np.unique(common[common >= least]).tolist():
        runs = outermost(common, depth)
        own = np.minimum.reduceat(padded, (runs + 1).ravel())[::2] == depth  # others lie deeper only
        low, high = runs[own].T
        nodes.append(np.column_stack((np.full(len(low), depth), low, high, inner[low])))
        wide = high - low + 1
        at = np.arange(wide.sum()) + np.repeat(low - (np.cumsum(wide) - wide), wide)
        inner[at] = np.repeat(np.arange(size, size + len(low)), wide)
        size += len(low)
    return (*np.concatenate(nodes).T, inner)


def first_owners(tree: tuple[np.ndarray, ...], owner: np.ndarray) -> np.ndarray:
    """For each suffix the least owner under the outermost interval around it, or its own: owners are
    brought up the tree from suffix to interval to parent, and down again."""
    depth, _, _, parent, inner = tree
    inside, found = inner >= 0, owner.copy()
    if not len(depth):
        return found
    least = np.full(len(depth), np.iinfo(np.int64).max)
    np.minimum.at(least, inner[inside], owner[inside])
    levels = np.flatnonzero(np.diff(depth, prepend=-1, append=-1))
    spans = [slice(a, b) for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True)]
    for level in reversed(spans):
        below = parent[level] >= 0
        np.minimum.at(least, parent[level][below], least[level][below])
    for level in spans:
        up = parent[level]
        least[level] = np.where(up >= 0, least[up], least[level])
    found[inside] = least[inner[inside]]
    return found


def intervals(common: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """All common-prefix intervals of a suffix array, inner ones first: (prefix length, first,
    last), by a stack over each outermost one."""
    for low, high in outermost(common, least).tolist():
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*common[low + 1 : high + 1].tolist(), 0], low + 1):
            begin = i - 1
            while stack and stack[-1][0] > depth:
                deep, begin = stack.pop()
                yield deep, begin, i - 1
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


def _settle(rows: list[tuple], with_groups: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, key, bytes, first, last, low, high) of whole anchors: for each stretch, runs
    of strings and the first document of each, where that is not its last one too; and the maximal
    repeats with their occurrences, if wanted."""
    anchor, key, texts, owner, last, low, high = zip(*rows, strict=True)
    text, place, _, common = enhanced_suffix_array(list(texts))
    owner, anchor, key = np.array(owner)[text], np.array(anchor), np.array(key)
    tree = interval_tree(common)
    first = first_owners(tree, owner)
    repeats = []
    if with_groups:
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        left = np.frombuffer(b"".join(texts), np.uint8)[np.maximum(starts[text] + place - 1, 0)]
        low, high = (np.where(place > 0, left, np.array(x)[text]) for x in (low, high))
        repeats = [(text[a], place[a], depth, a, b) for depth, a, b in np.column_stack(tree[:3]).tolist()
                   if low[a : b + 1].min() != high[a : b + 1].max()]  # left-extension diversity
    if repeats:
        members = [np.arange(a, b + 1) for *_, a, b in repeats]
        bounds = np.cumsum([0, *map(len, members)]).astype(np.int32)
        flat = np.concatenate(members)
        of = pa.StructArray.from_arrays(
            [pa.array(anchor[text[flat]]), pa.array(key[text[flat]]),
             pa.array(place[flat].astype(np.int32))], ["anchor", "key", "at"])
        none = pa.nulls(len(repeats))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64())] * 2 + [none.cast(pa.int32())] * 2 + [
                none.cast(pa.int64()),
                pa.array([texts[t][p : p + n] for t, p, n, _, _ in repeats], pa.binary()),
                pa.ListArray.from_arrays(pa.array(bounds), of)], schema=_SETTLED)
    back = np.lexsort((place, text))
    text, place, first = text[back], place[back], first[back]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (first[1:] != first[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) - 1
    of_use = first[begin] < np.array(last)[text[begin]]
    begin, end = begin[of_use], end[of_use]
    none = pa.nulls(len(begin))
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchor[text[begin]]), pa.array(key[text[begin]]),
         pa.array(place[begin].astype(np.int32)), pa.array((place[end] + 1).astype(np.int32)),
         pa.array(first[begin]), none.cast(pa.binary()), none.cast(_OCCURRENCES)], schema=_SETTLED)


_OCCURRENCES = pa.list_(pa.struct([("anchor", pa.int64()), ("key", pa.int64()),
                                   ("at", pa.int32())]))
_SETTLED = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("at", pa.int32()),
                      ("until", pa.int32()), ("first", pa.int64()), ("repeat", pa.binary()),
                      ("occurrences", _OCCURRENCES)])


def _scan_groups(batches: Iterator[pa.RecordBatch], groups: bool = True
                 ) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor, several anchors to an array."""
    rows, held, current = [], 0, None
    for batch in batches:
        names = ("anchor", "key", "bytes", "first", "last", "low", "high")
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if row[0] != current and held >= ARRAY:
                yield from _settle(rows, groups)
                rows, held = [], 0
            current = row[0]
            rows.append(row)
            held += len(row[2]) - LENGTH + 1
    if rows:
        yield from _settle(rows, groups)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of LENGTH bytes of each stretch, one by one."""
    for batch in batches:
        for low in range(0, batch.num_rows, 5000):
            part = batch.slice(low, 5000)
            columns: dict[str, list] = {n: [] for n in ("anchor", "key", "at", "string", "first")}
            for anchor, key, data, first in zip(*(part.column(n).to_pylist() for n in (
                    "anchor", "key", "bytes", "first")), strict=True):
                for at in range(len(data) - LENGTH + 1):
                    for name, value in zip(columns, (anchor, key, at, data[at : at + LENGTH],
                                                     first), strict=True):
                        columns[name].append(value)
            yield pa.RecordBatch.from_pydict(
                {"anchor": pa.array(columns["anchor"], pa.int64()),
                 "key": pa.array(columns["key"], pa.int64()),
                 "at": pa.array(columns["at"], pa.int32()),
                 "string": pa.array(columns["string"], pa.binary()),
                 "first": pa.array(columns["first"], pa.int64())})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text, runs: where strings begin in a part, from .. until - 1): cover
    these strings, and digest what is left."""
    for piece in text_slices(batches, "text"):
        data, offsets = flat_bytes(piece.column("text"))
        raw, spans_of, removed, digests = data.tobytes(), [], [], []
        runs_of = piece.column("runs")
        for i in range(piece.num_rows):
            runs = runs_of[i].values
            mine = runs.field("part").to_numpy() == piece.column("part")[i].as_py()
            first, until = (runs.field(n).to_numpy()[mine] for n in ("from", "until"))
            order = np.argsort(first, kind="stable")
            covered = zip((first[order] + offsets[i]).tolist(),
                          (until[order] + (offsets[i] - 1 + LENGTH)).tolist(), strict=True)
            low, high = int(offsets[i]), int(offsets[i + 1])
            spans, kept, done = [], hashlib.sha256(), low
            for a, b in covered:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                kept.update(raw[done:a])
                done = b
            kept.update(raw[done:high])
            spans_of.append([{"begin": a - low, "end": b - low} for a, b in spans])
            removed.append(sum(b - a for a, b in spans))
            digests.append(kept.hexdigest())
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id"), "sha": piece.column("sha"),
            "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans_of, span),
            "kept_sha256": pa.array(digests, pa.string())})


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                       F.sha2(text, 256).alias("sha"))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, sha, n_bytes, first: smallest doc_id of its text), and (doc_id, text,
    sha) without those that only copy another's text or can't hold a repeat."""
    texts = _texts(docs)
    rows = save(texts.select("doc_id", "sha", F.octet_length("text").cast("bigint").alias(
        "n_bytes")), "suffix-rows")
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("first"))
    placed = save(rows.join(firsts, "sha"), "suffix-placed")
    copies = save(placed.filter("doc_id > first").select("doc_id", "sha").distinct(),
                  "suffix-copies")
    able = texts.filter("doc_id is not null").filter(F.octet_length("text") >= LENGTH)
    kept = able.join(if_small(copies, width=80), ["doc_id", "sha"], "left_anti")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return placed, save_by_key(kept, "doc_id", max(1, -(-total // BUCKET_BYTES)), "suffix-texts")


def shared_anchors(texts: DataFrame) -> DataFrame:
    """(doc_id, anchors): the anchors of each document that other documents have too."""
    own = save(texts.select("doc_id", "text").mapInArrow(_anchors, "doc_id bigint, anchor bigint"),
               "suffix-own")
    shared = save(own.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "anchor"), "suffix-anchors")
    known = save(own.join(shared, "anchor").groupBy("doc_id").agg(
        F.collect_list("anchor").alias("anchors")), "suffix-known")
    discard(own)
    discard(shared)
    return known


def shared_stretches(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, anchor, key, bytes, before) of the stretches under these anchors."""
    return texts.select("doc_id", "text").join(known, "doc_id").mapInArrow(
        _shared_stretches, "doc_id bigint, anchor bigint, key bigint, bytes binary, before int")


def first_documents(stretch: DataFrame, groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """(anchor, key, at, until, first): the strings at .. until - 1 of a stretch first stand in
    document `first`, and the stretch in a later one; and the maximal repeats (repeat, occurrences: stretches and places in them)
    among different stretches of an anchor, as long as their common context, where `groups` are wanted;
    `stretch` has the documents of each."""
    combined = save(stretch.groupBy("anchor", "key").agg(
        F.first("bytes").alias("bytes"), F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"), F.min("before").alias("low"), F.max("before").alias("high")), "suffix-stretches")
    counted = save(combined.groupBy("anchor").agg(F.count(F.lit(1)).alias("held")).filter(
        "held > 1"), "suffix-groups")
    several = if_small(counted.select("anchor"))
    settled_columns = "anchor bigint, key bigint, at int, until int, first bigint, repeat binary," \
        " occurrences array<struct<anchor: bigint, key: bigint, at: int>>"
    # These need no shuffle: each is all that its anchor has.
    alone = combined.filter("first < last").join(several, "anchor", "left_anti").mapInArrow(
        lambda batches: _scan_groups(batches, False), settled_columns).drop("repeat", "occurrences")
    large = counted.filter(F.col("held") > GROUP_LIMIT).select("anchor")
    sorted_here = combined.join(several, "anchor", "left_semi").join(
        if_small(large), "anchor", "left_anti")
    settled = save(sorted_here.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda batches: _scan_groups(batches, groups), settled_columns), "suffix-settled")
    places = combined.join(if_small(large), "anchor", "left_semi").mapInArrow(
        _strings, "anchor bigint, key bigint, at int, string binary, first bigint")
    firsts = places.groupBy("string").agg(F.min("first").alias("first"))
    ends = combined.select("anchor", "key", "last")
    dealt = places.drop("first").join(firsts, "string").join(ends, ["anchor", "key"]).filter(
        "first < last").select(
        "anchor", "key", "at", (F.col("at") + 1).alias("until"), "first")
    runs = alone.unionByName(settled.filter("first is not null").drop("repeat", "occurrences"))
    if not large.isEmpty():
        runs = runs.unionByName(dealt)
    return runs, settled.filter("repeat is not null").select("repeat", "occurrences")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, sha, text, marks): where repeats may begin, the byte before (-1 at the begin of a
    text), and the text from there on as far as its strings stand in several documents."""
    for piece in text_slices(batches, "text"):
        data, offsets = flat_bytes(piece.column("text"))
        _, anchor, begin, count = stretches(data, offsets)
        raw, key = data.tobytes(), _keys(data.tobytes(), begin, count)
        first = np.searchsorted(begin, offsets)
        columns: dict[str, list] = {n: [] for n in ("row", "begin", "before", "suffix")}
        for i, marks in enumerate(piece.column("marks").to_pylist()):
            known = {(m["anchor"], m["key"]): (m["shared"], m["heads"]) for m in marks}
            low, high = int(offsets[i]), int(offsets[i + 1])
            here = slice(first[i], first[i + 1])
            shared, heads = np.zeros(high - low + 1, bool), []
            for a, k, b, n in zip(anchor[here].view(np.int64).tolist(), key[here].tolist(),
                                  begin[here].tolist(), count[here].tolist(), strict=True):
                of_shared, of_heads = known.get((a, k), (0, 0))
                for at in range(n):
                    shared[b - low + at] = of_shared >> at & 1
                    if of_heads >> at & 1:
                        heads.append(b - low + at)
            gaps = np.flatnonzero(~shared)
            for at, gap in zip(heads, gaps[np.searchsorted(gaps, heads)].tolist(), strict=True):
                columns["row"].append(i)
                columns["begin"].append(at)
                columns["before"].append(raw[low + at - 1] if at else -1)
                columns["suffix"].append(raw[low + at : low + gap - 1 + LENGTH])
        row = pa.array(columns["row"], pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": piece.column("doc_id").take(row), "sha": piece.column("sha").take(row),
            "begin": pa.array(columns["begin"], pa.int64()),
            "before": pa.array(columns["before"], pa.int32()),
            "suffix": pa.array(columns["suffix"], pa.binary())})


def _common(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)
    return int(differ.argmax()) if differ.any() else size


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (suffix, first, last, low, high), different and in order: (repeat, n_bytes, suffix), the
    suffixes that begin with each maximal repeat."""
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        suffix, first, last, low, high = zip(*rows, strict=True)
        common = np.array([0, *map(_common, suffix[:-1], suffix[1:])])
        nodes = list(intervals(common))
        after = np.append(common[1:], 0)
        nodes += [(len(x), i, i) for i, x in enumerate(suffix)  # whole suffixes that nothing goes on from
                  if max(common[i], after[i]) < len(x)]
        out: list[tuple] = []
        for depth, a, b in nodes:
            part = slice(a, b + 1)
            lowest = min(low[part])
            if min(first[part]) < max(last[part]) and (lowest < 0 or lowest < max(high[part])):
                name = hashlib.sha256(suffix[a][:depth]).hexdigest()
                out += [(name, depth, hashlib.sha256(x).hexdigest()) for x in suffix[part]]
        names, sizes, members = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_pydict({
            "repeat": pa.array(names, pa.string()), "n_bytes": pa.array(sizes, pa.int64()),
            "suffix_sha": pa.array(members, pa.string())})

    rows: list[tuple] = []
    for batch in batches:
        names = ("suffix", "first", "last", "low", "high")
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if rows and rows[-1][0][:LENGTH] != row[0][:LENGTH]:
                yield settle(rows)
                rows = []
            rows.append(row)
    if rows:
        yield settle(rows)


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """One row per occurrence of each maximal repeat: repeat (sha256 of its bytes), n_bytes, doc_id,
    text_sha256 and begin in bytes.

    A repeat is a string of at least LENGTH bytes in at least two documents, whose occurrences in all texts
    don't all go on with the same byte on one side. Every occurrence counts, several in one document and
    those in copies of a text too. Text counts as UTF-8, null as empty; rows that repeat a doc_id are one
    document, rows without doc_id don't count. Of a text with a period the rows grow with the square of its length.
    """
    able = _texts(docs).filter("doc_id is not null").filter(F.octet_length("text") >= LENGTH)
    texts = save(able.dropDuplicates(["doc_id", "sha"]), "suffix-all")
    stretch = save(shared_stretches(texts, shared_anchors(texts)), "suffix-stretch")
    combined = save(stretch.groupBy("anchor", "key").agg(
        F.first("bytes").alias("bytes"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.min("before").alias("low"), F.max("before").alias("high")), "suffix-combined")
    places = combined.select("*", F.explode(F.sequence(
        F.lit(0), F.octet_length("bytes") - LENGTH)).alias("at")).withColumn(
        "string", F.expr(f"substring(bytes, at + 1, {LENGTH})")).withColumn(
        "left", F.conv(F.hex(F.expr("substring(bytes, at, 1)")), 16, 10).cast("int"))
    sides = [F.when(F.col("at") == 0, F.col(n)).otherwise(F.col("left")).alias(n)
             for n in ("low", "high")]
    held = places.select("string", "first", "last", *sides).groupBy("string").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("low").alias("low"), F.max("high").alias("high")).filter("first < last").select(
        "string", F.expr("cast(low < 0 or low < high as int)").alias("head"))
    marks = places.select("anchor", "key", "at", "string").join(held, "string").groupBy(
        "anchor", "key").agg(F.expr("sum(shiftleft(1, at))").alias("shared"),
                             F.expr("sum(shiftleft(head, at))").alias("heads"))
    runs = save(stretch.select("doc_id", "anchor", "key").distinct().join(
        marks, ["anchor", "key"]).groupBy("doc_id").agg(F.collect_list(F.struct(
            "anchor", "key", "shared", "heads")).alias("marks")), "suffix-marks")
    found = save(texts.join(runs, "doc_id").mapInArrow(
        _heads, "doc_id bigint, sha string, begin bigint, before int, suffix binary"), "suffix-heads")
    suffixes = found.groupBy("suffix").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.min("before").alias("low"), F.max("before").alias("high"))
    repeats = suffixes.repartition(F.expr(f"substring(suffix, 1, {LENGTH})")).sortWithinPartitions(
        "suffix").mapInArrow(_maximal, "repeat string, n_bytes bigint, suffix_sha string")
    occurrences = found.select(F.sha2("suffix", 256).alias("suffix_sha"), "doc_id",
                               F.col("sha").alias("text_sha256"), "begin")
    return repeats.join(occurrences, "suffix_sha").drop("suffix_sha")


def repeat_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (array of begin, end in bytes), kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
    smaller doc_id; strings are judged on the whole input. Text counts as UTF-8, null as empty.
    Rows that repeat a doc_id are one document. A row without doc_id loses nothing and takes nothing from others.
    An empty table gives no rows; other columns are not looked at.
    """
    placed, texts = distinct_texts(docs)
    known = shared_anchors(texts)
    firsts, _ = first_documents(shared_stretches(texts, known), groups=False)
    # The stretches are taken from the texts once more, for their places: cheaper than keeping them.
    parts = texts.withColumn("part", F.xxhash64("sha"))  # rows with one doc_id may differ in text
    places = parts.drop("sha").join(known, "doc_id").mapInArrow(
        _places, "doc_id bigint, part bigint, anchor bigint, key bigint, begin bigint")
    later = places.join(firsts, ["anchor", "key"]).filter("first < doc_id")
    runs = save(later.groupBy("doc_id").agg(F.collect_list(F.struct(
        "part", (F.col("begin") + F.col("at")).alias("from"),
        (F.col("begin") + F.col("until")).alias("until"))).alias("runs")), "suffix-runs")
    span = "array<struct<begin: bigint, end: bigint>>"
    cut = save(parts.join(runs, "doc_id").mapInArrow(
        _cut_out, f"doc_id bigint, sha string, n_removed bigint, spans {span}, kept_sha256 string"
    ).dropDuplicates(["doc_id", "sha"]), "suffix-cut")
    found = placed.join(cut, ["doc_id", "sha"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n_bytes").alias("end")))
    return found.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))
                                                 ).alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(span))).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias(
            "kept_sha256"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of `repeat_spans`."""
    return repeat_spans(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        "kept_sha256")
