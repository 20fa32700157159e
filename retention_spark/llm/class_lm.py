"""Language model scores by Brown class-based n-grams.

Every word has one class; a text's probability is that of its classes, each given the two before, times
that of each word given its class. Classes come from exchange clustering: a word moves to the
class that raises the likelihood of the class bigrams most.

1. Words are counted over all training text (combined by piece of the table before the shuffle).
2. Each word's neighbours are counted over all training text, once, into blocks of words, dealt by the hash
   that is a word's id (another seed is taken if two words share one). A block names neighbours by their rank
   among the LEXICON most frequent words; those of rarer words it has for rarer words only.
3. Exchange proper runs over the CORE most frequent words, whose bigrams fill a table of fixed size;
   all other words are one fixed class there.
4. A step then takes every word to its best class at once, by the classes to its left and right.
   Only the core has classes at first; from the first step on every neighbour counts with its own, those
   of the lexicon, a bounded table that tasks are sent, and those of rarer words, which their block tells
   the blocks of their neighbours. Steps go on until the likelihood of the class bigrams stops
   rising; a step that doesn't raise it is taken back.
5. Texts become sequences of classes. Words beyond the lexicon are looked up by a join.
6. Class trigrams are counted over all training sequences, a table of fixed size, and texts are scored.

Every word counts towards classes, counts and scores, however rare it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .shared import discard, flat_bytes, save, save_by_key, text_slices

CLASSES, CORE, LEXICON = 64, 1000, 200_000
#: The class of the end of a text, that of all words but the core before the first step, and that of
#: words that training text lacks.
END, OTHER, UNKNOWN = CLASSES, CLASSES + 1, CLASSES + 2
SWEEPS = 6
#: Shares of trigrams, bigrams and single classes; what a known word gives up for unknown ones.
SHARES, DISCOUNT = (0.5, 0.35, 0.15), 0.5
SLICE = 4 << 20

_CONTEXTS = CLASSES + 2
#: A cell: twice the neighbour's rank in the lexicon, one more for that to the right; then a count.
_CODE_BITS, _COUNT_BITS = 20, 12
_CODES, _MOST = (1 << _CODE_BITS) - 1, (1 << _COUNT_BITS) - 1
#: Words are dealt to blocks, one for so many words of training text; bytes of cells held before they are summed.
BLOCK, _HELD = 1 << 21, 64 << 20
#: Words of more bytes are hashed one by one.
_LONG = 64
_FAR = np.dtype([("word", "<u8"), ("other", "<u8"), ("side", "u1"), ("n", "<i8")])
_TOLD = np.dtype([("word", "<u8"), ("context", "u1"), ("n", "<i8")])
_OWN = np.dtype([("rank", "<i4"), ("class", "u1")])
#: What a step writes for a block: classes of its rare words, contexts for words of the lexicon and for rare
#: ones, and for the driver the classes of words of the lexicon.
_STATE, _NEAR, _RARE, _LEXICON = range(4)
_KINDS = {_STATE: np.dtype("u1"), _NEAR: np.dtype("<u8"), _RARE: _TOLD}
_PIECE = ["block", "ids", "sizes", "cells", "far"]
_BLOBS = [np.dtype("<u8"), np.dtype("<u4"), np.dtype("<u4"), _FAR]
_ROWS = "block int, ids binary, sizes binary, cells binary, far binary"
_TOLD_ROWS = "block int, kind int, blob binary"


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 by 7; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text", SLICE):
        found = words.split(piece.column("text"))
        counts = np.bincount(found.ids, minlength=len(found.distinct))
        yield pa.RecordBatch.from_pydict({"word": found.distinct.cast(pa.binary()),
                                          "n": counts.astype(np.int64)})


def _lookup(distinct: pa.Array, lexicon: pa.Table) -> np.ndarray:
    """The place of each word in the lexicon, or -1."""
    at = pc.index_in(distinct.cast(pa.binary()), lexicon.column("word").combine_chunks())
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False)


def _with_ends(found: words.Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """A value for each token, `end` after each text; and where texts begin."""
    out = np.insert(values[found.ids] if len(found.ids) else np.zeros(0, np.int64),
                    found.first[1:], end)
    return out, found.first + np.arange(len(found.first))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the words of a bigram table, most frequent first, its last two rows being the end and other
    words, which keep classes of their own.

    A word leaves its class for the one with the highest sum of N log N over class bigrams
    less those over classes, computed from the rows and columns that change.
    """
    size = len(bigrams) - 2
    of = np.arange(size + 2) % classes
    of[size:] = classes, classes + 1
    table = np.zeros((classes + 2, classes + 2))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    member = np.zeros((size + 2, classes + 2))
    member[np.arange(size + 2), of] = 1

    def nlogn(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)

    for _ in range(sweeps):
        moved = 0
        for word in range(size):
            old, own = of[word], bigrams[word, word]
            member[word, old] = 0
            right, left = bigrams[word] @ member, bigrams[:, word] @ member
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows, columns = table.sum(axis=1) + left, table.sum(axis=0) + right
            # What joining class k changes: its row, its column, and the cell where both meet.
            gain = (nlogn(table + right) - nlogn(table)).sum(axis=1)
            gain += (nlogn(table + left[:, None]) - nlogn(table)).sum(axis=0)
            cell, both = np.diag(table), right + left + own
            gain += (nlogn(cell + both) - nlogn(cell + right) - nlogn(cell + left) + nlogn(cell))
            gain -= nlogn(rows + right.sum() + own) - nlogn(rows)
            gain -= nlogn(columns + left.sum() + own) - nlogn(columns)
            best = int(np.argmax(gain[:classes]))
            of[word] = best
            member[word, best] = 1
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            moved += best != old
        if not moved:
            break
    return of


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values from each bound to the next as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)),
        pa.py_buffer(values.tobytes())])


def _joined(rows: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), kind)


def _ids(distinct: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each word: 8 bytes at a time, long words by themselves."""
    data, bounds = flat_bytes(distinct)
    sizes = np.diff(bounds)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    ids = words.mix(sizes.astype(np.uint64) + np.uint64(seed << 32))
    for low in range(0, _LONG, 8):
        here = np.flatnonzero(sizes > low)
        unused = np.maximum(8 - (sizes[here] - low), 0).astype(np.uint64) * np.uint64(8)
        part = eights[bounds[here] + low] << unused
        ids[here] = words.mix(ids[here] ^ part)
    for i in np.flatnonzero(sizes > _LONG):
        ids[i] = xxhash.xxh3_64_intdigest(distinct[i].as_py(), seed)
    return ids


def _numbered(seed: int):
    """Add the id of each word: a hash."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column("word"), seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], ["word", "n", "id"])
    return number


@dataclass
class _Ranks:
    """Ids of the lexicon's words by rank, and the number of blocks that ids are dealt to."""

    ids: np.ndarray
    blocks: int
    seed: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.ids)
        self.sorted = self.ids[self.order]
        self.block = self.of(self.ids)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return (ids % np.uint64(self.blocks)).astype(np.int32)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The rank of each id, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.sorted, ids), len(self.ids) - 1)
        return np.where(self.sorted[at] == ids, self.order[at], -1)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    return keys[begin], np.add.reduceat(counts, begin) if len(keys) else counts


def _cells(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the keys, and which key each belongs to; a large count takes several."""
    parts = -(-counts // _MOST)
    of = np.repeat(np.arange(len(keys)), parts)
    n = np.full(len(of), _MOST)
    n[np.cumsum(parts) - 1] = counts - (parts - 1) * _MOST
    return (((keys[of] & _CODES) << _COUNT_BITS) | n).astype(np.uint32), of


def _neighbours(ranks: _Ranks):
    """A row for each piece of the text and block of words: their ids, the numbers of their cells, the cells,
    which name a neighbour of the lexicon or the end of the text, and pairs of words that the lexicon lacks."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(ranks.ids)
        for piece in text_slices(batches, "text", SLICE):
            found = words.split(piece.column("text"))
            kinds = len(found.distinct)
            ids = _ids(found.distinct, ranks.seed)
            order = np.lexsort((ids, ranks.of(ids)))
            place = np.empty(kinds + 1, np.int64)
            place[order], place[kinds] = np.arange(kinds), kinds
            ids = ids[order]
            rank = np.append(ranks.find(ids), end)
            token, first = _with_ends(found, place[:-1], kinds)
            before, after = np.roll(token, 1), np.roll(token, -1)
            before[first[:-1]] = kinds
            near, far = [], []
            for side, other in ((0, before), (1, after)):
                real = (token < kinds) & (rank[other] >= 0)
                near.append((token[real] << _CODE_BITS) | rank[other[real]] * 2 | side)
                real = (token < kinds) & (rank[other] < 0) & (rank[token] < 0)
                far.append((token[real] * 2 + side) * kinds + other[real])
            del token, before, after, real, other
            keys, counts = np.unique(np.concatenate(near), return_counts=True)
            cells, of = _cells(keys, counts)
            word = keys[of] >> _CODE_BITS
            sizes = np.bincount(word, minlength=kinds)
            pairs, counts = np.unique(np.concatenate(far), return_counts=True)
            rare = np.zeros(len(pairs), _FAR)
            owner = pairs // kinds // 2 if kinds else pairs
            rare["word"], rare["n"] = ids[owner], counts
            if kinds:
                rare["other"], rare["side"] = ids[pairs % kinds], pairs // kinds % 2
            blocks = ranks.of(ids)
            begin = np.flatnonzero(np.diff(blocks, prepend=-1))
            bounds = np.append(begin, kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks[begin]), _blobs(ids, bounds),
                 _blobs(sizes.astype(np.uint32), bounds),
                 _blobs(cells, np.searchsorted(word, bounds)),
                 _blobs(rare, np.searchsorted(owner, bounds))], _PIECE)
    return gather


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_neighbours` in order of block: one row per block, each word and cell once, words by id."""
    empty = tuple(np.zeros(0, kind) for kind in _BLOBS)

    def reduced(parts: list[tuple]) -> tuple:
        all_ids, sizes, cells, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(all_ids, return_inverse=True)
        whole = np.sort((np.repeat(at, sizes).astype(np.uint64) << np.uint64(32)) | cells)
        keys, counts = whole >> np.uint64(_COUNT_BITS), (whole & np.uint64(_MOST)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)])
        keys = keys[begin].astype(np.int64)
        counts = np.add.reduceat(counts, begin) if len(begin) else counts
        cells, of = _cells(keys, counts)
        sizes = np.bincount(keys[of] >> _CODE_BITS, minlength=len(ids)).astype(np.uint32)
        order = np.lexsort((far["other"], far["side"], far["word"]))
        far = far[order]
        new = np.ones(len(far), bool)
        for name in ("word", "side", "other"):
            new[1:] &= far[name][1:] == far[name][:-1]
        new[1:] = ~new[1:]
        begin = np.flatnonzero(new)
        once = far[begin]
        if len(begin):
            once["n"] = np.add.reduceat(far["n"], begin)
        return ids, sizes, cells, once

    def row(block: int, parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), *(_blobs(x, np.array([0, len(x)])) for x in reduced(parts))],
            _PIECE)

    last, parts, held = None, [empty], 0
    for batch in batches:
        for block, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != last:
                if last is not None:
                    yield row(last, parts)
                last, parts, held = block, [empty], 0
            parts.append(tuple(np.frombuffer(x, e.dtype) for x, e in zip(blobs, empty, strict=True)))
            held += len(blobs[2])
            if held > _HELD:
                parts, held = [reduced(parts)], 0
    if last is not None:
        yield row(last, parts)


def _core_bigrams(ranks: _Ranks, core: int):
    """Counts of neighbours among the core (0 on), the end (`core`) and other words (`core` + 1), from rows of
    `_merge`; all but those of texts without words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = core + 2
        table = np.zeros(side * side, np.int64)
        known = np.full(len(ranks.ids) + 2, core + 1)
        known[:core], known[-2] = np.arange(core), core
        for batch in batches:
            for blobs in zip(*(batch.column(name) for name in _PIECE[1:]), strict=True):
                ids, sizes, cells, far = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(
                    blobs, _BLOBS, strict=True))
                rank = ranks.find(ids)
                word, code = np.repeat(rank, sizes), cells >> _COUNT_BITS
                other, right = (code >> 1).astype(np.int64), (code & 1).astype(bool)
                # A word's left neighbours, its ends, and the words of the lexicon to the right of a rarer one.
                real = ~right | (other == len(ranks.ids)) | (word < 0)
                first, then = known[np.where(right, word, other)], known[np.where(right, other, word)]
                table += np.bincount((first * side + then)[real], weights=(cells & _MOST)[real],
                                     minlength=side * side).astype(np.int64)
                table[-1] += far["n"][far["side"] == 0].sum()
        full = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict(
            {"left": full // side, "right": full % side, "n": table[full]})
    return count


class _Block:
    """The words of a block (row of `_merge`), the classes of all, and how often each stands in which
    context: class to the left, or _CONTEXTS + class to the right."""

    def __init__(self, ranks: _Ranks, lexicon: np.ndarray, block: pa.Table, sent: pa.Table):
        row = block.slice(0, 1).to_pylist()[0]
        self.ids, sizes, cells, self.far = (
            np.frombuffer(row[name], kind) for name, kind in zip(_PIECE[1:], _BLOBS, strict=True))
        self.rank = ranks.find(self.ids)
        told = {kind: _joined(sent.column("blob").filter(pc.equal(sent.column("kind"), kind)), of)
                for kind, of in _KINDS.items()}
        self.classes = np.where(self.rank >= 0, np.append(lexicon, OTHER)[self.rank], OTHER)
        if len(told[_STATE]):
            self.classes[self.rank < 0] = told[_STATE]
        code, self.n = cells >> _COUNT_BITS, cells & _MOST
        self.other, self.side = code >> 1, code & 1
        self.sizes, self.word = sizes, np.repeat(np.arange(len(self.ids)), sizes)
        known = np.append(lexicon, END)
        self.context = known[self.other] + self.side * _CONTEXTS
        # What words beyond the lexicon tell their neighbours here, in order of these.
        by_rank = np.argsort(self.rank, kind="stable")
        near, rare = told[_NEAR], told[_RARE]
        at = np.searchsorted(self.rank[by_rank], (near >> np.uint64(46)).astype(np.int64))
        place = np.concatenate((by_rank[at] if len(near) else at,
                                np.searchsorted(self.ids, rare["word"])))
        context = np.concatenate(((near >> np.uint64(38)).astype(np.int64) & 255, rare["context"]))
        counts = np.concatenate(((near & np.uint64((1 << 38) - 1)).astype(np.int64), rare["n"]))
        order = np.argsort(place, kind="stable")
        self.told = place[order], context[order], counts[order]

    def choose(self, gain: np.ndarray) -> None:
        """Move every word to its best class."""
        wide, some = 2 * _CONTEXTS, 1 << 13
        ends = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        place, context, counts = self.told
        for low in range(0, len(self.ids), some):
            high = min(low + some, len(self.ids))
            table = np.zeros((high - low) * wide)
            for (a, b), at, around, n in (
                    (ends[[low, high]], self.word, self.context, self.n),
                    (np.searchsorted(place, (low, high)), place, context, counts)):
                table += np.bincount((at[a:b] - low) * wide + around[a:b], weights=n[a:b],
                                     minlength=len(table))
            self.classes[low:high] = (table.reshape(-1, wide) @ gain).argmax(axis=1)

    def tell(self, ranks: _Ranks, block: int) -> pa.Table:
        """The classes, as the next step reads them: those of the block's rare words, those of the lexicon, and
        for each neighbour of a rare word, by its block, the context that this word is."""
        lexicon = self.rank >= 0
        own = np.zeros(int(lexicon.sum()), _OWN)
        own["rank"], own["class"] = self.rank[lexicon], self.classes[lexicon]
        out = [(block, _STATE, self.classes[~lexicon].astype(np.uint8)), (block, _LEXICON, own)]
        rare = ~lexicon[self.word] & (self.other < len(ranks.ids))
        context = self.classes[self.word[rare]] + (1 - self.side[rare].astype(np.int64)) * _CONTEXTS
        keys, counts = _sums(self.other[rare].astype(np.int64) * 256 + context,
                             self.n[rare].astype(np.int64))
        near = (keys.astype(np.uint64) << np.uint64(38)) | counts.astype(np.uint64)
        far = np.zeros(len(self.far), _TOLD)
        far["word"], far["n"] = self.far["other"], self.far["n"]
        far["context"] = (self.classes[np.searchsorted(self.ids, self.far["word"])]
                          + (1 - self.far["side"].astype(np.int64)) * _CONTEXTS)
        for kind, to, what in ((_NEAR, ranks.block[keys >> 8], near),
                               (_RARE, ranks.of(far["word"]), far)):
            order = np.argsort(to, kind="stable")
            to, what = to[order], what[order]
            bounds = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
            out += [(int(to[a]), kind, what[a:b]) for a, b in pairwise(bounds)]
        return pa.table({"block": pa.array([x for x, _, _ in out], pa.int32()),
                         "kind": pa.array([x for _, x, _ in out], pa.int32()),
                         "blob": pa.array([x.tobytes() for _, _, x in out], pa.binary())})

    def bigrams(self) -> pa.Table:
        """Class and context of the block's words, counted."""
        wide = 2 * _CONTEXTS
        place, context, counts = self.told
        made = sum(np.bincount(self.classes[at] * wide + around, weights=n,
                               minlength=_CONTEXTS * wide)
                   for at, around, n in ((self.word, self.context, self.n), (place, context, counts)))
        full = np.flatnonzero(made)
        return pa.table({"class": (full // wide).astype(np.int32),
                         "context": (full % wide).astype(np.int32),
                         "n": made[full].astype(np.int64)})

    def named(self) -> pa.Table:
        return pa.table({"id": self.ids.view(np.int64), "class": self.classes.astype(np.int32)})


def _gain(table: np.ndarray) -> np.ndarray:
    """What a word's context adds to the likelihood of each class, under a table of class bigrams."""
    log = np.log(table + 0.5)
    return np.concatenate((log[:, :CLASSES] - np.log(table.sum(axis=0) + 1)[:CLASSES],
                           log[:CLASSES].T - np.log(table.sum(axis=1) + 1)[:CLASSES]))


def _bigram_table(made: DataFrame) -> np.ndarray:
    """Class bigrams over contexts, from the counts that tasks made: a table of fixed size."""
    table = np.zeros((_CONTEXTS, _CONTEXTS))
    for row in made.groupBy("class", "context").agg(F.sum("n").alias("n")).collect():
        if row.context < _CONTEXTS:
            table[row.context, row["class"]] += row.n
        elif row.context - _CONTEXTS == END:  # words to the right are counted as words
            table[row["class"], END] += row.n
    return table


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for what no change of classes alters."""
    return float(sum(sign * (x[x > 0] * np.log(x[x > 0])).sum() for sign, x in (
        (1, table), (-1, table.sum(axis=0)), (-1, table.sum(axis=1)))))


@dataclass
class Model:
    """`vocabulary` (word, n, class) of all training words; `lexicon`, its most frequent words, as a table;
    N tokens and V different ones in training text, ends included; training texts; and the likelihood
    after each step, the last of which was taken back."""

    vocabulary: DataFrame
    lexicon: pa.Table
    tokens: int
    kinds: int
    texts: int
    likelihoods: list[float]


def _top(vocabulary: DataFrame, rows: int) -> pa.Table:
    return vocabulary.orderBy(F.desc("n"), "word").limit(rows).toArrow()


def _blocks(texts: DataFrame, ranks: Broadcast, parts: int) -> DataFrame:
    """The neighbours of all words of `texts`, a row for each block of words."""
    return save_by_key(texts.mapInArrow(lambda b: _neighbours(ranks.value)(b), _ROWS).repartition(
        parts, "block").sortWithinPartitions("block").mapInArrow(_merge, _ROWS),
        "block", parts, "lm-blocks")


def fit(docs: DataFrame) -> Model:
    """Count and cluster the words of `docs` (text)."""
    texts, spark = docs.select("text"), docs.sparkSession
    counted = save(texts.mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")), "lm-counts")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = texts.count()
    lexicon = _top(counted, max(LEXICON, CORE))
    parts, seed = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
    while True:
        ids = _ids(lexicon.column("word").combine_chunks(), seed)
        ranks = spark.sparkContext.broadcast(_Ranks(ids, int(total[0]) // BLOCK + 1, seed))
        blocks = _blocks(texts, ranks, parts)
        if blocks.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] == total[1] * ids.itemsize:
            break
        discard(blocks)  # two words had the same id
        seed += 1
    core = min(lexicon.num_rows, CORE)
    wide = core + 2
    bigrams = np.zeros((wide, wide))
    cells = blocks.mapInArrow(lambda b: _core_bigrams(ranks.value, core)(b),
                              "left bigint, right bigint, n bigint").groupBy("left", "right").agg(
        F.sum("n").alias("n")).toArrow()  # at most CORE + 2 squared rows
    bigrams[cells.column("left").to_numpy(), cells.column("right").to_numpy()] = cells.column(
        "n").to_numpy()
    bigrams[core, core] = size - bigrams[core].sum()  # texts without words
    of = exchange(bigrams)
    table = np.zeros((_CONTEXTS, _CONTEXTS))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)

    def over_blocks(told: DataFrame, classes: np.ndarray, schema: str, result) -> DataFrame:
        """What `result` makes of each block, after what the step before told it."""
        def run(block: pa.Table, sent: pa.Table) -> pa.Table:
            return result(_Block(ranks.value, classes, block, sent), block.column("block")[0].as_py())
        return blocks.groupBy("block").cogroup(told.filter(F.col("kind") != _LEXICON).groupBy(
            "block")).applyInArrow(run, schema)

    def step(told: DataFrame, classes: np.ndarray, table: np.ndarray | None) -> DataFrame:
        gain = None if table is None else _gain(table)

        def moved(block: _Block, number: int) -> pa.Table:
            if gain is not None:
                block.choose(gain)
            return block.tell(ranks.value, number)
        return save(over_blocks(told, classes, _TOLD_ROWS, moved), "lm-step")

    def of_lexicon(told: DataFrame) -> np.ndarray:
        classes = np.full(len(ids), OTHER)
        for row in told.filter(F.col("kind") == _LEXICON).select("blob").toLocalIterator():
            own = np.frombuffer(row.blob, _OWN)
            classes[own["rank"]] = own["class"]
        return classes

    classes = np.full(len(ids), OTHER)
    classes[:core] = of[:core]
    unclassed = step(spark.createDataFrame([], _TOLD_ROWS), classes, None)
    told, proposed = None, step(unclassed, classes, table)
    discard(unclassed)
    likelihoods: list[float] = []
    while True:
        moved = of_lexicon(proposed)
        table = _bigram_table(over_blocks(proposed, moved, "class int, context int, n bigint",
                                          lambda block, _: block.bigrams()))
        likelihoods.append(likelihood(table))
        if len(likelihoods) > 1 and likelihoods[-1] <= likelihoods[-2]:
            break
        if told:
            discard(told)
        told, classes = proposed, moved
        proposed = step(told, classes, table)
    named = over_blocks(told, classes, "id bigint, class int", lambda block, _: block.named())
    numbered = counted.mapInArrow(_numbered(seed), "word binary, n bigint, id bigint")
    vocabulary = save(numbered.join(named, "id").select("word", "n", "class"), "lm-vocabulary")
    for left in (told, proposed, blocks, counted):
        discard(left)
    ranks.unpersist()
    lexicon = lexicon.select(["word", "n"]).append_column("class", pa.array(classes, pa.int32()))
    return Model(vocabulary, lexicon, int(total[0]) + size, int(total[1]) + bool(size), size,
                 likelihoods)


def _encoded(lexicon: pa.Table, texts: int):
    """Rows (key, doc_id, held_out, text): classes of the tokens with 255 for words beyond the lexicon, which
    follow with their places, and what the other tokens add to the scores."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.append(lexicon.column("n").to_numpy(), texts)
        known = np.append(lexicon.column("class").to_numpy(), END).astype(np.uint8)
        base, own = np.log10(counts + 1.0), np.log10(np.maximum(counts - DISCOUNT, 1e-9))
        for piece in text_slices(batches, "text", SLICE):
            found = words.split(piece.column("text"))
            token, first = _with_ends(found, _lookup(found.distinct, lexicon), len(counts) - 1)
            spelled, _ = _with_ends(found, np.arange(len(found.distinct)), -1)
            absent = token < 0
            classes = np.where(absent, 255, known[token]).astype(np.uint8)
            raw = classes.tobytes()
            sums = [np.concatenate(([0], np.cumsum(np.where(absent, 0.0, v[token]))))
                    for v in (base, own)]
            holes = np.flatnonzero(absent)
            of = np.searchsorted(first, holes, "right") - 1
            bounds = np.searchsorted(of, np.arange(piece.num_rows + 1)).astype(np.int32)
            hole = pa.StructArray.from_arrays(
                [pa.array((holes - first[of]).astype(np.int32)),
                 found.distinct.take(pa.array(spelled[holes])).cast(pa.binary())], ["at", "word"])
            yield pa.RecordBatch.from_pydict({
                "key": piece.column("key"), "doc_id": piece.column("doc_id"),
                "held_out": piece.column("held_out"),
                "n_tokens": np.diff(first),
                "base": sums[0][first[1:]] - sums[0][first[:-1]],
                "own": sums[1][first[1:]] - sums[1][first[:-1]],
                "classes": pa.array([raw[a:b] for a, b in zip(first[:-1], first[1:], strict=True)],
                                    pa.binary()),
                "holes": pa.ListArray.from_arrays(pa.array(bounds), hole)})
    return encode


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put in the classes of the looked-up words; `found` holds at and class."""
    for batch in batches:
        done = []
        for classes, found in zip(batch.column("classes").to_pylist(), batch.column("found"),
                                  strict=True):
            row = np.frombuffer(classes, np.uint8)
            if found.is_valid and len(found.values):
                row = row.copy()
                row[found.values.field("at").to_numpy()] = found.values.field("class").to_numpy()
            done.append(row.tobytes())
        names = [n for n in batch.schema.names if n not in ("classes", "found")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(done, pa.binary())], [*names, "classes"])


def _ngram_codes(row: np.ndarray) -> np.ndarray:
    """Number of each token's trigram of classes; two ends stand before a text."""
    wide = UNKNOWN + 1
    padded = np.concatenate(([END, END], row)).astype(np.int64)
    return (padded[:-2] * wide + padded[1:-1]) * wide + padded[2:]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((UNKNOWN + 1) ** 3, np.int64)
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            codes = [_ngram_codes(np.frombuffer(classes, np.uint8))
                     for classes in batch.column("classes").slice(low, 256).to_pylist()]
            table += np.bincount(np.concatenate(codes), minlength=len(table))
    full = np.flatnonzero(table)
    yield pa.RecordBatch.from_pydict({"code": full, "n": table[full]})


def log_chances(trigrams: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of what a token's class adds, given the two before: the share of its class divided
    by the class's tokens (a word's own count is added apart). Mixes trigrams, bigrams and single
    classes; an unseen context gives its share to the shorter one. For UNKNOWN, what all classes
    leave to unknown words, by their different words `kinds`."""
    wide = UNKNOWN + 1
    single = trigrams.sum(axis=(0, 1))
    total = max(single.sum(), 1.0)
    one = np.broadcast_to(single / total, (wide, wide, wide))
    two = trigrams.sum(axis=0)
    seen = two.sum(axis=1, keepdims=True)
    two = np.where(seen > 0, two / np.maximum(seen, 1), one[0])
    seen = trigrams.sum(axis=2, keepdims=True)
    three = np.where(seen > 0, trigrams / np.maximum(seen, 1), two)
    mixed = SHARES[0] * three + SHARES[1] * two + SHARES[2] * one
    word = mixed / np.maximum(single, 1)
    word[:, :, UNKNOWN] = (word * kinds * DISCOUNT).sum(axis=2)
    return np.log10(np.maximum(word, 1e-12 / total))


def _scored(chances: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = chances.reshape(-1)
        for batch in batches:
            extra = [float(flat[_ngram_codes(np.frombuffer(c, np.uint8))].sum())
                     for c in batch.column("classes").to_pylist()]
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base"]
            own = batch.column("own").to_numpy() + np.array(extra)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(own)],
                                             [*names, "score"])
    return score


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Score `docs` (doc_id, held_out, text); class trigrams are counted over the rows that aren't
    held out."""
    keyed = docs.withColumn("key", F.monotonically_increasing_id())
    sent = spark.sparkContext.broadcast(model.lexicon)
    texts = model.texts
    lists = "holes array<struct<at: int, word: binary>>"
    encoded = save(keyed.mapInArrow(
        lambda b: _encoded(sent.value, texts)(b),
        "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, base double, own double,"
        f" classes binary, {lists}"), "lm-encoded")
    holes = encoded.select("key", F.explode("holes").alias("hole")).select(
        "key", F.col("hole.at").alias("at"), F.col("hole.word").alias("word"))
    named = holes.join(model.vocabulary, "word", "left").select(
        "key", "at", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("class", F.lit(UNKNOWN)).alias("class"))
    found = named.groupBy("key").agg(
        F.collect_list(F.struct("at", "class")).alias("found"),
        F.sum(F.log10(F.col("n") + 1.0)).alias("more_base"),
        F.sum(F.when(F.col("n") > 0, F.log10(F.col("n") - DISCOUNT)).otherwise(0.0)).alias(
            "more_own"),
        F.sum((F.col("n") == 0).cast("bigint")).alias("unknown"))
    whole = encoded.drop("holes").join(found, "key", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_tokens") - F.coalesce("unknown", F.lit(0)) - F.lit(0 if texts else 1)).alias(
            "n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base"),
        (F.col("own") + F.coalesce("more_own", F.lit(0.0))).alias("own"), "classes", "found")
    sequences = save(whole.mapInArrow(
        _filled, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double,"
        " own double, classes binary"), "lm-sequences")
    wide = UNKNOWN + 1
    table, kinds = np.zeros(wide**3), np.zeros(wide)
    counted = sequences.filter("not held_out").select("classes").mapInArrow(
        _trigrams, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    for row in model.vocabulary.groupBy("class").count().collect():
        kinds[row["class"]] = row["count"]
    kinds[END] = bool(texts)
    # A table of fixed size: UNKNOWN + 1 cubed doubles.
    chances = spark.sparkContext.broadcast(log_chances(table.reshape(wide, wide, wide), kinds))
    smoothed = float(np.log10(model.tokens + model.kinds + 1))
    return sequences.mapInArrow(
        lambda b: _scored(chances.value)(b),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double,"
        " score double").select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * smoothed).alias("base_score"), "score")


def held_out_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (log10 probabilities); the model learns from the rows that aren't held out.

    Words are maximal runs of other than white space, A-Z lower-cased; a text's end is one more token. Null
    text is empty: the end alone. Rows that repeat count each; a null doc_id is not held out. Without training rows no
    token is known. An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(docs.sparkSession, rows, fit(rows.filter("not held_out")))
