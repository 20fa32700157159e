"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be met with up to k = m * ERROR_PERCENT // 100 edits. Cut into k + 1
pieces, any such occurrence holds one piece unchanged, so an Aho-Corasick scan for all pieces finds every
place worth a look; Myers' bit-parallel algorithm then gives the least edit distance there. An item of
fewer than SHORT characters has no edits to spare (k = 0) and is met where its words stand as
whole words.

Items and texts are compared lower-cased, with runs of white space and ASCII punctuation as one
space. Items are sent to all tasks in blocks of bounded size, and the documents are read once a
block; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices

ERROR_PERCENT = 8
#: A shorter item is met without an edit, as whole words.
SHORT = 40
#: From here on scripts are written without spaces, or with endings joined to words.
_UNSPACED = 0x0E00
#: Text of the items that one block holds.
BLOCK_BYTES = 1 << 20

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32
               for c in range(256))


def plain(text: str) -> str:
    """The form in which texts are compared."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split()).decode()


def plain_places(text: str) -> tuple[str, list[int]]:
    """The plain form, and the place in `text` of each of its characters."""
    out, places = [], []
    for at, char in enumerate(text):
        for low in char.lower():
            kept = low if ord(low) >= 128 or low.isalnum() else " "
            if kept != " " or (out and out[-1] != " "):
                out.append(kept)
                places.append(at)
    if out and out[-1] == " ":
        out.pop()
    return "".join(out), places[: len(out)]


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """`errors` + 1 pieces of even length, with where each begins."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def least_distance(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance of `pattern` to a part of `text`, at most `limit`, and the first
    place where such a part ends (Myers 1999; a column is one integer of a bit per character)."""
    full, high = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    equal: dict[str, int] = {}
    for i, char in enumerate(pattern):
        equal[char] = equal.get(char, 0) | 1 << i
    up, down, score, best = full, 0, len(pattern), None
    for at, char in enumerate(text):
        match = equal.get(char, 0)
        vertical = match | down
        diagonal = (((match & up) + up) ^ up) | match
        rise, fall = down | (~(diagonal | up) & full), up & diagonal
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (~(vertical | rise) & full), rise & vertical
        if score <= limit and (best is None or score < best[0]):
            best = score, at + 1
            if not score:
                break
    return best


def _whole_words(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on across either edge of text[begin:end]."""
    def joined(at: int) -> bool:
        return 0 < at < len(text) and all(
            c.isalnum() and ord(c) < _UNSPACED for c in text[at - 1 : at + 1])

    return not (joined(begin) or joined(end))


class Matcher:
    """Finds items in texts. `items`: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], percent: int = ERROR_PERCENT):
        self.items: list[tuple[int, str, int]] = []
        self.scan, self.any = ahocorasick.Automaton(), False
        filed: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = plain(text)
            if not item:
                continue
            errors = len(item) * percent // 100 if len(item) >= SHORT else 0
            for offset, piece in pieces(item, errors):
                filed.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, item, errors))
        for piece, uses in filed.items():
            self.scan.add_word(piece, (len(piece), uses))
        if filed:
            self.scan.make_automaton()
            self.any = True

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) of each item met, at its first best place in the
        plain text."""
        form, found = plain(text), []
        if not self.any:
            return found
        regions: dict[int, list[list[int]]] = {}
        met: set[int] = set()
        for end, (size, uses) in self.scan.iter(form):
            for k, offset in uses:
                item_id, item, errors = self.items[k]
                begin = end + 1 - size - offset
                if len(item) < SHORT:
                    if k not in met and _whole_words(form, begin, end + 1):
                        met.add(k)
                        found.append((item_id, 0, begin, end + 1))
                    continue
                low, high = max(0, begin - errors), begin + len(item) + errors
                own = regions.setdefault(k, [])
                if own and own[-1][0] <= low <= own[-1][1]:
                    own[-1][1] = max(high, own[-1][1])
                else:
                    own.append([low, high])
        for k, own in regions.items():
            item_id, item, errors = self.items[k]
            best, merged = None, []
            for low, high in sorted(own):  # hits come in order of their ends, not of their regions
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            for low, high in merged:
                got = least_distance(item, form[low:high], errors)
                if got and (best is None or got[0] < best[0]):
                    back = least_distance(item[::-1], form[low : low + got[1]][::-1], got[0])
                    best = got[0], low + got[1] - back[1], low + got[1]
                    if not got[0]:
                        break
            if best:
                found.append((item_id, *best))
        return found


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items (item_id, text) in blocks of about `block_bytes`, one at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).distinct()
        yield sorted((tuple(r) for r in part.collect()), key=str)


def _per_text(docs: DataFrame, items: list, column: str) -> Callable:
    """A function for mapInArrow's batches: pieces of rows, and for each row what is found."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        matcher = Matcher(sent.value)
        for piece in text_slices(batches, column):
            yield piece, [matcher.find(t) if t else [] for t in piece.column(column).to_pylist()]

    return rows


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, begin, end): every document that holds an item within its
    error budget, with the least distance and the first place that has it, as code points of the
    text (null where lower-casing moves characters about).

    Null or empty texts hold nothing, empty items are in nothing; equal items with different ids
    are all reported, repeated rows of either table once each or once in all (items). Either table
    may be empty. Other columns are not looked at.
    """
    result = None
    for items in item_blocks(benchmark):
        per_text = _per_text(docs, items, "text")

        def report(batches: Iterator[pa.RecordBatch], per_text=per_text) -> Iterator[pa.RecordBatch]:
            for piece, found in per_text(batches):
                rows = []
                for i, hits in enumerate(found):
                    if not hits:
                        continue
                    text = piece.column("text")[i].as_py()
                    form, places = plain_places(text)
                    for item_id, distance, begin, end in hits:
                        known = form == plain(text)
                        rows.append((piece.column("doc_id")[i].as_py(), item_id, distance,
                                     places[begin] if known else None,
                                     places[end - 1] + 1 if known else None))
                names = ["doc_id", "item_id", "distance", "begin", "end"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)

        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
            report, "doc_id bigint, item_id bigint, distance bigint, begin bigint, end bigint")
        result = found if result is None else result.unionByName(found)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item within its error budget, with all their columns.

    Null or empty texts and rows without doc_id are judged by their text alone: they hold nothing or what
    it holds. Repeated rows stay or go together. Null or empty items are in nothing; without items all
    documents stay, and an empty table stays empty. Columns named like those of the benchmark are left alone.
    """
    for items in item_blocks(benchmark):
        per_text = _per_text(docs, items, "text")

        def keep(batches: Iterator[pa.RecordBatch], per_text=per_text) -> Iterator[pa.RecordBatch]:
            for piece, found in per_text(batches):
                yield piece.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
