"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the
sum over all ways to cut it into pieces, which a forward pass over the word adds up; a text's
is the product over its words. Piece probabilities are fitted by expectation maximisation, also
over all segmentations. Every different word of a piece of the table is scored once, words
of one length together, as arrays; a word of more than LONG characters by itself, in blocks that
carry on what reaches each of the last places, so that no segmentation is lost at their edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .shared import discard, fresh, if_small, save, text_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Where a sample of documents is asked for, the first so many characters of a longer one.
SAMPLE_CHARS = 50_000
#: Characters of words whose segmentations are held at once when fitting.
FIT_CHARS = 1 << 18
ROUNDS = 4
#: Added to the expected count of every piece.
PRIOR = 0.01
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: Longer words are scored by themselves, in blocks; fitting takes them in stretches of this length.
LONG = 256
#: A text is in no learned language if the mean log probability per character of its spoken words (with
#: letters, without digits) is so much below the lower quartile of that language's held-out documents
#: (nats; running text differs by under 1).
SLACK = 3.0
SLICE = 12 << 20
UNDETERMINED = "und"
_LETTER, _DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Slots of a table of pieces, and which bits of a hash lead into the first, second and third table.
_SLOTS, _SHIFTS = 1 << 18, (np.uint64(46), np.uint64(28), np.uint64(10))


def vocabulary_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece vocabulary that stand for text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in every
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


def _codes(texts: list[str]) -> np.ndarray:
    """Texts of one length as rows of mixed code points."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return words.mix(flat + np.uint64(1)).reshape(len(texts), -1)


@dataclass
class Pieces:
    """Finds pieces by hash: sorted `keys`, and the number of the piece of each."""

    keys: np.ndarray
    numbers: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Pieces:
        keys = np.zeros(len(pieces), np.uint64)
        sizes = np.array([len(p) for p in pieces])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            key = np.zeros(len(at), np.uint64)
            for column in _codes([pieces[i] for i in at]).T:
                key = key * _BASE + column
            keys[at] = key + np.uint64(size)
        order = np.argsort(keys)
        return cls(keys[order], order, int(sizes.max(initial=1)))

    @cached_property
    def _slots(self) -> tuple[list[tuple[np.uint64, np.ndarray]], np.ndarray]:
        """Tables that some bits of a key lead to a place of `keys` in, each holding those that found
        their slot taken in the one before; and the places that no table holds."""
        left, tables = np.arange(len(self.keys)), []
        for shift in _SHIFTS:
            slot = self._slot(self.keys[left], shift)
            _, first = np.unique(slot, return_index=True)
            table = np.full(_SLOTS, -1, np.int32)
            table[slot[first]] = left[first]
            tables.append((shift, table))
            left = np.delete(left, first)
        return tables, left

    @staticmethod
    def _slot(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((keys >> shift) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes `sought` are those of pieces, and the number of each one's piece."""
        tables, rest = self._slots
        rows, places = [], []
        left = np.arange(len(sought))
        for shift, table in tables:  # a key with an empty slot is in no later table either
            at = table[self._slot(sought[left], shift)]
            taken = np.flatnonzero(at >= 0)
            left, at = left[taken], at[taken]
            equal = self.keys[at] == sought[left]
            rows.append(left[equal])
            places.append(at[equal])
            left = left[~equal]
            if not len(left):
                break
        if len(left) and len(rest):
            at = rest[np.minimum(np.searchsorted(self.keys[rest], sought[left]), len(rest) - 1)]
            equal = self.keys[at] == sought[left]
            rows.append(left[equal])
            places.append(at[equal])
        return np.concatenate(rows), self.numbers[np.concatenate(places)]

    def spans(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows that have a piece there, its number in each), by end."""
        length = codes.shape[1]
        running = np.zeros((length + 1, len(codes)), np.uint64)
        for at in range(length):
            running[at + 1] = running[at] * _BASE + codes[:, at]
        power = np.ones(1, np.uint64)
        powers = [power := power * _BASE if i else power for i in range(self.longest + 1)]
        for end in range(1, length + 1):
            for begin in range(max(0, end - self.longest), end):
                size = end - begin
                yield begin, end, *self.find(
                    running[end] - running[begin] * powers[size] + np.uint64(size))

    def ending(self, codes: np.ndarray) -> np.ndarray:
        """Number of the piece that ends with each character of one text, or -1: a row for each
        length, the longest first."""
        out = np.full((self.longest, len(codes)), -1)
        key, power = np.zeros(len(codes), np.uint64), np.ones(1, np.uint64)
        for size in range(1, min(self.longest, len(codes)) + 1):
            key[size - 1 :] += codes[: len(codes) - size + 1] * power
            rows, numbers = self.find(key[size - 1 :] + np.uint64(size))
            out[self.longest - size, size - 1 + rows] = numbers
            power = power * _BASE
        return out


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and texts in groups of one length."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(group):
            yield group, [texts[i] for i in group]


def forward(pieces: Pieces, chances: np.ndarray, texts: list[str]) -> np.ndarray:
    """Log probability of each word under each language: `chances` has a row for each piece and a
    last one of zeros, which -1 finds, and a column for each language."""
    out = np.zeros((len(texts), chances.shape[1]))
    for group, same in by_length(texts):
        if len(same[0]) > LONG:
            out[group] = [_forward_long(pieces, chances, word) for word in same]
            continue
        for low in range(0, len(same), 20_000):
            part = same[low : low + 20_000]
            length, scale = len(part[0]), np.zeros((len(part), chances.shape[1]))
            reach = np.zeros((length + 1, *scale.shape))
            reach[0] = 1
            done = 0
            for begin, end, rows, number in pieces.spans(_codes(part)):
                if end > done:  # all ways to reach `done` are added up
                    _settle(reach, done, scale, pieces.longest)
                    done = end
                if begin == end - 1:
                    chance = np.full(scale.shape, UNKNOWN)
                    chance[rows] = chances[number]
                    reach[end] += reach[begin] * chance
                elif len(rows):
                    reach[end, rows] += reach[begin, rows] * chances[number]
            out[group[low : low + 20_000]] = np.log(reach[length]) + scale
    return out


def _forward_long(pieces: Pieces, chances: np.ndarray, word: str) -> np.ndarray:
    """`forward` for one word, in blocks of LONG characters."""
    longest, wide = pieces.longest, chances.shape[1]
    state, scale = np.zeros((longest, wide)), np.zeros(wide)
    state[-1] = 1  # what reaches the last `longest` places
    for low in range(0, len(word), LONG):
        back = min(low, longest - 1)
        number = pieces.ending(_codes([word[low - back : low + LONG]])[0])[:, back:]
        chance = chances[number]
        chance[-1] = np.where(number[-1][:, None] < 0, UNKNOWN, chance[-1])
        reach = np.concatenate((state, np.zeros((number.shape[1], wide))))
        for at in range(number.shape[1]):
            reach[at + longest] = (reach[at : at + longest] * chance[:, at]).sum(axis=0)
            if at % 8 == 7:
                factor = reach[at + longest].copy()
                reach[at + 1 : at + longest + 1] /= factor
                scale += np.log(factor)
        state = reach[-longest:]
    return np.log(state[-1]) + scale


def _settle(reach: np.ndarray, at: int, scale: np.ndarray, longest: int) -> None:
    """Every eighth character, bring what later steps use back near 1."""
    if at % 8 == 0 and at:
        factor = reach[at].copy()
        reach[max(0, at - longest) : at + 1] /= factor
        scale += np.log(factor)


def _spans_of(pieces: Pieces, texts: list[str], counts: np.ndarray) -> Iterator[tuple]:
    """Words in groups of one length: length, counts, and where which pieces stand."""
    for group, same in by_length(texts):
        found = [span for span in pieces.spans(_codes(same)) if span[0] == span[1] - 1 or len(span[2])]
        yield len(same[0]), counts[group].astype(float), found


def _expected(group: tuple, chance: np.ndarray) -> np.ndarray:
    """Expected count of every piece, and of characters that none covers, over all segmentations."""
    (length, weight, found), size = group, len(chance) - 1
    every, spans = np.arange(len(weight)), []
    for b, e, rows, n in found:
        if e == b + 1:  # single characters stand in every row, as pieces or as uncovered ones
            whole, odds = np.full(len(weight), size), np.full(len(weight), UNKNOWN)
            whole[rows], odds[rows] = n, chance[n]
            spans.append((b, e, every, whole, odds))
        else:
            spans.append((b, e, rows, n, chance[n]))
    ahead, behind = np.zeros((2, length + 1, len(weight)))
    ahead[0] = behind[length] = 1
    for b, e, rows, _, p in spans:
        ahead[e, rows] += ahead[b, rows] * p
    for b, e, rows, _, p in reversed(spans):
        behind[b, rows] += behind[e, rows] * p
    share = weight / np.maximum(ahead[length], 1e-300)
    return np.bincount(np.concatenate([n for *_, n, _ in spans]), np.concatenate([
        share[rows] * ahead[b, rows] * p * behind[e, rows] for b, e, rows, _, p in spans]), size + 1)


def _uniform(size: int) -> np.ndarray:
    return np.append(np.full(size, 1 / size), 0)


def _normalised(expected: np.ndarray) -> np.ndarray:
    chance = expected + PRIOR
    return np.append(chance[:-1] / chance[:-1].sum(), 0)


def fit_language(pieces: Pieces, texts: list[str], counts: np.ndarray, size: int,
                 rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words and their counts."""
    groups, chance = list(_spans_of(pieces, texts, counts)), _uniform(size)
    for _ in range(rounds):
        chance = _normalised(sum((_expected(g, chance) for g in groups), np.zeros(size + 1)))
    return chance


@dataclass
class Model:
    """`chances[i, k]` is the probability of piece i in language k; the last row is zeros."""

    languages: list[str]
    pieces: Pieces
    chances: np.ndarray


def _marked(distinct: pa.Array) -> list[str]:
    """Words, each with the mark of a word's begin."""
    return ["▁" + word.decode("utf-8", "replace") for word in distinct.to_pylist()]


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether crc32 of doc_id as text leaves 0; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in text_slices(batches, "text", SLICE):
        found = words.split(piece.column("text"))
        spoken = piece.column("lang").dictionary_encode()
        of = np.repeat(spoken.indices.to_numpy(), np.diff(found.first))
        pair, count = np.unique(of * len(found.distinct) + found.ids, return_counts=True)
        yield pa.RecordBatch.from_pydict({
            "lang": spoken.dictionary.take(pa.array(pair // max(1, len(found.distinct)))),
            "word": found.distinct.take(pa.array(pair % max(1, len(found.distinct)))).cast(
                pa.binary()),
            "n": count.astype(np.int64)})


def _sampled(docs: DataFrame, mine: Column, sample: int) -> DataFrame:
    """(lang, text, hash): of the rows with text, lang and doc_id that are `mine`, the first `sample`
    of each language by a hash of doc_id and text, and SAMPLE_CHARS characters of each."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()
                       & F.col("doc_id").isNotNull() & mine).select(
        "text", "lang", F.xxhash64("doc_id", "text").alias("hash"))
    # A cut that leaves about four times the sample, whatever the table's size, and the first row always.
    low, width = F.lit(-(2.0**63)), F.lit(2.0**64)
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.count(F.lit(1)))
    cuts = rows.groupBy("lang").agg(
        F.greatest(F.min("hash").cast("double"), low + width * share).alias("cut"))
    # A row for each language; by shuffle, all rows of one would meet in a task.
    few = rows.select("lang", "hash").join(F.broadcast(cuts), "lang").filter(
        F.col("hash").cast("double") <= F.col("cut")).select("lang", "hash").distinct()
    order = Window.partitionBy("lang").orderBy("hash")
    bounds = few.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= sample).groupBy("lang").agg(F.max("hash").alias("last"))
    # A row for each language.
    return rows.join(F.broadcast(bounds), "lang").filter(F.col("hash") <= F.col("last")).select(
        "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "hash").dropDuplicates(
        ["lang", "hash"])


def _teaching(docs: DataFrame, mine: Column, sample: int | None) -> DataFrame:
    """(lang, text) of the rows with text, lang and doc_id that are `mine`, or of a sample of them; rows that
    are equal in lang, doc_id and text come once."""
    if sample is not None:
        return _sampled(docs, mine, sample).select("lang", "text")
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()
                       & F.col("doc_id").isNotNull() & mine).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    # Only the hashes are shuffled, and the texts of those that come again.
    again = save(rows.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
                 "language-again")
    held = again.count()
    if held:
        few = if_small(again, held, 64)
        rows = rows.join(few, ["lang", "hash"], "left_anti").unionByName(
            rows.join(few, ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"]))
    return rows.select("lang", "text")


class _Held:
    """Words of one language, longer ones in stretches of LONG characters, and their counts, until there
    are about FIT_CHARS characters of them: small groups of equal length cost most of their time in calls."""

    def __init__(self) -> None:
        self.words, self.counts, self.chars = [], [], 0

    def add(self, marked: list[str], counts: list[int]) -> Iterator[tuple[list[str], np.ndarray]]:
        for word, n in zip(marked, counts, strict=True):
            for i in range(0, len(word), LONG):
                self.words.append(word[i : i + LONG])
                self.counts.append(n)
                self.chars += len(self.words[-1])
                if self.chars >= FIT_CHARS:
                    yield from self.rest()

    def rest(self) -> Iterator[tuple[list[str], np.ndarray]]:
        if self.words:
            taken = self.words, np.array(self.counts)
            self.words, self.counts, self.chars = [], [], 0
            yield taken


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int | None = None) -> Model:
    """Fit on all documents with text, lang and doc_id that aren't held out, whole, equal rows as one;
    every language among them that has words is learned. Words are counted once; each round's expected counts of
    pieces are added up where the words lie, and only a row per language and piece is collected.

    With `sample`, fit on at most so many documents of each language, the first by a hash of doc_id and text,
    and at most SAMPLE_CHARS characters of each."""
    taken = _teaching(docs, ~held_out(F.col("doc_id")), sample)
    counted = save(taken.select("text", "lang").mapInArrow(
        _count_words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(
        F.sum("n").alias("n")), "language-words")
    names = vocabulary_pieces(vocabulary)
    pieces = Pieces.of(names)
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    chances = np.repeat(_uniform(len(names))[:, None], len(languages), axis=1)
    for _ in range(ROUNDS if languages else 0):
        expected = _expected_counts(counted, languages, pieces, chances)
        chances = np.column_stack([_normalised(of) for of in expected])
    discard(counted)
    return Model(languages, pieces, chances)


def _expected_counts(counted: DataFrame, languages: list[str], pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Expected counts of pieces, a row for each language, over all words of `counted`."""
    spark, size = counted.sparkSession, len(chances) - 1
    sent = spark.sparkContext.broadcast((languages, pieces, chances))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, chances = sent.value
        found = np.zeros((len(languages), size + 1))
        held = [_Held() for _ in languages]

        def add(k: int, ready: Iterator[tuple[list[str], np.ndarray]]) -> None:
            for words_, counts in ready:
                for group in _spans_of(pieces, words_, counts):
                    found[k] += _expected(group, chances[:, k])

        for batch in batches:
            for k, lang in enumerate(languages):
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                add(k, held[k].add(_marked(own.column("word")), own.column("n").to_pylist()))
        for k, left in enumerate(held):
            add(k, left.rest())
        k, piece = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"k": k, "piece": piece, "expected": found[k, piece]})

    rows = counted.mapInArrow(expect, "k bigint, piece bigint, expected double").groupBy("k", "piece").agg(
        F.sum("expected").alias("expected")).toArrow()
    out = np.zeros((len(languages), size + 1))
    out[rows.column("k").to_numpy(), rows.column("piece").to_numpy()] = rows.column("expected").to_numpy()
    sent.unpersist()
    return out


def text_scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text under each language; and a mean of it per character (a mark for
    each word among them), over words with letters and without digits, 0 where there are none."""
    found = words.split(texts)
    marked = _marked(found.distinct)
    each = forward(model.pieces, model.chances, marked)
    spoken = np.array([bool(_LETTER.search(w)) and not _DIGIT.search(w) for w in marked], bool)
    size = np.array([len(w) for w in marked], np.int64) * spoken
    low, high = found.first[:-1], found.first[1:]

    def per_text(values: np.ndarray) -> np.ndarray:
        # Each text by itself, so equal texts have equal sums whatever stands beside them.
        sums, full = np.zeros((len(low), values.shape[1])), np.flatnonzero(high > low)
        if len(full):
            sums[full] = np.add.reduceat(values[found.ids], low[full], axis=0)
        return sums

    means = per_text(each * spoken[:, None]) / np.maximum(per_text(size[:, None]), 1)
    return per_text(each), means


def predictions(model: Model, texts: pa.Array, floors: np.ndarray | None = None
                ) -> tuple[list[str], np.ndarray]:
    """Language and score: its share of the probability of the text, languages equally likely
    beforehand; UNDETERMINED and 0 for null, for a text without a letter, or a model of nothing,
    and where the mean log probability per character of spoken words is below the language's floor."""
    letters = pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), r"\pL"), False)
    known = letters.to_numpy(zero_copy_only=False)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    logs, means = text_scores(model, texts)
    best = logs.argmax(axis=1)
    if floors is not None:  # 0, no spoken words, is above all
        known = known & (means.max(axis=1) >= floors[means.argmax(axis=1)])
    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
    return names, np.where(known, share, 0.0)


def floors(docs: DataFrame, model: Model, slack: float = SLACK,
           sample: int | None = None) -> np.ndarray:
    """Least mean log probability per character of each language of the model: `slack` below the
    lower quartile of the language's held-out documents (all, or at most `sample`); a language without such a
    document has a floor that nothing is under."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text", SLICE):
            best = text_scores(sent.value, piece.column("text"))[1].max(axis=1)
            full = np.flatnonzero(best)
            yield pa.RecordBatch.from_pydict({
                "lang": piece.column("lang").take(pa.array(full)), "mean": best[full]})

    found = np.full(len(model.languages), -1e9)
    if model.languages:
        rows = _teaching(docs, held_out(F.col("doc_id")), sample).mapInArrow(
            means, "lang string, mean double")
        for row in rows.groupBy("lang").agg(
                F.percentile_approx("mean", 0.25).alias("quartile")).collect():
            if row.lang in model.languages:
                found[model.languages.index(row.lang)] = row.quartile - slack
    return found


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score"),
             least: np.ndarray | None = None) -> DataFrame:
    """The rows of `docs` with language and score (0 to 1) added under `names`; columns so named
    are replaced. Only the text is looked at; null text and text without a letter are
    UNDETERMINED, and with `least` text below its language's floor too. Ties go to the first language in order. An empty table stays empty."""
    own = docs.drop(*names)
    schema = T.StructType([*own.schema.fields, T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text", SLICE):
            found, scores = predictions(sent.value, piece.column("text"), least)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(found, pa.string()), pa.array(scores)],
                [*piece.schema.names, *names])

    return own.mapInArrow(predict, schema)


def held_out_predictions(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, the model fitted on the others."""
    model = fit(docs, vocabulary)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def with_language(docs: DataFrame, slack: float = SLACK, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents in one of the languages of the table, with all their columns.

    Null text, text without a letter and text that is improbable under every language (see `floors`)
    go; with a table that teaches no language, all go. Rows are judged by their text alone, so repeated ones stay or go
    together, and a null lang or doc_id only keeps a row from teaching. Other columns are left alone,
    whatever their names. An empty table stays empty.
    """
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    model = fit(docs, vocabulary)
    found = identify(docs, model, names, floors(docs, model, slack))
    return found.filter(found[names[0]] != UNDETERMINED).drop(*names)
