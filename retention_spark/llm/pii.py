"""Personal data by a semi-Markov conditional random field.

A text is cut into segments, each outside or a whole entity of one kind. Features look at a
whole candidate span (what it is made of, its digits, their grouping and checksum, the words before it), and dynamic
programming over segments of bounded length chooses boundaries and kinds together. An outside
character scores 0, so the best segmentation of a text falls apart into its stretches of
overlapping candidates, and only those are computed.

Spans by fixed rules (`base_spans`) always stay; the field adds spans that don't overlap them.
Its weights are fitted here by gradient ascent on the log likelihood, on a bounded sample of rows: rule spans
are the labels, also rewritten in ways that the rules miss.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, save, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Rows with rule spans that the weights are fitted on, and characters of a row's stretch.
SAMPLE_ROWS, STRETCH = 600, 120
#: Longest candidate entity in characters.
LONGEST = 128
EPOCHS, RATE, DECAY = 30, 0.5, 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs: a run that fails is not tried again from its middle, where it can't succeed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        d = int(char) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            done = match.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The rule spans, by kind as listed, then begin: leftmost and not overlapping within a kind."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(_byte(p) for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# Candidate spans: `[at]` and `(dot)` stand for masked marks.
_AT = r"(?:@|\s?[\[({]\s?(?i:at)\s?[\])}]\s?)"
_DOT = r"\s?[\[({]\s?(?i:dot)\s?[\])}]\s?"
_AT_MARK = re.compile(_AT)
# Where an address may reach to both sides, and its parts: words, dots, marks.
_ADDRESS = re.compile(rf"(?:{_AT}|{_DOT}|[A-Za-z0-9._%+-])++")
_PART = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT}|\.)|(?P<word>[A-Za-z0-9]+)|[_%+-]")
# Numbers with what may stand between them, and what may stand before the first.
_NUMBERS = re.compile(rf"[0-9]++(?:(?:{_DOT}|[ ._/()-]{{1,3}}+)[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]+")
_LEAD = re.compile(r"(?:\+|\(|\+\(|\+ )\Z")
#: Numbers of an entity at most, and of a host's address; digits of a card and of a phone number, at least and at most.
MOST_NUMBERS, PARTS, CARD_DIGITS, PHONE_DIGITS = 8, 4, (13, 19), (7, 15)
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?(?i:at|dot)\s?[\])}]")
_CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}
FEATURES = (
    "bias", "digits_10", "digits_11_15", "digits_16_19", "digits_other", "luhn", "parts_255",
    "plus", "brackets", "grouped", "masked", "has_at", "dotted", "cue", "letter_beside",
    "digit_beside", "known_ending", "bound_before", "bound_after", "number_before", "number_after",
)
_SEPARATED = re.compile(r"[0-9][ ./_-]+[0-9]")
_MASK = re.compile(r"(?i)[\[({]\s?(at|dot)")
_ENDING = re.compile(r"(?i)[.\])}\s](com|org|net|de|fr|es|edu|gov|io)$")
_APART = re.compile(r"[^0-9]+")
# A word or number that goes on beyond a mark beside the span, or beyond spaces.
_BOUND_BEFORE = re.compile(rf"[A-Za-z0-9](?:[._%+/@-]|{_AT}|{_DOT})\Z")
_BOUND_AFTER = re.compile(rf"(?:[._%+/@-]|{_AT}|{_DOT})[A-Za-z0-9]")
_NUMBER_BEFORE, _NUMBER_AFTER = re.compile(r"[0-9)][ ()]{1,3}\Z"), re.compile(r"[ ()]{1,3}[0-9]")


def features(text: str, kind: str, begin: int, end: int) -> np.ndarray:
    """What a whole span and what stands beside it look like, as numbers in the order of FEATURES."""
    return _look(kind, text[max(0, begin - 16) : begin], text[begin:end], text[end : end + 10])


@lru_cache(1 << 14)  # long tables of numbers repeat themselves
def _look(kind: str, before: str, span: str, after: str) -> np.ndarray:
    digits = "".join(_DIGITS.findall(span))
    n = len(digits)
    numbers = _APART.split(span)
    cues = before.lower()
    return np.array([
        1, n == 10, 11 <= n <= 15, 16 <= n <= 19, not 10 <= n <= 19, 13 <= n <= 19 and luhn(digits),
        len(numbers) == 4 and all(x and _byte(x) for x in numbers), "+" in span or span.startswith("00"),
        "(" in span and any(c.isdigit() for c in span), bool(_SEPARATED.search(span)),
        bool(_MASK.search(span)), "@" in span, span.count(".") >= 2,
        any(cue in cues for cue in _CUES[kind]),
        before[-1:].isalpha() or after[:1].isalpha(),
        before[-1:].isdigit() or after[:1].isdigit(),
        bool(_ENDING.search(span)), bool(_BOUND_BEFORE.search(before)),
        bool(_BOUND_AFTER.match(after)), bool(_NUMBER_BEFORE.search(before)),
        bool(_NUMBER_AFTER.match(after)),
    ], float)


def _windows(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """The text within LONGEST of the pattern's matches; what overlaps is one."""
    found: list[list[int]] = []
    for hit in pattern.finditer(text):
        low, high = max(0, hit.start() - LONGEST), hit.end() + LONGEST
        if found and low <= found[-1][1]:
            found[-1][1] = high
        else:
            found.append([low, high])
    return [(low, high) for low, high in found]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans from word to word with one at mark inside and a dot after it."""
    for low, high in _windows(_AT_MARK, text):
        for run in _ADDRESS.finditer(text, low, high):
            parts = [(m.lastgroup, *m.span()) for m in _PART.finditer(text, *run.span())]
            marks = [-1, *(i for i, p in enumerate(parts) if p[0] == "at"), len(parts)]
            for left, mark, right in zip(marks, marks[1:], marks[2:], strict=False):
                ends, dotted = [], False
                for kind, _, end in parts[mark + 1 : right]:
                    dotted = dotted or kind == "dot"
                    if dotted and kind == "word":
                        ends.append(end)
                if ends:
                    yield from ((b, e) for kind, b, _ in parts[left + 1 : mark] if kind == "word"
                                for e in ends if e - b <= LONGEST)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans from number to number, with each kind that their digits allow."""
    for run in _NUMBERS.finditer(text):
        parts = [m.span() for m in _NUMBER.finditer(text, *run.span())]
        lead = _LEAD.search(text[max(0, run.start() - 2) : run.start()])
        gaps = [text[a[1] : b[0]] for a, b in zip(parts, parts[1:], strict=False)]
        for i, (begin, _) in enumerate(parts):
            digits, dots = 0, 0
            mark = lead[0] if i == 0 and lead else "(" if i and gaps[i - 1].endswith("(") else ""
            for j in range(i, min(len(parts), i + MOST_NUMBERS)):
                digits += parts[j][1] - parts[j][0]
                end = parts[j][1]
                if digits > CARD_DIGITS[1] or end - begin + len(mark) > LONGEST:
                    break
                dots += j > i and ("." in gaps[j - 1] or "dot" in gaps[j - 1].lower())
                if j - i == PARTS - 1 == dots:
                    yield begin, end, "ip"
                if CARD_DIGITS[0] <= digits <= CARD_DIGITS[1]:
                    yield begin, end, "card"
                if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
                    yield begin, end, "phone"
                    if mark:
                        yield begin - len(mark), end, "phone"


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, kind number) of the spans of at most LONGEST characters, and MOST_NUMBERS numbers, that may be entities: all that begin and end
    with words or numbers and hold what a kind needs, under each kind that they may have. Spans that
    overlap or hold one another are all filed; the field decides."""
    found = {(begin, end, KINDS.index("email")) for begin, end in _addresses(text)}
    found |= {(begin, end, KINDS.index(kind)) for begin, end, kind in _numbers(text)}
    return sorted(found)


def _stretches(spans: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Candidates in groups that overlap no other group."""
    group: list[tuple[int, int, int]] = []
    reach = -1
    for span in sorted(spans):
        if group and span[0] >= reach:
            yield sorted(group, key=lambda c: (c[1], c[0], c[2]))
            group, reach = [], -1
        group.append(span)
        reach = max(reach, span[1])
    if group:
        yield sorted(group, key=lambda c: (c[1], c[0], c[2]))


def best_segments(spans: list[tuple[int, int, int]], scores: list[float]) -> list[int]:
    """The candidates (numbers) of the best segmentation of a stretch; `spans` by end. Outside
    characters score 0; of equals, the one with fewer entities, then the earlier ones, is taken."""
    points = sorted({p for b, e, _ in spans for p in (b, e)})
    best = {points[0]: (0.0, None, points[0])}
    ending: dict[int, list[int]] = {}
    for i, (_, end, _) in enumerate(spans):
        ending.setdefault(end, []).append(i)
    for before, at in zip(points[:-1], points[1:], strict=True):
        value = (best[before][0], None, before)
        for i in ending.get(at, ()):
            via = best[spans[i][0]][0] + scores[i]
            if via > value[0]:
                value = (via, i, spans[i][0])
        best[at] = value
    chosen, at = [], points[-1]
    while at != points[0]:
        _, i, at = best[at]
        if i is not None:
            chosen.append(i)
    return chosen[::-1]


def _marginals(spans: list[tuple[int, int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each candidate in a stretch: forward and backward sums over all
    segmentations."""
    points = sorted({p for b, e, _ in spans for p in (b, e)})
    place = {p: i for i, p in enumerate(points)}
    ahead, behind = [1.0] * len(points), [1.0] * len(points)
    weight = np.exp(np.clip(scores, -30, 30)).tolist()
    ending: list[list] = [[] for _ in points]
    starting: list[list] = [[] for _ in points]
    for (b, e, _), w in zip(spans, weight, strict=True):
        ending[place[e]].append((place[b], w))
        starting[place[b]].append((place[e], w))
    for i in range(1, len(points)):
        ahead[i] = ahead[i - 1] + sum(ahead[b] * w for b, w in ending[i])
    for i in range(len(points) - 2, -1, -1):
        behind[i] = behind[i + 1] + sum(behind[e] * w for e, w in starting[i])
    return np.array([ahead[place[b]] * w * behind[place[e]]
                     for (b, e, _), w in zip(spans, weight, strict=True)]) / ahead[-1]


@dataclass
class Field:
    """`weights[k]` weighs the features of kind k."""

    weights: np.ndarray

    def scores(self, text: str, spans: list[tuple[int, int, int]]) -> list[float]:
        return [float(self.weights[k] @ features(text, KINDS[k], b, e)) for b, e, k in spans]

    def entities(self, text: str) -> list[Span]:
        """The entities of the best segmentation."""
        if not _TRIGGER.search(text):
            return []
        found = []
        for group in _stretches(candidates(text)):
            chosen = best_segments(group, self.scores(text, group))
            found += [(KINDS[group[i][2]], group[i][0], group[i][1]) for i in chosen]
        return found

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The rule spans, and all spans: those and the entities that overlap none of them."""
        base = base_spans(text)
        taken = _united(base)
        added = [s for s in self.entities(text) if not _overlaps(taken, s[1], s[2])]
        return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _united(spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans cover, as stretches apart from one another, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((b, e) for _, b, e in spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def _overlaps(taken: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether a span meets one of the stretches; the last that begins before its end tells."""
    at = bisect_left(taken, (end, -1)) - 1
    return at >= 0 and taken[at][1] > begin


def _rewritten(text: str, span: Span, turn: random.Random) -> tuple[str, Span]:
    """The text with the span as rules may miss it, and the span there."""
    kind, begin, end = span
    inner = text[begin:end]
    if kind == "email":
        local, domain = inner.rsplit("@", 1)
        at, dot = turn.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", ".")))
        inner = local + at + domain.replace(".", dot)
    elif kind == "ip":
        inner = inner.replace(".", turn.choice(("[.]", " [dot] ", "(dot)")))
        inner = inner.replace("[.]", "[dot]")
    elif kind == "card":
        digits = "".join(_DIGITS.findall(inner))
        inner = turn.choice((".", "  ", "_", "/")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        digits = "".join(_DIGITS.findall(inner))[-10:]
        form = turn.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00 {} {} {}"))
        inner = form.format(digits[:3], digits[3:6], digits[6:])
    return text[:begin] + inner + text[end:], (kind, begin, begin + len(inner))


def _near_miss(kind: str, turn: random.Random) -> str:
    """What looks like an entity of the kind and isn't one."""
    if kind == "email":
        return f"{turn.choice('abc')}@{turn.randrange(100)}"
    if kind == "ip":
        parts = [turn.randrange(256) for _ in range(4)]
        parts[turn.randrange(4)] = turn.randint(256, 999)
        return ".".join(map(str, parts))
    if kind == "card":
        digits = "".join(str(turn.randrange(10)) for _ in range(16))
        return digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)
    return f"{turn.randint(1900, 2100)}-{turn.randint(10, 12)}-{turn.randint(10, 31)}"


def _number(turn: random.Random) -> str:
    plain = str(turn.randrange(10 ** turn.randint(1, 15)))
    return turn.choice((plain, f"{plain[:4]}-{plain[4:]}", f"{plain[:2]}.{plain[2:]}",
                        f"{plain[:3]},{plain[3:6]},{plain[6:9]}", "%040x" % turn.getrandbits(160)))


def fit_field(texts: list[str], seed: int = 8) -> Field:
    """Fit weights on texts whose rule spans are taken as the truth, each once as it is, once rewritten, once
    with a near miss and once with an ordinary number in its place."""
    turn = random.Random(seed)
    groups = []
    for text in texts:
        for span in base_spans(text):
            low = max(0, span[1] - STRETCH)
            near = text[low : span[2] + STRETCH]
            kind, begin, end = span[0], span[1] - low, span[2] - low
            for sample, truth in ((near, (kind, begin, end)),
                                  _rewritten(near, (kind, begin, end), turn),
                                  (near[:begin] + _near_miss(kind, turn) + near[end:], None),
                                  (near[:begin] + _number(turn) + near[end:], None)):
                true = {s for s in base_spans(sample) if not truth or s[0] != truth[0]}
                true |= {truth} if truth else set()
                for group in _stretches(candidates(sample)):
                    seen = np.array([features(sample, KINDS[k], b, e) for b, e, k in group])
                    gold = np.array([(KINDS[k], b, e) in true for b, e, k in group], float)
                    groups.append((group, np.array([k for _, _, k in group]), seen, gold))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -2.0
    for epoch in range(EPOCHS):
        slope = np.zeros_like(weights)
        for group, kinds, seen, gold in groups:
            gap = gold - _marginals(group, (weights[kinds] * seen).sum(axis=1))
            np.add.at(slope, kinds, gap[:, None] * seen)
        counts = max(1, len(groups)) / len(KINDS)
        weights += RATE * 8 / (1 + epoch / 10) * (slope / counts - DECAY * weights)
    return Field(weights)


def fit(docs: DataFrame, sample: int = SAMPLE_ROWS) -> Field:
    """Fit on stretches of at most `sample` different rows that may hold personal data, the first by a hash
    of doc_id and stretch. Only the characters around the first possible span of a row are taken.
    The driver gets few more rows than that, however many tasks there are: rows above a bound on the hash, set by their
    number, are left out first."""
    hint = r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]|[0-9]{13}|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
    place = F.regexp_instr("text", F.lit(hint))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", place.alias("place"))
    rows = save(rows.filter("place > 0").select("doc_id", F.substring(
        "text", F.greatest(F.col("place") - STRETCH, F.lit(1)), F.lit(3 * STRETCH)).alias("near"))
        .withColumn("hash", F.xxhash64("doc_id", "near")), "pii-near")
    total, share = rows.count(), 4 * sample
    while True:
        below = rows
        if share < total:
            below = rows.filter(F.col("hash") < F.lit(-(2**63) + 2**64 * share // total))
        chosen = below.distinct().orderBy("hash", "doc_id", "near").limit(sample).collect()
        if len(chosen) == sample or share >= total:
            break
        share *= 4
    discard(rows)
    return fit_field([r.near for r in chosen])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: doc_id, the number of rule spans of each kind, base_sha256 of them,
    and all spans, as kind:begin:end in code points, end exclusive.

    Null text counts as empty; rows that repeat stay; an empty table gives no rows; other columns are not
    looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    counts = [f"n_{kind}" for kind in KINDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text"):
            columns: dict[str, list] = {n: [] for n in (*counts, "base_sha256", "spans")}
            for text in piece.column("text").to_pylist():
                base, every = sent.value.spans(text or "")
                for kind, name in zip(KINDS, counts, strict=True):
                    columns[name].append(sum(s[0] == kind for s in base))
                columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns["spans"].append(joined(every))
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id").cast(pa.int64())} | {
                n: pa.array(v, pa.int64() if n in counts else pa.string())
                for n, v in columns.items()})

    schema = ", ".join(["doc_id bigint", *(f"{n} bigint" for n in counts), "base_sha256 string",
                        "spans string"])
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """`find` with a field fitted on the table itself."""
    return find(docs, fit(docs))
