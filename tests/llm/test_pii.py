from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from retention_spark.llm import pii


def _rules(text):
    """The rules as plain patterns."""
    out = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_rule_spans_equal_plain_patterns():
    turn = random.Random(1)
    parts = ["1", "2", "55", "255", ".", "@", "a.b", "-", " ", "+", "(", ")", "4111111111111111", "%",
             "é", "00", "x"]
    for _ in range(20_000):
        text = "".join(turn.choices(parts, k=turn.randint(0, 25)))
        assert pii.base_spans(text) == _rules(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "1." * 200_000, "a" * 300_000 + "@", "+1 " * 100_000,
                                  "0" * 9000 + "1.1.1.1", "1 " * 200_000, "@" * 100_000])
def test_long_texts_take_linear_time(text):
    field = pii.Field(np.zeros((len(pii.KINDS), len(pii.FEATURES))))
    field.weights[:, 0] = -1
    base, every = field.spans(text)
    assert set(base) <= set(every)


def test_best_segmentation_equals_brute_force():
    turn = random.Random(2)
    for _ in range(300):
        spans = sorted({(b := turn.randrange(20), b + turn.randint(1, 8), turn.randrange(4))
                        for _ in range(turn.randint(1, 8))}, key=lambda c: (c[1], c[0], c[2]))
        scores = [turn.uniform(-1, 2) for _ in spans]
        best = 0.0
        chances = np.zeros(len(spans))
        total = 0.0
        for pick in itertools.product([0, 1], repeat=len(spans)):
            chosen = sorted(s for s, p in zip(spans, pick, strict=True) if p)
            if any(a[1] > b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                continue
            value = sum(x for x, p in zip(scores, pick, strict=True) if p)
            best = max(best, value)
            total += np.exp(value)
            chances += np.exp(value) * np.array(pick)
        got = pii.best_segments(spans, scores)
        assert abs(sum(scores[i] for i in got) - best) < 1e-9
        assert np.allclose(pii._marginals(spans, np.array(scores)), chances / total)


@pytest.fixture(scope="module")
def field():
    turn = random.Random(3)
    texts = []
    for i in range(150):
        digits = [turn.randrange(10) for _ in range(15)]
        card = "".join(map(str, digits))
        card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
        texts += [f"the thing is u{i}@mail{i % 9}.example.com here",
                  f"and +1 ({200 + i}) 555-{1000 + i} there",
                  f"from {i}.{i + 3}.7.{i + 9} of it", f"for {card} only"]
    return pii.fit_field(texts)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail me: john.doe [at] mail (dot) com now", "email", "john.doe [at] mail (dot) com"),
    ("tel 555-123-4567 ok", "phone", "555-123-4567"),
    ("card 4111.1111.1111.1111 end", "card", "4111.1111.1111.1111"),
    ("7536784127813050 4845168114407329", "card", "7536784127813050"),
    ("to john [at] internationalconsulting [dot] com ok", "email",
     "john [at] internationalconsulting [dot] com"),
    ("to averyveryverylonglocal.partofanaddress4u [at] mail [dot] example [dot] org ok", "email",
     "averyveryverylonglocal.partofanaddress4u [at] mail [dot] example [dot] org"),
    ("see first.last (at) some-host.example.com, too", "email",
     "first.last (at) some-host.example.com"),
    ("from 10[dot]2[dot]33[dot]4 it", "ip", "10[dot]2[dot]33[dot]4"),
])
def test_field_adds_what_the_rules_miss(field, text, kind, span):
    base, every = field.spans(text)
    assert set(base) <= set(every)
    assert (kind, text.index(span), text.index(span) + len(span)) in every


@pytest.mark.parametrize("text", [
    "in 2019-04-05 we had 12345 items and 3.14.15", "version 1.2.3.4000 of 300.1.1.1", "at home",
    "order 1234567890123 id", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "", "1,000,000"])
def test_field_leaves_other_numbers_alone(field, text):
    assert field.spans(text) == ([], [])


def test_candidates_are_all_spans_between_bounds():
    """As found by trying every pair of places in short texts."""
    turn = random.Random(4)
    parts = ["12", "4", "345 ", "555-", "1.2", ".", "(", ")", " ", "+1", "a", "bc", "@", "x.y", "[at]",
             " [dot] ", "-", ",", "41111111111111"]
    mark = r"\s?\[at\]\s?|@"
    dot = r"\s?\[dot\]\s?|\."
    word = r"[A-Za-z0-9]++"
    address = re.compile(rf"{word}(?:{dot}|{word}|[_%+-])*(?:{mark})(?:{word}|[_%+-])*(?:{dot})"
                         rf"(?:{dot}|{word}|[_%+-])*(?<=[A-Za-z0-9])")
    number = re.compile(r"[0-9]+(?:(?:\s?\[dot\]\s?|[ ._/()-]{1,3})[0-9]+)*")
    for _ in range(400):
        text = "".join(turn.choices(parts, k=turn.randint(0, 9)))
        want = set()
        for a, b in itertools.combinations(range(len(text) + 1), 2):
            alnum = [c.isalnum() for c in (text[a - 1 : a] or " ", text[b : b + 1] or " ")]
            if address.fullmatch(text, a, b) and not any(alnum):
                want.add((a, b, 0))
            inside = number.fullmatch(text, a, b)
            if inside and not text[a - 1 : a].isdigit() and not text[b : b + 1].isdigit():
                digits = len(re.sub("[^0-9]", "", inside[0]))
                gaps = re.findall("[^0-9]+", inside[0])
                if digits > 19 or len(gaps) >= pii.MOST_NUMBERS:
                    continue
                if len(gaps) == 3 and all("." in g or "dot" in g for g in gaps):
                    want.add((a, b, 1))
                if digits >= 13:
                    want.add((a, b, 2))
                if 7 <= digits <= 15:
                    want.add((a, b, 3))
        got = {c for c in pii.candidates(text) if text[c[0]] not in "+("}
        # A word of an address ends where its mark's own letters begin.
        assert got == {c for c in want if not text[c[0] : c[1]].startswith(("at]", "dot]"))}, text


def test_query_on_odd_rows(docs_of):
    rows = [(1, "é a@b.co 😀 +1 (743) 555-3824"), (2, None), (3, ""), (1, "1.2.3.4"),
            (None, "x@y.zz"), (4, "word " * 60_000 + "4111 1111 1111 1111")]
    got = pii.personal_data(docs_of(rows)).collect()
    want = []
    for doc_id, text in rows:
        base = _rules(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(s[0] == k for s in base) for k in pii.KINDS]
        want.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    assert pii.personal_data(docs_of([])).collect() == []
