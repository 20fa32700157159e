from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from retention_spark.llm import quality as q
from tests.test_plans import plan_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return (n, sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""),
            len(lines) - len(set(lines)), len(repeated), failed), len(lines)


def shares(counts, n_lines):
    n, chars, symbols, dup, repeat, _ = counts
    share = lambda a, b, unit=10_000: a * unit // b if b else 0
    return {"word_length": share(chars, n, 100), "symbol_share": share(symbols, chars),
            "dup_line_share": share(dup, n_lines), "repeat_share": share(repeat, n)}


def low(value):
    """The least value of its bucket: the first BITS + 1 bits are kept."""
    drop = max(value.bit_length() - 1 - q.BITS, 0)
    return value >> drop << drop


def bounds(rows, min_docs):
    out = []
    for rule in q.RULES:
        values = sorted(low(r[rule.name]) for r in rows)
        if not values:
            return None
        # Rank by the share of the rows before it.
        at = lambda p: values[(len(values) - 1) * p // 4]
        reach = max(at(3) - at(1), rule.slack) * q.FENCES
        out.append(at(3) + reach if rule.upper else at(1) - reach)
    return out if len(rows) >= min_docs else None


def brute(rows, min_docs):
    held = []
    for doc_id, text, source, lang in rows:
        counts, n_lines = base(text)
        held.append((doc_id, source, lang, counts, shares(counts, n_lines)))
    fine = [r for r in held if not r[3][-1]]
    out = []
    for doc_id, source, lang, counts, own in held:
        found = (bounds([r[4] for r in fine if r[1:3] == (source, lang)], min_docs)
                 or bounds([r[4] for r in fine if r[2] == lang], min_docs)
                 or bounds([r[4] for r in fine], 0) or [None] * len(q.RULES))
        passes = all(b is None or (own[r.name] <= b if r.upper else own[r.name] >= b)
                     for r, b in zip(q.RULES, found))
        out.append((doc_id, *counts, not counts[-1] and passes, *found))
    return sorted(out, key=str)


def made(seed=0, n=150):
    r = random.Random(seed)
    words = ["alpha", "be", "gamma", "delta##", "épsilon", "z" * 12, "eta", "*", "Theta", "io"]
    rows = []
    for i in range(n):
        lines = [" ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(r.randint(0, 12))]
        if r.random() < 0.3 and lines:
            lines += r.choices(lines, k=3)
        rows.append((i, r.choice(["\n", "\n", " \n\t"]).join(lines), r.choice(["a", "a", "b", None]),
                     r.choice(["en", "en", "de", None, ""])))
    return rows


ODD = [(1, None, None, None), (2, "", "", ""), (3, " \t\x0b\x0c\r\n ", "a", "en"), (4, "one", "a", "en"),
       (5, "a b c d e", "a", "en"), (6, "a b c d e a b c d e", "a", "en"),
       (7, "x y " * 20, "a", "en"), (8, "same line\r\nsame line\nsame line\n", "a", "en"),
       (9, " ".join(f"w{i}" for i in range(60_000)), "a", "en"), (10, "q " * 3000 + "#" * 500, "b", "en"),
       (11, "|" * 400 + " " + " ".join(f"k{i}" for i in range(30)), "a", "en"),
       (4, "one", "a", "en"), (None, " ".join(f"v{i}" for i in range(20)), "a", "en"),
       (12, "y" * 200_000, "a", "en")]


@pytest.mark.parametrize("min_docs", [1, 20])
@pytest.mark.parametrize("rows", [made(), ODD, ODD + made(3), ODD[:1]])
def test_quality(docs_of, rows, min_docs):
    got = q.quality(docs_of(rows).repartition(3), min_docs=min_docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, min_docs)


def test_something_fails_by_the_adaptive_rules_only(docs_of):
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(50)), "s", "en") for i in range(100)]
    noisy = (500, " ".join(f"$$$%%% word{k}" for k in range(50)), "s", "en")
    got = {r.doc_id: r for r in q.quality(docs_of([*clean, noisy])).collect()}
    assert not got[500].base_failed and not got[500].kept
    assert all(got[i].kept for i in range(100))


def test_empty_table(docs_of):
    assert q.quality(docs_of([])).collect() == []
    assert q.well_made(docs_of([])).collect() == []


def test_kept_documents_keep_columns(docs_of):
    rows = ODD + made(5)
    docs = docs_of(rows)
    kept = q.well_made(docs, min_docs=20)
    assert kept.columns == docs.columns
    wanted = [str(r[0]) for r in brute(rows, 20) if r[7]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(wanted)


def test_sketches_merge(docs_of):
    """Sketches of parts give the sketch of all, and quantiles are off by one part in 2**BITS."""
    rows = q.measured(docs_of(made(9, 400)))
    parts = [q.sketch(rows.filter(f"doc_id % 3 = {i}"), ["lang_key"]) for i in range(3)]
    whole = q.sketch(rows, ["lang_key"])
    assert sorted(map(str, q.merged(parts, ["lang_key"]).collect())) == sorted(map(str, whole.collect()))
    found = q.quantiles(q.merged(parts, []), [], {"mid": (1, 2)}).collect()
    for r in found:
        values = sorted(v[0] for v in rows.select(r.measure).collect())
        exact = values[(len(values) - 1) // 2]
        assert r.docs == 400 and r.mid <= exact <= r.mid * (1 + 2**-q.BITS) + 1


def test_buckets(spark):
    from pyspark.sql import functions as F
    values = [0, 1, 127, 128, 255, 256, 257, 1000, 2**31, 2**40 + 12345, 2**62 + 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", q.bucket_low(q.bucket(F.col("v"))).alias("low")).collect()
    assert [r.low for r in got] == [low(r.v) for r in got]


def test_no_python_in_tasks(docs_of):
    assert not re.search(r"Python|Arrow|Pandas", plan_of(q.measured(docs_of(made()))))
