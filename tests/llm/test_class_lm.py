from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from retention_spark.llm import class_lm

UPPER = {c: c + 32 for c in range(65, 91)}


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), None]


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _corpus():
    turn = random.Random(5)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(w for _ in range(turn.randint(0, 40))
                         for w in (turn.choice(nouns), turn.choice(verbs)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "N1 \t\n v2"), (1003, "never-seen " * 3),
             (1004, "n1 v1 " * 20_000), (1004, "n1 v1"), (None, "n3 v4 rare")]
    return rows


def test_figures_equal_brute_force_and_classes_help(docs_of, monkeypatch):
    monkeypatch.setattr(class_lm, "LEXICON", 50)  # the other words are looked up
    rows = _corpus()
    got = class_lm.held_out_scores(docs_of(rows)).collect()
    seen = Counter(t for d, x in rows if not _held_out(d) for t in _tokens(x))
    total, kinds = sum(seen.values()), len(seen)
    want = sorted(((d, _held_out(d), len(t := _tokens(x)), sum(seen[w] > 0 for w in t), total,
                    round(sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in t), 6))
                   for d, x in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in got), key=str) == want
    out = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.95
    assert all(r.score < 0 for r in got)


def test_exchange_finds_the_classes():
    """Words of two kinds that take turns part into classes of one kind each."""
    turn = np.random.default_rng(1)
    side = 40
    bigrams = np.zeros((side + 2, side + 2))
    kind = np.arange(side) % 3 % 2
    for _ in range(20_000):
        a, b = turn.integers(0, side, 2)
        bigrams[a, b] += kind[a] != kind[b]
    of = class_lm.exchange(bigrams, classes=4)
    assert all(len({kind[i] for i in range(side) if of[i] == c}) <= 1 for c in range(4))


def test_exchange_never_lowers_the_likelihood():
    bigrams = np.random.default_rng(2).poisson(1.5, (32, 32)).astype(float)

    def value(of):
        table = np.zeros((7, 7))
        np.add.at(table, (of[:, None], of[None, :]), bigrams)

        def f(x):
            return (x[x > 0] * np.log(x[x > 0])).sum()

        return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))

    values = [value(class_lm.exchange(bigrams, 5, sweeps)) for sweeps in (0, 1, 2, 4, 8)]
    assert values == sorted(values) and values[-1] > values[0]


def test_chances_of_known_and_unknown_words_add_up_to_one():
    """Over all words of all classes, and the unknown one."""
    turn = np.random.default_rng(3)
    wide = class_lm.UNKNOWN + 1
    table = np.zeros((wide, wide, wide))
    used = turn.integers(0, wide - 1, (400, 3))
    np.add.at(table, tuple(used.T), 5)
    single = table.sum(axis=(0, 1))
    words = [np.full(4, n / 4) for n in single]  # four words of each class
    kinds = np.where(single > 0, 4, 0)
    chance = 10 ** class_lm.log_chances(table, kinds.astype(float))
    for a, b in used[:20, :2]:
        known = sum(chance[a, b, c] * (w - class_lm.DISCOUNT).sum()
                    for c, w in enumerate(words) if single[c])
        assert abs(known + chance[a, b, class_lm.UNKNOWN] - 1) < 1e-9


def test_nothing_to_learn_from(docs_of):
    out = next(i for i in range(99) if _held_out(i))
    row, = class_lm.held_out_scores(docs_of([(out, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == 0 and row.score <= 0
    assert class_lm.held_out_scores(docs_of([])).collect() == []


def _value(rows, of):
    """Log likelihood of the class bigrams of whole texts, but for a constant."""
    pairs = Counter()
    for _, text in rows:
        classes = [class_lm.END if w is None else of[w.encode()] for w in [None, *_tokens(text)]]
        pairs.update(p for p in zip(classes, classes[1:], strict=False) if len(classes) > 2)
    left, right = Counter(), Counter()
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
    return sum(sign * n * math.log(n) for sign, c in ((1, pairs), (-1, left), (-1, right))
               for n in c.values())


def test_clustering_knows_every_neighbour_and_goes_on_while_the_likelihood_rises(
        docs_of, monkeypatch):
    monkeypatch.setattr(class_lm, "CORE", 10)
    rows, found = _corpus(), []
    for lexicon in (200_000, 7):  # a small one leaves most neighbours to the join
        monkeypatch.setattr(class_lm, "LEXICON", lexicon)
        model = class_lm.fit(docs_of(rows))
        found.append({bytes(r.word): r["class"] for r in model.vocabulary.collect()})
        values = model.likelihoods
        assert all(a < b for a, b in zip(values[:-1], values[1:-1], strict=False))
        assert len(values) >= 2 and values[-1] <= values[-2]
        assert math.isclose(_value(rows, found[-1]), values[-2], rel_tol=1e-9)
    assert found[0] == found[1]


def test_steps_do_not_read_the_text_again(docs_of, spark, monkeypatch):
    """Nor do results depend on how words are dealt to blocks."""
    monkeypatch.setattr(class_lm, "CORE", 10)
    monkeypatch.setattr(class_lm, "LEXICON", 10)
    rows, found = _corpus(), []
    for block in (1 << 21, 2000):
        monkeypatch.setattr(class_lm, "BLOCK", block)
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        docs = docs_of(rows).select("text").mapInArrow(counted, "text string")
        model = class_lm.fit(docs)
        assert len(model.likelihoods) >= 2
        assert read.value == 3 * len(rows)  # words, texts, neighbours
        found.append({bytes(r.word): (r.n, r["class"]) for r in model.vocabulary.collect()})
    assert found[0] == found[1]


def test_different_words_have_different_ids():
    some = sorted({bytes(x) for n in (1, 7, 8, 9, 16, 63, 64, 65, 200)
                   for x in (b"a" * n, b"a" * (n - 1) + b"b", b"a" * (n - 1) + bytes(1), b"b" + b"a" * (n - 1))})
    ids = class_lm._ids(pa.array(some, pa.binary()), 0)
    assert len(set(ids.tolist())) == len(some)
    assert class_lm._ids(pa.array(some[::-1], pa.large_binary()), 0).tolist() == ids[::-1].tolist()
    assert not set(ids.tolist()) & set(class_lm._ids(pa.array(some, pa.binary()), 1).tolist())
