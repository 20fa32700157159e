from __future__ import annotations

import random
import re

import numpy as np

from retention_spark.llm import near_dedup
from retention_spark.llm.components import smallest_reachable


def _set(text):
    upper = {c: c + 32 for c in range(65, 91)}
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(upper))
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def _brute(rows):
    sets = [(d, _set(t)) for d, t in rows]
    label = {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(d), root(e)))
                label[b] = a
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def _cluster(seed, size, edits):
    turn = random.Random(seed)
    base = [turn.choice("abcdefgh") + str(turn.randrange(50)) for _ in range(120)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(turn.randrange(edits)):
            copy[turn.randrange(len(copy))] = f"e{turn.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_components_equal_brute_force(docs_of):
    texts = _cluster(1, 60, 9) + _cluster(2, 30, 5) + _cluster(3, 3, 2)
    texts += [None, "", " \n", "One two", "one  TWO", "one two three", "w " * 40_000, "w " * 9]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    got = near_dedup.near_groups(docs_of(rows))
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_small_blocks_lose_no_link(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    rows = list(enumerate(_cluster(4, 70, 12)))
    got = near_dedup.near_groups(docs_of(rows))
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_prefix_filter_is_exact():
    turn = np.random.default_rng(0)
    sets = [np.unique(turn.integers(0, 60, 40).astype(np.uint64)) for _ in range(80)]
    found = near_dedup.connecting_links(sets, list(range(80)))
    label = list(range(80))
    for i, j in found:
        label = [label[i] if x == label[j] else x for x in label]
    for i in range(80):
        for j in range(i):
            assert label[i] == label[j] or not near_dedup.similar(sets[i], sets[j])


def test_repeated_and_missing_ids(docs_of):
    same = "a b c d e f g h"
    rows = [(5, same), (5, same), (2, same.upper()), (None, same), (None, "other words"), (9, "x y")]
    got = near_dedup.near_groups(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(5, 2, False), (5, 2, False), (2, 2, True), (None, 2, False), (None, None, True),
         (9, 9, True)], key=str)


def test_kept_documents(docs_of):
    docs = docs_of([(3, "a b c d e f"), (1, "A b c d e f"), (2, None)])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_empty_table(docs_of):
    assert near_dedup.near_groups(docs_of([])).collect() == []


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80)], "a long, b long")
    got = {r.node: r.component for r in smallest_reachable(links).collect()}
    assert got == {i: 0 for i in range(51)} | {80: 80, 90: 80}
