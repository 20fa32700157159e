from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retention_spark.llm import mixing


def _brute_targets(sizes, weights):
    """Water filling by bisection."""
    low, high = 0.0, max(3 * s for s in sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(3 * sizes[k], weights[k] * level) for k in sizes) < sum(sizes.values()):
            low = level
        else:
            high = level
    return {k: min(3 * sizes[k], weights[k] * low) for k in sizes}


def test_targets_fill_up_by_weight(spark, docs_of):
    rows = [(i, "w " * (1 + i % 7), "abcde"[i % 5] if i % 40 else "f") for i in range(600)]
    got = {r.source: r for r in mixing.queued(docs_of(rows)).select(
        "source", "source_size", "target").distinct().collect()}
    sizes = {k: r.source_size for k, r in got.items()}
    weights = {k: 1 + i % 3 for i, k in enumerate(sorted(sizes))}
    want = _brute_targets(sizes, weights)
    assert all(abs(got[k].target - want[k]) < 1e-6 * want[k] for k in want)
    assert any(r.target == 3 * r.source_size for r in got.values())


def test_words_come_near_targets_and_reruns_agree(spark, docs_of):
    rows = [(i, "w " * (i % 9), "abc"[i % 3] if i % 2 else None) for i in range(3000)]
    docs = docs_of(rows)
    first = sorted(map(tuple, mixing.taken_words(docs).collect()), key=str)
    again = sorted(map(tuple, mixing.taken_words(docs.repartition(7)).collect()), key=str)
    assert first == again and len(first) == 3000
    taken = {}
    for _, size, of, target, took in first:
        assert took in (0, size, 2 * size, 3 * size)
        taken[of, target] = taken.get((of, target), 0) + took
    assert all(abs(took - target) <= 9 for (_, target), took in taken.items())


def test_odd_rows(spark, docs_of):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z", "b"),
            (4, "long " * 50_000, "c"), (5, "\x01\x7f \t\n", "c")]
    got = mixing.taken_words(docs_of(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == [
        (False, 1, 0), (False, 2, 0), (False, 3, 2), (False, 3, 2), (False, 4, 50_000),
        (False, 5, 1), (True, 0, 1)]
    assert sum(r.taken for r in got) <= sum(r["size"] for r in got)


def test_mixed_documents_keep_columns_and_order(spark, docs_of):
    docs = docs_of([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(200)])
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    rows = mixed.orderBy("mix_words_before", "mix_finish").collect()
    assert [r.mix_finish for r in rows] == sorted(r.mix_finish for r in rows)
    before = 0
    for r in rows:
        assert r.mix_words_before == before
        before += len(r.text.split())
    sums = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    took = mixed.groupBy("doc_id").agg(F.sum(mixing.size_in_words(F.col("text"))).alias("n"))
    assert {r.doc_id: r.n for r in took.collect()} == {k: v for k, v in sums.items() if v}


@pytest.mark.parametrize("run", [mixing.mix, mixing.taken_words])
def test_empty_table(docs_of, run):
    assert run(docs_of([])).collect() == []


def test_rows_that_differ_in_another_column_are_all_mixed(docs_of):
    """None of two rows with equal doc_id, source and text takes the other's place."""
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "de"), (1, "a b c", "s", None), (2, "d e", "s", "en"),
            (2, "d e", "s", "en")]
    got = mixing.mix(docs_of(rows), weights=(1,), repeats=1).collect()
    assert sorted(map(str, ((r.doc_id, r.lang) for r in got))) == sorted(map(str, ((r[0], r[3]) for r in rows)))
