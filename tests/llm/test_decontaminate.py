from __future__ import annotations

import random

from retention_spark.llm import decontaminate as d

ITEM = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls look on"


def _distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_table():
    turn = random.Random(1)
    for _ in range(400):
        pattern = "".join(turn.choices("abé", k=turn.randint(1, 90)))
        text = "".join(turn.choices("abé", k=turn.randint(0, 120)))
        got = d.least_distance(pattern, text, len(pattern) - 1)
        assert (got[0] if got else len(pattern)) == _distance(pattern, text)


def test_matcher_equals_brute_force():
    turn = random.Random(2)
    items = [(i, "".join(turn.choices("abcd ", k=60))) for i in range(20)]
    matcher = d.Matcher(items)
    for _ in range(200):
        item = list(d.plain(turn.choice(items)[1]))
        for _ in range(turn.randint(0, 8)):
            item[turn.randrange(len(item))] = turn.choice("abcdx")
        text = "".join(turn.choices("abcd ", k=50)) + "".join(item) + "zz"
        want = {i: _distance(d.plain(t), d.plain(text)) for i, t in items}
        got = {i: n for i, n, _, _ in matcher.find(text)}
        assert got == {i: n for i, n in want.items()
                       if n <= len(d.plain(items[i][1])) * d.ERROR_PERCENT // 100}


def _benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows],
                                 "item_id long, text string, doc_id string")


def test_leaks(spark, docs_of):
    odd = ITEM.upper().replace(" ", " *** ").replace("FOX", "FOXX")
    rows = [(1, f"before it {ITEM}. after"), (2, odd), (3, None), (4, ""), (5, ITEM[:50]),
            (6, "x " * 100_000 + ITEM), (7, "short one!"), (7, "a short one"), (None, ITEM), (1, "é")]
    items = [(10, ITEM), (11, "Short, one"), (12, None), (13, ""), (14, ITEM)]
    got = d.leaks(docs_of(rows), _benchmark(spark, items)).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted(
        [(i, k, n) for i, n in ((1, 0), (2, 1), (6, 0), (None, 0)) for k in (10, 14)]
        + [(7, 11, 0), (7, 11, 0)], key=str)
    first = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][first.begin : first.end] == ITEM


def test_items_in_several_blocks_and_kept_documents(spark, docs_of, monkeypatch):
    monkeypatch.setattr(d.item_blocks, "__defaults__", (64,))
    docs = docs_of([(1, ITEM), (2, "clean text"), (3, None), (4, ITEM[::-1])])
    items = _benchmark(spark, [(i, ITEM[::-1] if i == 3 else f"{i} {ITEM[i:]}") for i in range(5)])
    assert {r.doc_id for r in d.leaks(docs, items).collect()} == {1, 4}
    kept = d.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_empty_tables(spark, docs_of):
    items = _benchmark(spark, [(1, ITEM)])
    assert d.leaks(docs_of([]), items).collect() == []
    assert d.leaks(docs_of([(1, ITEM)]), items.limit(0)).collect() == []
    assert d.without_leaks(docs_of([(1, ITEM)]), items.limit(0)).count() == 1


def test_short_items_are_met_as_whole_words(spark, docs_of):
    capital = "The capital of France is Paris"
    docs = docs_of([(1, f"I know: {capital.upper()}! It is."), (2, f"{capital}ian"), (3, capital),
                    (4, "the capital of France is  Pari"), (5, "日本の首都は東京です"), (6, f"x{capital}"),
                    (7, f"{capital}ian, or {capital}.")])
    items = _benchmark(spark, [(1, capital), (2, "首都は東京"), (3, " .")])
    got = {(r.doc_id, r.item_id): (r.begin, r.end) for r in d.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (3, 1), (5, 2), (7, 1)}
    assert got[1, 1] == (8, 38) and got[3, 1] == (0, 30) and got[7, 1] == (38, 68)
    assert sorted(r.doc_id for r in d.without_leaks(docs, items).collect()) == [2, 4, 6]


def test_first_of_equally_near_places():
    """Regions of different pieces overlap and come out of order; the first best place counts."""
    turn = random.Random(7)
    for _ in range(3):
        item = "".join(turn.choices("abc", k=50))
        near = item[:20] + "x" + item[21:]
        text = "zz".join([near, "".join(turn.choices("abc", k=9)), near, item[25:] + near])
        (_, distance, begin, end), = d.Matcher([(1, item)]).find(text)
        ends = [e for e in range(len(text) + 1) if any(
            _distance_whole(item, text[b:e]) == distance for b in range(max(0, e - 54), e))]
        assert end == ends[0] and _distance_whole(item, text[begin:end]) == distance


def _distance_whole(pattern, text):
    row = list(range(len(text) + 1))
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]
