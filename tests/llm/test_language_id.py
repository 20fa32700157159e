from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from retention_spark.llm import language_id as li


def test_forward_adds_up_all_segmentations():
    names = ["a", "b", "ab", "ba", "aba", "é"]
    pieces = li.Pieces.of(names)
    chances = np.zeros((len(names) + 1, 2))
    chances[:-1] = np.random.default_rng(0).random((len(names), 2))

    def brute(word, k):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            total += math.prod(chances[names.index(p), k] if p in names
                               else li.UNKNOWN if len(p) == 1 else 0 for p in parts)
        return math.log(total)

    texts = ["a", "abab", "aébab", "xaba", "bbbbbbbbbbbbb"]
    got = li.forward(pieces, chances, texts)
    assert np.allclose(got, [[brute(t, k) for k in range(2)] for t in texts])
    long = li.forward(pieces, chances, ["é" * 250])
    assert np.allclose(long, 250 * np.log(chances[5]))


def test_no_segmentation_is_lost_in_long_words(monkeypatch):
    pieces = li.Pieces.of(names := ["a", "b", "ab", "ba", "aba", "abbab"])
    chances = np.zeros((len(names) + 1, 3))
    chances[:-1] = np.random.default_rng(1).random((len(names), 3))
    texts = ["ab" * 300 + "c", "abbab" * 7, "a" * 257, "".join("ab"[i * i % 7 > 3] for i in range(700))]
    blocks = li.forward(pieces, chances, texts)
    monkeypatch.setattr(li, "LONG", 10_000)
    assert np.allclose(blocks, li.forward(pieces, chances, texts))
    for long in (1, 2, 3, 9):
        monkeypatch.setattr(li, "LONG", long)
        assert np.allclose(blocks, li.forward(pieces, chances, texts))


def test_languages_of_long_rows_only_are_learned(docs_of):
    rows = [(i, f"the cat and the dog {i}", "s", "en") for i in range(40)]
    rows += [(100 + i, f"el perro y la casa {i} " * 4000, "s", "es") for i in range(40)]
    rows += [(200, "der Hund und die Katze", "s", "de")] * 3
    model = li.fit(docs_of(rows), sample=10)
    assert model.languages == ["de", "en", "es"]
    names, _ = li.predictions(model, pa.array(["la casa y el perro", "the dog and the cat"]))
    assert names == ["es", "en"]


def test_fitting_raises_the_likelihood():
    pieces = li.Pieces.of(names := ["a", "b", "ab", "c"])
    words, counts = ["ab", "abab", "c", "abc"], np.array([5, 3, 2, 1])
    values = []
    for rounds in (0, 1, 3, 10):
        chance = li.fit_language(pieces, words, counts, len(names), rounds)
        values.append(float(li.forward(pieces, chance[:, None], words)[:, 0] @ counts))
    assert values == sorted(values)


def test_held_out_accuracy_and_odd_rows(spark, small, docs_of):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = li.held_out_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)


def test_odd_rows(docs_of):
    rows = [(i, "the cat and the dog", "s", "en") for i in range(1, 9)]
    rows += [(i, "der Hund und die Katze", "s", "de") for i in range(11, 19)]
    rows += [(20, None), (21, ""), (22, "123 !?"), (23, "the the " * 50_000), (24, "x" * 100_000),
             (25, "日本語"), (None, "der die", "s", None), (26, "und die", "s", None), (26, "the the")]
    docs = docs_of(rows)
    got = li.held_out_predictions(docs).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    named = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id != 26}
    assert [named[i][0] for i in (20, 21, 22)] == ["und"] * 3 and named[20][1] == 0
    assert named[23][0] == "en" and named[None][0] == "de"
    assert sorted(r.lang_pred for r in got if r.doc_id == 26) == ["de", "en"]
    kept = li.with_language(docs)
    gone = {r[0] for r in rows} - {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and gone == {20, 21, 22, 25}  # 25: pieces of no language here
    assert kept.count() == len(rows) - 4
    assert kept.filter("score <> 'q'").count() == 0  # a column of the same name is left alone


@pytest.mark.parametrize("rows", [[], [(5, "text without a language", "s", None)]])
def test_nothing_to_learn_from(docs_of, rows):
    got = li.held_out_predictions(docs_of(rows)).collect()
    assert [r.lang_pred for r in got] == ["und"] * len(rows)


def test_model_of_nothing():
    names, scores = li.predictions(li.Model([], li.Pieces.of(["a"]), np.zeros((2, 0))),
                                   pa.array(["a", None]))
    assert names == ["und", "und"] and scores.tolist() == [0, 0]


def test_foreign_and_garbled_texts_go(spark, small, docs_of):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang")
    odd = [(900_001, "Съешь ещё этих мягких французских булок да выпей чаю"),
           (900_002, "zxqj kkvq wrtp lmnb qqzx vvkp"), (900_003, "これは日本語の文章です。今日は天気がいい"),
           (900_004, "Bu bir Türkçe cümledir ve başka bir dilde yazılmıştır")]
    both = docs.unionByName(docs_of(odd).select(docs.columns))
    kept = {r.doc_id for r in li.with_language(both).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_floors_lie_below_held_out_documents(docs_of):
    rows = [(i, f"the cat and the dog {i}", "s", "en") for i in range(60)]
    model = li.fit(docs_of([*rows, *[(i, "der Hund", "s", "de") for i in (61, 62)]]))
    low = dict(zip(model.languages, li.floors(docs_of(rows), model), strict=True))
    out = pa.array([t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0])
    means = sorted(li.text_scores(model, out)[1].max(axis=1))
    assert means[0] - li.SLACK <= low["en"] <= means[len(means) // 2] - li.SLACK
    assert low["de"] == -1e9


def test_every_document_teaches(docs_of, monkeypatch):
    """Also the last characters of a long row, and a document beyond any sample; adding up over parts is exact."""
    rows = [(i, f"the cat and the dog {i}", "s", "en") for i in range(500)]
    rows += [(1001, "the cat " * 10_000 + "zyzzyva " * 500, "s", "en")]
    model = li.fit(docs_of(rows))
    taught = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    words, counts = np.unique(" ".join(taught).split(), return_counts=True)
    assert "zyzzyva" in words
    names = li.vocabulary_pieces()
    whole = li.fit_language(model.pieces, ["▁" + w for w in words], counts, len(names))
    assert model.languages == ["en"] and np.allclose(model.chances[:, 0], whole, rtol=1e-6, atol=1e-12)
    monkeypatch.setattr(li, "FIT_CHARS", 100)
    assert np.allclose(li.fit(docs_of(rows)).chances[:, 0], whole, rtol=1e-6, atol=1e-12)
    assert model.languages == ["en"] and len(names) + 1 == len(model.chances)


def test_floors_come_from_all_held_out_documents(docs_of):
    out = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "the cat and the dog" if i % 3 else f"zq{i}xv kkw", "s", "en") for i in range(4000)]
    docs = docs_of(rows)
    model = li.fit(docs)
    means = sorted(li.text_scores(model, pa.array([rows[i][1] for i in out]))[1].max(axis=1))
    assert len(out) > 400 and abs(li.floors(docs, model)[0] + li.SLACK - means[-(-len(means) // 4) - 1]) < 1e-9


def test_equal_rows_teach_once(docs_of):
    rows = [(i, f"the cat and the dog {i}", "s", "en") for i in range(1, 9)]
    once, twice = li.fit(docs_of(rows)), li.fit(docs_of([*rows, *rows[:3], rows[0]]))
    assert np.allclose(once.chances, twice.chances, rtol=1e-9)


def test_pieces_are_found_whatever_slots_they_share(monkeypatch):
    """Looked up in tables of slots; a search among all sorted keys for each span took most of the time."""
    monkeypatch.setattr(li, "_SLOTS", 4)  # most keys are in no table
    rng = np.random.default_rng(5)
    names = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(60)})
    pieces = li.Pieces.of(names)
    assert len(pieces._slots[1])
    for length in (1, 3, 6):
        texts = ["".join(rng.choice(list("abéc"), length)) for _ in range(40)]
        seen = set()
        for begin, end, rows, numbers in pieces.spans(li._codes(texts)):
            seen |= {(r, begin, end, names[n]) for r, n in zip(rows.tolist(), numbers.tolist())}
        assert seen == {(r, b, e, t[b:e]) for r, t in enumerate(texts) for b in range(length)
                        for e in range(b + 1, length + 1) if t[b:e] in names}


def test_words_of_small_batches_are_fitted_together(monkeypatch):
    """Each batch's words made groups of their own, and their number set the time."""
    held = li._Held()
    assert not [*held.add(["a"] * 5, [1] * 5), *held.add(["bb"] * 5, [2] * 5)]
    (words_, counts), = held.rest()
    assert words_ == ["a"] * 5 + ["bb"] * 5 and counts.sum() == 15 and not [*held.rest()]
    monkeypatch.setattr(li, "LONG", 4)
    monkeypatch.setattr(li, "FIT_CHARS", 8)
    parts = [*held.add(["abcdefghij", "k"], [3, 1]), *held.rest()]
    assert [w for p, _ in parts for w in p] == ["abcd", "efgh", "ij", "k"]
    assert [c.tolist() for _, c in parts] == [[3, 3], [3, 1]]
