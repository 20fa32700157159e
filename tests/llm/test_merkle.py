from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from retention_spark.llm import merkle


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def fold(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf what lies left and right of its path, level by level."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for leaf, place in enumerate(at):
            run = runs[place // 8]
            steps[leaf].append(("".join(run[:place % 8]), "".join(run[place % 8 + 1:])))
        at, nodes = [place // 8 for place in at], [digest(*run) for run in runs]
    return nodes[0], steps


def brute(rows):
    """(doc_id, source, lang, n_chars, text) to the result, plainly."""
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        def leaf(t):
            return digest(*map(field, (doc_id, source, lang, n_chars, t)))
        read = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            read = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        trees[lang].append((doc_id is not None, doc_id or 0, leaf(text), leaf(read)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    folded = {lang: fold([r[2] for r in sorted(trees[lang])]) for lang in langs}
    root, above = fold([folded[lang][0] for lang in langs])
    out = []
    for lang, higher in zip(langs, above):
        subroot, steps = folded[lang]
        for (known, doc_id, leaf, again), own in zip(sorted(trees[lang]), steps):
            path = [*own, *higher]
            for left, right in path:
                again = digest(left, again, right)
            out.append((doc_id if known else None, leaf, subroot, root,
                        digest(*(a + b for a, b in path)), again, again == root))
    return sorted(out, key=str)


def docs_from(spark, rows):
    """With columns that nobody asked for."""
    schema = "doc_id long, source string, lang string, n_chars long, text string, " \
             "tree string, digest string, item string, rank long, path string"
    return spark.createDataFrame([(*r, "t", "d", "i", 7, "p") for r in rows], schema)


LANGS = [None, "", "de", "en", "é", "z"]
MANY = [(i, f"s{i % 3}", "en" if i % 3 else LANGS[i % 6], i * 3, f"Text {i}" * (i % 5))
        for i in range(700)]
ODD = [(1, None, None, None, None), (2, "", "", 0, ""), (3, "S", "en", 5, "ABC"), (3, "S", "en", 5, "ABC"),
       (3, "S", "en", 5, "other"), (None, "x", "en", 1, "No id"), (None, None, None, None, "B"),
       (-4, "é", "ünï", 2, "Ä" * 9), (5, "1:a", "en", 12, "x" * 300_000 + "Y")]


@pytest.mark.parametrize("rows", [MANY, ODD, MANY[:1], MANY[1:10], ODD + MANY[:65]])
def test_proofs(spark, rows):
    docs = docs_from(spark, rows).repartition(3)
    got = merkle.verified_documents(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert merkle.verified_documents(docs_from(spark, [])).collect() == []


def test_intervals_nest(spark):
    """Each node lies in one node of the next level, and a level covers every leaf once."""
    below, top, root = merkle.manifest(docs_from(spark, MANY))
    nodes = below.nodes().collect()
    sizes = defaultdict(int)
    for row in MANY:
        sizes["" if row[2] is None else f"={row[2]}"] += 1
    levels = defaultdict(list)
    for n in nodes:
        levels[n.tree, n.level].append((n.low, n.high))
    for (tree, level), spans in levels.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sizes[tree] - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        over = levels.get((tree, level + 1))
        for low, high in spans if over else []:
            assert sum(a <= low and high <= b for a, b in over) == 1
    assert root == top.subroots().first().digest


def test_a_hot_language_is_ranked_by_many_tasks(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "'=en' as tree", "sha2(string(id), 256) as digest")
    got = merkle.ranked(rows.repartition(4), ["doc_id"])
    assert got.filter("rank <> doc_id or size <> 5000").count() == 0
    assert got.count() == 5000
