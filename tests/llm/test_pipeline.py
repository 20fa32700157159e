from __future__ import annotations

import re

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as contract
from retention_spark.llm import decontaminate, mixing, queries
from tools.compare import connect, differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    got = contract.queries()[name](spark, small)
    assert differences(got, connect(small).sql(queries.ORACLE_SQL[name])) == []


def test_every_operator_has_one_query():
    found = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))


def _shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) or frozenset([
        tuple(found)])


def _survivors(folder):
    """What the filtering stages keep, by plain loops."""
    read = duckdb.connect().sql
    rows = dict(read(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    rows = {d: t for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    last = {}
    for d, t in rows.items():
        norm = t.translate({c: c + 32 for c in range(65, 91)})
        last[norm] = max(d, last.get(norm, d))
    rows = {d: rows[d] for d in last.values()}
    sets = {d: _shingles(t) for d, t in sorted(rows.items())}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    filed = {}
    for d, s in sets.items():
        for e in {e for x in s for e in filed.get(x, ())}:
            if 100 * len(s & sets[e]) >= 75 * len(s | sets[e]):
                a, b = sorted((root(d), root(e)))
                label[b] = a
        for x in s:
            filed.setdefault(x, []).append(d)
    matcher = decontaminate.Matcher(
        read(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall())
    return {d: rows[d] for d in sets if root(d) == d and not matcher.find(rows[d])}


def test_pipeline_keeps_what_plain_loops_keep(spark, small):
    mixed = corpus_pipeline.run(spark, small).collect()
    kept = _survivors(small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = docs.filter(docs.doc_id.isin(list(kept)))
    want = {r.doc_id: r.taken // r["size"] for r in mixing.taken_words(left).collect()
            if r["size"] and r.taken}
    got = {}
    for r in mixed:
        assert kept[r.doc_id] == r.text
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    assert set(docs.columns) <= set(mixed[0].__fields__)


def test_stages_handle_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).collect() == []
