from __future__ import annotations

import hashlib

import pytest

from retention_spark.llm import exact_dedup

ROWS = [(1, "Same"), (7, "sAME"), (4, "same"), (2, "same "), (3, None), (9, ""), (5, "Ä"), (6, "ä"),
        (8, "x" * 300_000), (10, "X" * 300_000), (11, "twice"), (11, "twice"), (None, "same"),
        (None, "alone")]


def _brute(rows):
    upper = {c: c + 32 for c in range(65, 91)}
    groups, out, seen = {}, [], set()
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(upper), []).append(doc_id)
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for doc_id in ids:
            out.append((doc_id, keep, len(ids), doc_id == keep and (norm, keep) not in seen,
                        hashlib.sha256(norm.encode()).hexdigest()))
            if doc_id == keep:
                seen.add((norm, keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups(docs_of, bits):
    """With 3 bits of hash, chains hold different texts and buckets overflow."""
    got = exact_dedup.exact_groups(docs_of(ROWS), capacity=2, hash_bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == _brute(ROWS)


def test_buckets_split_until_they_fit(spark, docs_of):
    keys = spark.range(5000).selectExpr("xxhash64(id) as hash")
    found = exact_dedup.directory(keys, 80).collect()
    assert len({r.bucket for r in found}) == len(found) and len({r.depth for r in found}) > 1
    for r in found:
        mask = (-1 << (64 - r.depth)) & (2**64 - 1)
        held = [k for (k,) in keys.collect() if (k & mask) == (r.bucket & mask)]
        assert 0 < len(held) <= 80
    crowd = spark.range(3).selectExpr("5L as hash")  # one key alone can't be split
    assert [r.bucket for r in exact_dedup.directory(crowd, 2).collect()] == [0]


def test_every_hash_is_found_through_the_directory(spark):
    """Whatever the depth of its bucket, which is the only one with the hash's first bits."""
    keys = spark.range(3000).selectExpr("xxhash64(id) as hash", "id").union(
        spark.range(40).selectExpr("-2L - shiftleft(id, 48) as hash", "id")).union(  # alike at first
        spark.range(40).selectExpr("shiftleft(id, 48) as hash", "id"))
    buckets = exact_dedup.directory(keys, 20)
    entries = [tuple(r) for r in buckets.collect()]
    assert max(d for _, d in entries) > min(d for _, d in entries) + 2

    def first(value, depth):
        return (value & (2**64 - 1)) >> (64 - depth)

    found = exact_dedup.locate(keys, buckets).collect()
    assert sorted((r.hash, r.id) for r in found) == sorted(map(tuple, keys.collect()))
    for r in found:
        assert [(b, d) for b, d in entries if first(b, d) == first(r.hash, d)] == [
            (r.bucket, r.depth)]


def test_hashes_are_filed_by_bucket(spark, docs_of):
    """Hashes that occur once too, each bucket in one file, and files in ranges of buckets."""
    docs = docs_of([(i, f"text {i % 300}") for i in range(400)])
    records = exact_dedup.hashed(docs).selectExpr("doc_id", "hash", "sha2(text, 256) as text_sha256")
    index = exact_dedup.build_index(docs, records, capacity=8)
    rows = index.keys.selectExpr("*", "input_file_name() as file").collect()
    assert len(rows) == 300 and sum(r.records for r in rows) == 400
    files = {}
    for r in rows:
        files.setdefault(r.file, []).append(r.bucket)
    ranges = sorted((min(b), max(b)) for b in files.values())
    assert all(a[1] < b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))
    held = {(r.hash, r.bucket) for r in rows if r.records > 1}
    assert {(r.hash, r.bucket) for r in index.chains.collect()} == held and len(held) == 100


def test_kept_documents_keep_columns(docs_of):
    docs = docs_of(ROWS)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r[0]) for r in _brute(ROWS) if r[3])


def test_empty_table(docs_of):
    assert exact_dedup.exact_groups(docs_of([])).collect() == []
    assert exact_dedup.keep_one(docs_of([])).collect() == []
