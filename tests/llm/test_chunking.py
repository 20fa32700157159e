from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from retention_spark.llm import chunking as c


def _words(seed, n):
    turn = random.Random(seed)
    return " ".join("".join(turn.choices("abcdefghij", k=turn.randint(2, 9))) for _ in range(n))


def test_hash_looks_back_on_so_many_bytes():
    data = np.random.default_rng(1).integers(0, 256, 200, np.uint8)
    want = [sum(int(c._GEAR[data[i - k]]) << k for k in range(min(c.REACH, i + 1))) % 2**32
            for i in range(200)]
    assert c.gear_hash(data).tolist() == want


def test_chunks_cover_texts_and_resist_insertions():
    text = _words(1, 3000)
    texts = [text, text[:5000] + "inserted" + text[5000:], "", None, "é", "a" * 1000]
    owner, begins, ends, digest, raw = c.chunks(pa.array(texts))
    for i, t in enumerate(texts):
        mine = owner == i
        assert b"".join(raw[a:b] for a, b in zip(begins[mine], ends[mine], strict=True)) == (
            t or "").encode()
    assert (ends - begins).max() <= c.MOST
    a, b = (set(map(tuple, digest[owner == k])) for k in (0, 1))
    assert len(a - b) <= 3 and len(b - a) <= 4


def _brute(rows):
    """The same by plain loops over the chunks of each text."""
    cut = {}
    for doc_id, text in rows:
        _, begins, ends, digest, raw = c.chunks(pa.array([text], pa.string()))
        cut.setdefault(doc_id, []).append((begins, ends, [tuple(d) for d in digest.tolist()], raw))
    holders = {}
    for doc_id, parts in cut.items():
        for part in parts:
            for d in part[2]:
                if doc_id is not None:
                    holders.setdefault(d, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        _, begins, ends, digest, raw = c.chunks(pa.array([text], pa.string()))
        gone = np.array([doc_id is not None and min(holders[tuple(d)]) < doc_id
                         for d in digest.tolist()], bool)
        spans = c.runs(begins, ends, gone)
        kept = c.remaining(raw, spans)
        out.append((doc_id, len(raw), len(raw) - len(kept), ",".join(f"{a}:{b}" for a, b in spans),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_dedup_equals_brute_force(docs_of):
    passage = _words(2, 120)
    rows = [(i, _words(10 + i, 80) + " " + passage + _words(90 + i, 60)) for i in range(12)]
    rows += [(20, None), (21, ""), (3, rows[3][1]), (3, _words(7, 50) + passage), (None, passage),
             (22, _words(3, 40_000)), (23, "clean " + _words(4, 500)), (24, rows[2][1])]
    got = c.chunk_dedup(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)
    by = {r.doc_id: r for r in got}
    assert by[23].n_removed == 0 and by[0].n_removed == 0 and by[24].n_removed == by[24].n_bytes
    assert all(by[i].n_removed > len(passage) / 2 for i in range(4, 12))


def test_short_copies_go_whole(docs_of):
    """Inside a text runs as short stay."""
    rows = [(1, "a short line of 28 bytes, é."), (2, "a short line of 28 bytes, é."), (3, "b"), (4, "b"),
            (5, "a short line of 28 bytes, é. " + _words(5, 40))]
    by = {r.doc_id: r for r in c.chunk_dedup(docs_of(rows)).collect()}
    assert [by[i].n_removed for i in (1, 2, 3, 4, 5)] == [0, 29, 0, 1, 0]
    assert by[2].spans == "0:29" and by[4].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(docs_of):
    assert c.chunk_dedup(docs_of([])).collect() == []
