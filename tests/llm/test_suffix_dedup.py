from __future__ import annotations

import hashlib
import random

import pytest

from retention_spark.llm import suffix_dedup as s


def _brute(rows):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49 if doc_id is not None else 0):
            w = data[i : i + 50]
            first[w] = min(doc_id, first.get(w, doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49 if doc_id is not None else 0):
            if first[data[i : i + 50]] < doc_id:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _rows(seed):
    turn = random.Random(seed)
    base = ["".join(turn.choices("abé ", k=turn.randint(40, 400))) for _ in range(6)]
    rows = []
    for doc_id in range(50):
        text = ""
        for _ in range(turn.randint(0, 5)):
            b = turn.choice(base)
            i = turn.randrange(len(b))
            text += b[i : i + turn.randint(20, 200)]
            text += turn.choice(["", "x", "ab" * 60, "\0\0", "q" * 70])
        rows.append((doc_id, text))
    return [*rows, (60, None), (61, ""), (3, rows[3][1]), (5, rows[7][1]), (None, rows[4][1]),
            (63, rows[10][1]), (64, "ab" * 50_000), (65, "z" + "ab" * 40_000)]


@pytest.mark.parametrize(("seed", "limit"), [(1, 50_000), (2, 3)])
def test_removed_spans(docs_of, monkeypatch, seed, limit):
    """With a small limit, anchors are dealt anew by whole strings."""
    monkeypatch.setattr(s, "GROUP_LIMIT", limit)
    rows = _rows(seed)
    assert sorted(map(tuple, s.removed_spans(docs_of(rows)).collect()), key=str) == _brute(rows)


def test_intervals_are_the_maximal_groups():
    turn = random.Random(3)
    texts = [bytes(turn.choices(b"ab", k=60)) for _ in range(30)] + [b"a" * 70, b"a" * 64]
    text, place, _, common = s.enhanced_suffix_array(texts)
    suffixes = [texts[t][p:] for t, p in zip(text, place, strict=True)]
    assert suffixes == sorted(suffixes)
    found = set(s.intervals(common, 50))
    want = set()
    for i in range(len(suffixes)):
        for j in range(i + 1, len(suffixes)):
            depth = 0
            for x, y in zip(suffixes[i], suffixes[j], strict=False):
                if x != y:
                    break
                depth += 1
            if depth >= 50:
                group = [k for k, x in enumerate(suffixes) if x[:depth] == suffixes[i][:depth]]
                want.add((depth, group[0], group[-1]))
    assert found == want
    outer = list(map(tuple, s.outermost(common, 50).tolist()))
    assert all(b < c for (_, b), (c, _) in zip(sorted(outer), sorted(outer)[1:], strict=False))


def test_repeats_have_all_occurrences(docs_of):
    shared = "".join(random.Random(4).choices("abcdefgh", k=60))
    rows = [(i, f"{'xyz'[i % 3]}{shared}{i}") for i in range(9)]
    _, texts = s.distinct_texts(docs_of(rows))
    _, repeats = s.first_documents(s.shared_stretches(texts, s.shared_anchors(texts)))
    found = repeats.collect()
    assert found and all(r.repeat.decode() in shared + "012345678" for r in found)
    assert max(len(r.occurrences) for r in found) == 9


def _brute_repeats(rows):
    texts = sorted({(d, (x or "").encode()) for d, x in rows if d is not None})
    starts = {}
    for n, (_, data) in enumerate(texts):
        for i in range(len(data) - 49):
            starts.setdefault(data[i : i + 50], []).append((n, i))
    out = set()
    for group in starts.values():
        ends = {texts[n][1][i:] for n, i in group}
        lengths = {(n, i): texts[n][1][i:] for n, i in group}
        names = {x[: s._common(x, y)] for x in ends for y in ends if x != y} | {
            x for x in ends if sum(y == x for y in lengths.values()) > 1}
        for w in names:
            at = [p for p, x in lengths.items() if x.startswith(w)]
            before = {texts[n][1][i - 1] if i else -1 for n, i in at}
            if len({texts[n][0] for n, _ in at}) > 1 and (len(before) > 1 or -1 in before):
                out |= {(hashlib.sha256(w).hexdigest(), len(w), texts[n][0], i) for n, i in at}
    return out


def test_whole_maximal_repeats(docs_of):
    """Also longer than a stretch, of copies, and where all contexts are one."""
    turn = random.Random(8)
    long = "".join(turn.choices("abcdefgh ", k=700))
    rows = [(100 + i, "".join(turn.choices("xyz", k=30)) + long + "xyz"[i % 3] * 3) for i in range(4)]
    rows += [(110, long[200:500]), (111, "q" + long[100:420] + "é"), (112, rows[0][1]),
             (113, rows[0][1]), (114, long[:90] + long[300:600]), (115, "ab" * 45),
             (116, "zab" + "ab" * 40), (117, None),
             (None, rows[1][1]), *[r for r in _rows(1) if r[0] and r[0] < 12]]
    got = [(r["repeat"], r.n_bytes, r.doc_id, r.begin) for r in s.maximal_repeats(docs_of(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_repeats(rows)
    assert sum(n == 700 for _, n, _, _ in got) == 6
    first = {}
    for name, _, doc_id, _ in got:
        first[name] = min(doc_id, first.get(name, doc_id))
    cover = {}
    for name, n, doc_id, begin in got:
        if first[name] < doc_id:
            cover.setdefault(doc_id, set()).update(range(begin, begin + n))
    once = [r for r in _brute(rows) if r[0] not in (None, 3, 5)]
    assert all(len(cover.get(d, ())) == removed for d, _, removed, _, _ in once)


def test_empty_table(docs_of):
    assert s.maximal_repeats(docs_of([])).collect() == []
    assert s.removed_spans(docs_of([])).collect() == []


def test_interval_tree():
    """The stack scan's intervals, each below the smallest one around it, and the least owner of the outermost."""
    turn = random.Random(5)
    texts = [bytes(turn.choices(b"ab", k=60)) for _ in range(40)] + [b"a" * 75, b"a" * 64, b"ab" * 35, b"ba" * 33]
    text, _, _, common = s.enhanced_suffix_array(texts)
    depth, low, high, parent, inner = tree = s.interval_tree(common, 4)
    nodes = list(zip(depth.tolist(), low.tolist(), high.tolist(), strict=True))
    assert len(nodes) > 100 and sorted(nodes) == sorted(s.intervals(common, 4))
    for i, (d, a, b) in enumerate(nodes):
        around = [n for n in nodes if n[0] < d and n[1] <= a and b <= n[2]]
        assert (nodes[parent[i]] if parent[i] >= 0 else None) == max(around, default=None)
    for at, i in enumerate(inner.tolist()):
        around = [n for n in nodes if n[1] <= at <= n[2]]
        assert (nodes[i] if i >= 0 else None) == max(around, default=None)
    owner = s.np.array([turn.randrange(1000) for _ in texts])[text]
    want = owner.copy()
    for a, b in s.outermost(common, 4).tolist():
        want[a : b + 1] = owner[a : b + 1].min()
    assert s.first_owners(tree, owner).tolist() == want.tolist()
    none = s.interval_tree(common, 1000)
    assert s.first_owners(none, owner).tolist() == owner.tolist()


def test_spans_come_from_the_tree(docs_of, monkeypatch):
    seen = []
    tree = s.interval_tree
    monkeypatch.setattr(s, "interval_tree", lambda *a: seen.append(1) or tree(*a))
    list(s._settle([(1, 2, b"x" * 60, 4, 9, 0, 1), (1, 3, b"x" * 55 + b"y" * 5, 3, 8, 0, 1)], False))
    assert seen
