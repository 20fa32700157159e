from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from retention_spark.llm import centroids as c


def brute(rows, d, k, rounds):
    """(vec_id, list) to the result, plainly; Python's integers throughout."""
    kept = [(i, [max(-c.LIMIT, min(c.LIMIT, math.floor(1024 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (hashlib.sha256(f"3:{'-' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=seed)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(centres))[::-1]

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[nearest(v)[0]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else m for g, m in zip(groups, centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = {n: sum(f[2] for f in found if f[1] == n) for n in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centres]
    return sorted([(i, n, x, per[n], sum(per.values()), sha[n]) for i, n, x in found], key=str)


def table(spark, rows):
    """With columns that nobody asked for."""
    return spark.createDataFrame([(i, v, "v", 9) for i, v in rows],
                                 "vec_id long, embedding array<double>, v string, cluster long")


def some(n, d, scale, seed=0):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.normal(0, scale, d)]) for i in range(n)]


ODD = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 0.0, 0.0]),
       (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0, 3.0]), (106, [1e300, -1e300, 5.0, 0.0]),
       (None, [0.5, -0.5, 0.25, 0.0]), (7, [0.1, 0.2, 0.3, 0.4]), (7, [0.1, 0.2, 0.3, 0.4]),
       (7, [-0.1, 0.2, 0.3, 0.4])]
TIES = [(i, [float(i % 3), 1.0, float(-(i % 2)), 0.0]) for i in range(60)]


@pytest.mark.parametrize("rows", [some(300, 4, 1.0), ODD, ODD + some(40, 4, 3.0), TIES, TIES[:5],
                                  [(i, [0.25] * 4) for i in range(50)]])
def test_clusters(spark, rows):
    got = c.clusters(table(spark, rows).repartition(3), components=4, count=8, rounds=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 8, 4)


def test_as_the_query_runs_it(spark):
    rows = some(200, 64, 0.1, seed=4)
    got = c.clusters(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 64, 8, 10)


def test_empty_table(spark):
    got = c.clusters(table(spark, []))
    assert got.collect() == []
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("scale", [1, 3, 1000, 10**5, c.LIMIT])
@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_search_is_exact(scale, d):
    r = np.random.default_rng(scale * 100 + d)
    for trial in range(20):
        centres = r.integers(-scale, scale + 1, (int(r.integers(1, 40)), d))
        if trial % 3 == 0:
            centres = np.repeat(centres, 2, axis=0)
        vectors = r.integers(-scale, scale + 1, (200, d))
        vectors[:30] = centres[r.integers(0, len(centres), 30)]
        if trial % 4 == 1:  # far from the origin, close to one another
            vectors, centres = vectors // 1000 + scale // 2, centres // 1000 + scale // 2
        number, distance = c.Search(centres).nearest(vectors)
        every = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (every.argmin(axis=1) == number).all() and (every.min(axis=1) == distance).all()


def test_search_rejects_most_centroids():
    r = np.random.default_rng(2)
    centres = r.integers(-50, 50, (256, 1)) + r.integers(-40, 40, (256, 16))
    vectors = centres[r.integers(0, 256, 2000)] + r.integers(-2, 3, (2000, 16))
    search = c.Search(centres)
    search.nearest(vectors)
    assert search.measured < 0.1 * 256 * 2000
