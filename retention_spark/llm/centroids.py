"""Centroid clustering by equal-average equal-variance nearest neighbour search, on integers.

Centroids are sorted by the sum of their components, which orders them by mean. For a vector the
scan starts at its own sum and moves outward, the nearer side first. With d components, sums S and
T, and deviations V and W (V * V = squared norm - S * S / d), the squared distance of a vector and a
centroid is at least (S - T)**2 / d + (V - W)**2. The first term alone ends a side of the scan,
because sums only get farther there; both together reject one centroid. What is left is measured
exactly. Bounds are floats with a margin below their rounding error, so a rejection is certain; a
centroid that ties is always measured.

A round reads the vectors once. Each task adds up its vectors per cluster and passes on one row per
cluster, so what is shuffled, collected and sent to tasks is of fixed size: the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

COMPONENTS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
#: Integers of larger size are set to this size: with them a squared distance still fits 64 bits.
LIMIT = 2**27 - 1
BATCH = 8192
_BIGGEST = 2**63 - 1


class Search:
    """Nearest of a few integer centroids for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.d = centroids.shape[1]
        sums = centroids.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.centroids = centroids[self.order]
        self.sums = sums[self.order]
        self.deviations = _deviations(self.centroids, self.sums)
        self.measured = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid and the squared distance; ties go to the
        smaller number."""
        k, rows = len(self.sums), len(vectors)
        sums = vectors.sum(axis=1)
        deviations = _deviations(vectors, sums)
        best = np.full(rows, _BIGGEST, np.int64)
        number = np.full(rows, k, np.int64)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        active = np.arange(rows)
        while len(active):
            down, up = low[active], high[active]
            below = _gap(sums[active], self.sums, down, k)
            above = _gap(sums[active], self.sums, up, k)
            take_low = below <= above
            gap = np.where(take_low, below, above)
            # The nearer side is out of reach, or both have ended: so is the other.
            going = _bound(gap, 0.0, self.d) <= best[active]
            active, take_low, gap = active[going], take_low[going], gap[going]
            at = np.where(take_low, down[going], up[going])
            low[active] -= take_low
            high[active] += ~take_low
            apart = deviations[active] - self.deviations[at]
            near = _bound(gap, apart, self.d) <= best[active]
            rows_near, at = active[near], at[near]
            self.measured += len(at)
            difference = vectors[rows_near] - self.centroids[at]
            found = np.einsum("ij,ij->i", difference, difference)
            named = self.order[at]
            better = (found < best[rows_near]) | (
                (found == best[rows_near]) & (named < number[rows_near]))
            best[rows_near[better]] = found[better]
            number[rows_near[better]] = named[better]
        return number, best


def _gap(sums: np.ndarray, centres: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """How far sums lie apart; infinite beyond either end."""
    inside = (at >= 0) & (at < k)
    gap = np.abs(sums - centres[np.clip(at, 0, k - 1)]).astype(float)
    return np.where(inside, gap, np.inf)


def _deviations(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
    norms = np.einsum("ij,ij->i", vectors, vectors)
    d = vectors.shape[1]
    # norm - sum**2 / d, the division on whole numbers as far as it goes.
    whole, rest = np.divmod(sums, d)
    spread = norms - whole * sums - (rest * sums) / d
    return np.sqrt(np.maximum(spread, 0.0))


def _bound(gap: np.ndarray, apart: np.ndarray | float, d: int) -> np.ndarray:
    """A number that no squared distance is below, rounding of the floats included."""
    with np.errstate(invalid="ignore"):
        exact = gap * gap / d + np.square(np.maximum(np.abs(apart) - 1e-2 - 1e-7 * gap, 0.0))
    return exact * (1 - 1e-9) - 1.0


def kept_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and `v`, the whole-number components: floor(1024 * x), cut to +-LIMIT, of vectors
    with exactly `components` components, none of them null, NaN or infinite."""
    x = F.col("embedding")
    fits = (F.size(x) == components) & F.forall(x, lambda c: c.isNotNull()
                                                & ~F.isnan(c.cast("double"))
                                                & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(
        F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c.cast("double") * SCALE))))).cast("int"))
    return vectors.filter(F.coalesce(fits, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The vectors with the smallest digests of their ids, in that order."""
    name = F.coalesce(F.col("vec_id").cast("string"), F.lit("-"))
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), name), 256).alias("digest")
    rows = kept.select(digest, "v").orderBy("digest", "v").limit(count).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(
        -1, components).astype(np.int64)


def _sums_of(centroids: np.ndarray):
    """Per task one row per cluster: number, vectors and the sum of each component."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        search, counts = Search(centroids), np.zeros(k, np.int64)
        high, low = np.zeros((k, d), np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for part in _pieces(batch):
                x = _matrix(part.column("v"), d)
                number, _ = search.nearest(x)
                counts += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    total = x[number == c].sum(axis=0)
                    high[c] += total >> 32
                    low[c] += total & 0xFFFFFFFF
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(counts[found]),
             *(pa.array(part[found].tolist(), pa.list_(pa.int64())) for part in (high, low))],
            ["cluster", "held", "high", "low"])

    return add


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, BATCH):
        yield batch.slice(start, BATCH)


def updated(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then every centroid to the mean of its
    vectors, rounded down component by component; one without vectors stays."""
    d = centroids.shape[1]
    parts = kept.select("v").mapInArrow(
        _sums_of(centroids), "cluster long, held long, high array<long>, low array<long>")
    totals = [F.sum(F.col(half)[i]).alias(f"{half}{i}") for half in ("high", "low") for i in range(d)]
    # A row for each cluster: as many as there are centroids.
    rows = parts.groupBy("cluster").agg(F.sum("held").alias("held"), *totals).collect()
    moved = centroids.copy()
    for r in rows:
        moved[r.cluster] = [((r[f"high{i}"] << 32) + r[f"low{i}"]) // r.held for i in range(d)]
    return moved


def fit(kept: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds; fewer than `count` when there are fewer vectors."""
    centroids = first_centroids(kept, count)
    for _ in range(rounds if len(centroids) else 0):
        centroids = updated(kept, centroids)
    return centroids


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            for part in _pieces(batch):
                number, distance = search.nearest(_matrix(part.column("v"), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, "vec_id long, cluster int, distance long")


def _total(column: str) -> Column:
    """A sum that stops at the largest long."""
    exact = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.least(exact, F.lit(_BIGGEST).cast("decimal(38,0)")).cast("bigint")


def clusters(vectors: DataFrame, components: int = COMPONENTS, count: int = CENTROIDS,
             rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256.

    Vectors that are null, of another length, or with a null, NaN or infinite component are left
    out. Rows that repeat a vec_id are vectors each; where one is among the first centroids, ties
    of the digest go by the components. A null vec_id is hashed as `3:-`. Components beyond
    +-131,071 are cut to that size, and inertias stop at the largest long. Fewer vectors than centroids make every
    vector a centroid; an empty table gives no rows. Other columns are not looked at.
    """
    kept = save(kept_vectors(vectors, components), "centroid-vectors")
    centroids = fit(kept, count, rounds)
    if not len(centroids):
        return assigned(kept, centroids.reshape(0, components)).select(
            "*", *[F.lit(None).cast(kind).alias(name) for name, kind in (
                ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    found = save(assigned(kept, centroids), "centroid-assigned")
    named = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids.tolist()])
    # One row per cluster, then one of all.
    per = found.groupBy("cluster").agg(_total("distance").alias("cluster_inertia"))
    sums = {r.cluster: r.cluster_inertia for r in per.collect()}
    inertia = min(sum(sums.values()), _BIGGEST)
    each = F.array(*[F.lit(sums.get(c, 0)).cast("bigint") for c in range(len(centroids))])
    return found.select(
        "vec_id", "cluster", "distance", each[F.col("cluster")].alias("cluster_inertia"),
        F.lit(inertia).cast("bigint").alias("inertia"), named[F.col("cluster")].alias("centroid_sha256"))


def _sql_round(n: int) -> str:
    return f"""
near{n} as materialized (
  select row, c, distance from (
    select row, c, sum((x.v - m.v) * (x.v - m.v)) as distance
    from x join m{n} m using (i) group by row, c)
  qualify row_number() over (partition by row order by distance, c) = 1),
m{n + 1} as materialized (
  select m.c, m.i, coalesce((s.total - ((s.total % s.held) + s.held) % s.held) // s.held, m.v) as v
  from m{n} m left join (
    select c, i, sum(v) as total, count(*) as held from x join near{n} using (row) group by c, i) s
  using (c, i))"""


ORACLE_SQL = f"""
with kept as (
  select row_number() over () as row, vec_id, list_transform(embedding,
    lambda e: cast(greatest(-{LIMIT}, least({LIMIT}, floor({SCALE} * cast(e as double)))) as bigint)) as v
  from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding,
    lambda e: e is not null and not isnan(e) and not isinf(e))) = {COMPONENTS}),
x as materialized (
  select row, unnest(range({COMPONENTS})) as i, unnest(v) as v from kept),
seeds as (
  select row, row_number() over (order by sha256('{SEED}:' || coalesce(vec_id::varchar, '-')), v) - 1 as c
  from kept qualify c < {CENTROIDS}),
m0 as materialized (select c, i, v from x join seeds using (row)),
{",".join(_sql_round(n) for n in range(ROUNDS + 1))},
named as (select c, sha256(string_agg(v::bigint::varchar, ',' order by i)) as centroid_sha256
          from m{ROUNDS} group by c)
select vec_id, cast(c as integer) as cluster, cast(distance as bigint) as distance,
  cast(sum(distance) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(distance) over () as bigint) as inertia, centroid_sha256
from near{ROUNDS} join kept using (row) join named using (c)"""
