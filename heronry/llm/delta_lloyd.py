"""Centroid clustering by Lloyd rounds that only look at what changed (Delta Lloyd).

A round keeps three things: a table of every vector with its owner and its squared distance, the integer sum and count of
every centroid's vectors, and the centroids that moved in the last round. A vector whose owner stayed in place keeps its
distance and is compared with moved centroids only. A vector whose owner moved is measured against that owner; if it came
no farther, moved centroids are again all that can win, else it is compared with all. What a vector takes from one
centroid to another travels as signed integers: each task adds up -v for the old owner and +v for the new one and sends
one row for each centroid. Global sums are the old ones plus these transfers, never a sum over all vectors again.

All arithmetic is exact: components are floor(scale * x) as integers, centroids floor(sum / count), distances integers.
Components up to 2**21 in size are multiplied as doubles, where every product and sum is exact; greater ones as integers.

Defined results: a vector of another length, or with a null or non-finite component, or null itself, is left out; a
component beyond 2**27 in size is held at that bound, so that distances fit a long; a null id counts as an empty one when
the first centroids are chosen; of vectors whose ids hash alike those with the lesser components come first; repeated
rows are clustered each by itself; fewer vectors than centroids give as many centroids as vectors; an empty table gives an
empty result; extra columns are ignored. Every round's table is written to the shared folder, so a lost executor costs a
part of one round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Greatest size of a component, and of one that is multiplied as a double.
MOST, EXACT = 1 << 27, 1 << 21
#: Vectors that are measured at a time.
BLOCK = 8192


def whole_numbers(vectors: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components v of the vectors that are kept."""
    x = F.col(column)
    fine = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    bound = lambda e: F.greatest(F.least(F.floor(F.lit(float(scale)) * e.cast("double")), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return vectors.where(x.isNotNull() & fine).select("vec_id", F.transform(x, bound).alias("v"))


def seed_key(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    if not len(centroids) or not len(v):
        return np.zeros((len(v), len(centroids)), np.int64)
    if max(np.abs(v).max(), np.abs(centroids).max()) <= EXACT:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(v), len(centroids)), np.int64)
    for k, c in enumerate(centroids.astype(np.int64)):
        step = v.astype(np.int64) - c
        out[:, k] = (step * step).sum(1)
    return out


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, distance, number of distances measured) after the centroids whose numbers are in moved took new places. owner -1: none yet."""
    n, numbers = len(v), np.flatnonzero(moved)
    owner, distance = owner.copy(), distance.copy()
    held = owner >= 0
    stale = held & moved[np.maximum(owner, 0)]
    far = ~held
    at = distances(v, centroids[numbers])
    if stale.any():
        now = at[np.flatnonzero(stale), np.searchsorted(numbers, owner[stale])]
        far[np.flatnonzero(stale)[now > distance[stale]]] = True
        distance[stale] = now
    near = ~far
    if near.any() and len(numbers):
        best = at[near].argmin(1)  # the first of equals, so the smallest number
        least, number = at[near][np.arange(len(best)), best], numbers[best]
        wins = (least < distance[near]) | ((least == distance[near]) & (number < owner[near]))
        rows = np.flatnonzero(near)[wins]
        owner[rows], distance[rows] = number[wins], least[wins]
    if far.any():
        full = np.empty((int(far.sum()), len(centroids)), np.int64)
        full[:, numbers], rest = at[far], np.flatnonzero(~moved)
        full[:, rest] = distances(v[far], centroids[rest])
        owner[far] = full.argmin(1)
        distance[far] = full.min(1)
    return owner, distance, n * len(numbers) + int(far.sum()) * int((~moved).sum())


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The table after one assignment, and each task's transfers as rows (to, members, shift, measured); cut."""
    kind, dims, k = state.schema["vec_id"].dataType.simpleString(), centroids.shape[1], len(centroids)

    def run(batches):
        members, shift, measured = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        names = None
        for whole in batches:
            names = whole.schema
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                v = flat.reshape(batch.num_rows, dims)
                old = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                owner, distance, n = reassigned(v, old, batch.column(3).to_numpy(zero_copy_only=False), centroids, moved)
                measured += n
                went = np.flatnonzero(owner != old)
                for c in np.unique(np.concatenate([owner[went], old[went]])) if len(went) else ():
                    if c >= 0:
                        to, off = went[owner[went] == c], went[old[went] == c]
                        members[c] += len(to) - len(off)
                        shift[c] += v[to].sum(0, dtype=np.int64) - v[off].sum(0, dtype=np.int64)
                own = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(owner, pa.int32()), pa.array(distance), pa.nulls(own, pa.int32()), pa.nulls(own, pa.int64()), pa.nulls(own, pa.list_(pa.int64())), pa.nulls(own, pa.int64())],
                    names=["vec_id", "v", "owner", "distance", "to", "members", "shift", "measured"],
                )
        if names is not None:
            c = np.flatnonzero(members.astype(bool) | shift.any(1))
            c = c if len(c) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(c), names.field(0).type), pa.nulls(len(c), names.field(1).type), pa.nulls(len(c), pa.int32()), pa.nulls(len(c), pa.int64()), pa.array(c, pa.int32()), pa.array(members[c]), pa.array(shift[c].tolist(), pa.list_(pa.int64())), pa.array([measured] + [0] * (len(c) - 1), pa.int64())],
                names=["vec_id", "v", "owner", "distance", "to", "members", "shift", "measured"],
            )

    return cut(state.mapInArrow(run, f"vec_id {kind}, v array<int>, owner int, distance long, to int, members long, shift array<long>, measured long"))


def _transfers(done: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signed changes of the counts and sums of all centroids, and the distances measured. At most k rows reach the driver."""
    added = [F.sum(F.element_at("shift", i + 1)).alias(f"d{i}") for i in range(dims)]
    members, shift, measured = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
    for r in done.where("to IS NOT NULL").groupBy("to").agg(F.sum("members").alias("members"), F.sum("measured").alias("measured"), *added).collect():
        members[r["to"]], shift[r["to"]] = r["members"], [r[f"d{i}"] for i in range(dims)]
        measured += r["measured"]
    return members, shift, measured


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


class Clusters:
    """rows: vec_id, v, owner, distance. centroids: their integer components. measured: distances computed in each round."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, members: np.ndarray, measured: list[int]):
        self.rows, self.centroids, self.members, self.measured = rows, centroids, members, measured


def delta_lloyd(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE, column: str = "embedding") -> Clusters:
    """Clusters of vectors (vec_id and an array column) after so many rounds of assigning and moving, and one more assigning."""
    kept = whole_numbers(vectors, column, dims, scale)
    first = kept.orderBy(seed_key(F.col("vec_id"), seed), "v").limit(k).collect()  # k rows
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    k = len(centroids)
    state = kept.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    if not k:
        return Clusters(state, centroids, np.zeros(0, np.int64), [])
    members, sums, measured = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), []
    moved, done = np.ones(k, bool), None
    for number in range(rounds + 1):
        before, done = done, _round(state, centroids, moved)
        if before is not None:
            drop_cut(before)
        state = done.where("to IS NULL").select("vec_id", "v", "owner", "distance")
        more, shift, n = _transfers(done, k, dims)
        members, sums = members + more, sums + shift
        measured.append(n)
        if number == rounds:
            break
        full = members > 0
        after = centroids.copy()
        after[full] = sums[full] // members[full, None]  # rounds towards minus infinity
        moved = (after != centroids).any(1)
        centroids = after
        if not moved.any():
            break
    return Clusters(state, centroids, members, measured)


def clustered(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    found = delta_lloyd(vectors, **parameters)
    sums = {r["owner"]: r["d"] for r in found.rows.groupBy("owner").agg(F.sum("distance").alias("d")).collect()} if len(found.centroids) else {}
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("owner") + 1).cast(kind) if len(values) else F.lit(None).cast(kind)
    numbers = range(len(found.centroids))
    return found.rows.select(
        "vec_id", F.col("owner").alias("cluster"), "distance",
        of([sums.get(i, 0) for i in numbers], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of([digest(found.centroids[i]) for i in numbers], "string").alias("centroid_sha256"),
    )


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _assign(number: int) -> str:
    """Distances to the centroids of a round, and the nearest one."""
    return f"""
near{number} AS MATERIALIZED (
    SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT r, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, at{number}) GROUP BY r
)"""


def _move(number: int) -> str:
    """Centroids of the next round, from the vectors that a round gave them."""
    return f"""
at{number + 1} AS MATERIALIZED (
    SELECT c, coalesce(y, x) AS x FROM at{number} LEFT JOIN (
        SELECT c, list(floor_div ORDER BY i) AS y FROM (
            SELECT c, i, CASE WHEN sum(e) < 0 THEN -((-sum(e) + count(*) - 1) // count(*)) ELSE sum(e) // count(*) END::BIGINT AS floor_div
            FROM (SELECT c, unnest(v) AS e, unnest(range(1, 65)) AS i FROM near{number} JOIN kept USING (r)) GROUP BY c, i
        ) GROUP BY c
    ) USING (c)
)"""


_CHAIN = ",".join(_assign(n) + "," + _move(n) for n in range(ROUNDS)) + "," + _assign(ROUNDS)
SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
),
at0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key) - 1 AS c, v AS x FROM (SELECT sha256('1:' || vec_id) AS key, v FROM kept ORDER BY key LIMIT 16)),
{_CHAIN}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM near{ROUNDS} JOIN kept USING (r) JOIN at{ROUNDS} USING (c)
"""
