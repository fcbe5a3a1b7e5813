import hashlib
import math
import random

import numpy as np

from heronry.llm import delta_lloyd as M

from ..differential import duck, rows


def brute(vectors, k=16, rounds=3, dims=64, scale=64):
    """Plain Lloyd over Python integers: every vector against every centroid in every round."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = sum(d for d, _ in near) if kept else 0
    return sorted(
        ([i, c, d, sum(x for x, y in near if y == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()] for (i, _), (d, c) in zip(kept, near, strict=True)), key=str
    )


def got(df):
    return sorted(([r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256] for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(M.op12_delta_lloyd(spark, sf_dir)) == brute(vectors)


def test_sql(spark, sf_dir):
    assert rows(M.op12_delta_lloyd(spark, sf_dir)) == duck(sf_dir, M.SQL)


def test_a_round_equals_a_full_comparison():
    """Small grids make ties frequent; any set of centroids may move, some of them not at all."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        k, n, dims = int(rng.integers(1, 7)), int(rng.integers(1, 40)), int(rng.integers(1, 4))
        old, v = rng.integers(-2, 3, (k, dims)), rng.integers(-3, 4, (n, dims))
        full = M.distances(v, old)
        moved = rng.random(k) < 0.5
        new = np.where(moved[:, None], rng.integers(-2, 3, (k, dims)), old)
        owner, distance, measured = M.reassigned(v, full.argmin(1), full.min(1), new, moved)
        want = M.distances(v, new)
        assert (owner == want.argmin(1)).all() and (distance == want.min(1)).all() and measured <= n * k


def test_distances_of_large_components():
    rng = np.random.default_rng(4)
    for most in (100, M.EXACT, M.MOST):
        v, c = rng.integers(-most, most + 1, (20, 64)), rng.integers(-most, most + 1, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
        assert M.distances(v, c).tolist() == want


def test_odd_rows(spark):
    rng = random.Random(5)
    near = lambda base: [base + rng.uniform(-0.4, 0.4) for _ in range(64)]
    vectors = [(k, near(k % 5)) for k in range(90)]
    vectors += [(3, vectors[3][1])] * 2 + [(None, near(2)), (None, near(2)), (200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [None] + [0.1] * 63), (205, [float("nan")] + [0.1] * 63), (206, [float("inf")] + [0.1] * 63)]
    vectors += [(300 + k, [0.25] * 64) for k in range(60)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id bigint, embedding array<float>, cluster int, v string")
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(M.clustered(df)) == brute(plain)
    assert got(M.clustered(df, k=4, rounds=6)) == brute(plain, k=4, rounds=6)
    assert M.clustered(df.limit(0)).count() == 0 and M.clustered(df.limit(0)).columns == M.clustered(df).columns
    assert got(M.clustered(df.where("vec_id < 3"))) == brute([r for r in plain if r[0] is not None and r[0] < 3])
    huge = spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)], "vec_id bigint, embedding array<double>")
    assert M.clustered(huge).where("distance = 0").count() == 3


def test_rounds_measure_less_than_all_pairs(spark, sf_dir):
    found = M.delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rounds=12)
    n = found.rows.count()
    assert found.measured[0] == n * 16 and sum(found.measured) < len(found.measured) * n * 16
    assert int(found.members.sum()) == n
