import hashlib
import math

import numpy as np
import pytest

from sluice.llm import centroids
from sluice.llm.centroids import Round, cluster, squared_distances

SCHEMA = "vec_id long, embedding array<double>, _q string, cluster string, _was string, _upper string, _lower string, distance string, n string, sums string"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors):
    return spark.createDataFrame([(i, v, None, "x", None, "x", None, "x", None, "x") for i, v in vectors], SCHEMA)


def brute(vectors, k=16, rounds=3):
    """Plain rounds over all vectors and centroids."""
    rows = [(i, [math.floor(64 * c) for c in v]) for i, v in vectors if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    ranked = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in ranked[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda: [min((far(v, w), j) for j, w in enumerate(c)) for _, v in rows]
    for _ in range(rounds):
        own = near()
        for j in range(len(c)):
            held = [v for (_, v), (_, a) in zip(rows, own) if a == j]
            if held:
                c[j] = [sum(col) // len(held) for col in zip(*held)]
    own = near()
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    out = [(i, j, d, sum(x for x, a in own if a == j), sum(x for x, _ in own), digest[j]) for (i, _), (d, j) in zip(rows, own)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def test_matches_brute_force(spark):
    rng = np.random.RandomState(4)
    centers = rng.standard_normal((8, 64)) * 0.3
    x = centers[rng.randint(0, 8, 300)] + 0.1 * rng.standard_normal((300, 64))
    x[100:200] = x[0]
    vectors = [(int(i), v.tolist()) for i, v in enumerate(x)]
    assert rows_of(cluster(table(spark, vectors))) == brute(vectors)


def test_ties_go_to_the_smaller_number(spark):
    """Vectors on a coarse grid, where very many lie exactly between two centroids."""
    rng = np.random.RandomState(5)
    vectors = [(i, [float(c) / 64 for c in rng.randint(0, 2, 4)] + [0.0] * 60) for i in range(120)]
    assert rows_of(cluster(table(spark, vectors))) == brute(vectors)


def test_bounds_hold_and_spare_scans():
    rng = np.random.RandomState(6)
    centers = rng.randint(-40, 40, (16, 64))
    x = np.vstack([c + rng.randint(-5, 6, (100, 64)) for c in centers])
    own, upper, lower = np.full(len(x), -1, np.int32), np.zeros(len(x)), np.zeros(len(x))
    before, now, scanned = None, x[rng.permutation(len(x))[:16]].copy(), []
    for _ in range(6):
        scanned.append(len(Round(now, before).assign(x, own, upper, lower)))
        d = squared_distances(x, now)
        assert (own == d.argmin(1)).all()
        rest = np.where(np.arange(16)[None, :] == own[:, None], 1 << 60, d).min(1)
        assert (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(rest)).all()
        before, now = now, np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else now[j] for j in range(16)])
    assert scanned[0] == len(x) and scanned[-1] < len(x) / 4


def test_distances_are_exact():
    rng = np.random.RandomState(7)
    for most in (100, 1 << 19, 1 << 27):
        x, c = rng.randint(-most, most, (20, 64)), rng.randint(-most, most, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert squared_distances(x, c).tolist() == want
    with pytest.raises(OverflowError):
        squared_distances(np.array([[1 << 40]]), np.array([[0]]))


def test_odd_vectors(spark):
    one = [0.5] * 64
    odd = [(1, None), (2, []), (3, [0.5] * 63), (4, [NAN] + [0.0] * 63), (5, [INF] + [0.0] * 63), (6, [None] + [0.0] * 63), (7, one), (7, one), (7, [-0.01] * 64), (None, [1.0] * 64), (-8, [0.0] * 64), (9, [3000.0] * 64)]
    assert rows_of(cluster(table(spark, odd))) == brute(odd)
    assert rows_of(cluster(table(spark, [(7, one)]))) == brute([(7, one)])


def test_empty_tables(spark):
    for vectors in ([], [(1, None), (2, [1.0])]):
        out = cluster(table(spark, vectors))
        assert out.collect() == [] and out.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]


def test_rounds_are_a_parameter(spark):
    rng = np.random.RandomState(8)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 64)))]
    assert rows_of(cluster(table(spark, vectors), rounds=1)) == brute(vectors, rounds=1)
    assert centroids.ROUNDS == 3
