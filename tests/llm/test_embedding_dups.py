import numpy as np
import pytest

from sluice.llm import embedding_dups
from sluice.llm.embedding_dups import near_duplicates

SCHEMA = "vec_id long, embedding array<double>, _v string, _rid string, component_id string"


def rows_of(vectors):
    return [(i, v, None, "x", None) for i, v in vectors]


def brute(vectors):
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    root = list(range(len(ids)))
    for _ in ids:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(len(ids))]
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {ids[i]: (int(link[i].sum()), least[root[i]]) for i in range(len(ids))}


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "LEAF_ROWS", 40)
    monkeypatch.setattr(embedding_dups, "BLOCK_ROWS", 16)
    rng = np.random.RandomState(1)
    centers = rng.standard_normal((30, 64))
    vectors = [(i, c.tolist()) for i, c in enumerate(rng.standard_normal((400, 64)))]
    vectors += [(1000 + i, (centers[i % 30] + 0.12 * rng.standard_normal(64)).tolist()) for i in range(500)]
    vectors += [(5000 + i, vectors[3][1]) for i in range(50)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows_of(vectors), SCHEMA)).collect()}
    want = brute(vectors)
    assert len(got) == len(want)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.995 * there
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.995 * len(want)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_dense_group_loses_no_link(spark, kind):
    """Some thousand distinct vectors with a mean pair cosine of 0.94, as much alike as linking pairs are."""
    rng = np.random.RandomState(7)
    center = rng.standard_normal(64)
    x = center / np.linalg.norm(center) + np.sqrt(0.0638 / 64) * rng.standard_normal((4000, 64))
    x = np.r_[x, rng.standard_normal((2000, 64))].astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    schema = SCHEMA.replace("array<double>", f"array<{kind}>")
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(spark.createDataFrame(rows_of(enumerate(x.tolist())), schema)).collect()}
    assert want.sum() > 1_000_000
    assert sum(abs(got[i] - n) for i, n in enumerate(want)) <= 1e-5 * want.sum()


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (10, [1e-300, 0.0]), (11, [1e300, 1e299])]
    out = near_duplicates(spark.createDataFrame(rows_of(odd), SCHEMA)).collect()
    assert len(out) == len(odd)
    alone = {r["vec_id"]: r for r in out if r["vec_id"] in (1, 2, 3, 4, 5, 6, 9)}
    assert all(r["n_links"] == 0 and r["component_id"] == i and r["kept"] for i, r in alone.items())
    linked = [r for r in out if r["vec_id"] in (7, 8, None, 10, 11)]
    assert {r["component_id"] for r in linked} == {7}
    assert {r["n_links"] for r in linked} == {5}
    assert [r["kept"] for r in linked if r["vec_id"] is None] == [False]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_tables(spark, n):
    out = near_duplicates(spark.createDataFrame(rows_of([(i, [1.0, float(i)]) for i in range(n)]), SCHEMA)).collect()
    assert [r["n_links"] for r in out] == [0] * n
