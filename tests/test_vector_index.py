import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.operators import vector_index, vectors
from sluice.operators.vector_index import build, compared, fit_cells, recall, search


@pytest.fixture(scope="module")
def clustered(spark):
    """Rows around many centres, some of them alike, and lookups near them."""
    rng = np.random.RandomState(0)
    centres = rng.standard_normal((60, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.randint(0, 60, 6000)] + 0.08 * rng.standard_normal((6000, 32))
    x[:50] = x[0]
    q = centres[rng.randint(0, 60, 300)] + 0.08 * rng.standard_normal((300, 32))
    rows = spark.createDataFrame([(i, v.tolist(), f"row {i}") for i, v in enumerate(x)], "id long, embedding array<double>, passage string").cache()
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "k long, embedding array<double>").cache()


def near(df):
    return {r["k"]: [(n["id"], round(n["distance"], 9)) for n in r["_near"]] if r["_near"] is not None else None for r in df.collect()}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_exact_search_equals_all_pairs_and_probes_find_nine_in_ten(clustered, metric):
    rows, lookup = clustered
    index = build(rows, metric=metric, carry="passage")
    assert index.counts.sum() == 6000 and 40 <= len(index.centres) <= 80
    truth = vectors.nearest(lookup, rows, 10, "id", "embedding", "embedding", metric, carry="passage").cache()
    assert near(search(lookup, index, 10, probes=2, exact=True)) == near(truth)
    found = search(lookup, index, 10)
    assert recall(found, truth, ["k"]) >= 0.9
    assert compared(lookup, index) < 0.25 * 300 * 6000
    assert found.filter(F.exists("_near", lambda n: n["carried"] != F.concat(F.lit("row "), n["id"]))).count() == 0


def test_vectors_without_clusters_take_more_cells_and_still_fewer_than_all(spark):
    rng = np.random.RandomState(3)
    x = rng.standard_normal((4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    lookup = rows.filter("id % 20 = 0").withColumnRenamed("id", "k")
    index = build(rows)
    truth = vectors.nearest(lookup, rows, 10, "id", "embedding", "embedding", normalise=False)
    assert recall(search(lookup, index, 10, normalise=False), truth, ["k"]) >= 0.9
    assert 1 < index.probes < len(index.centres) and compared(lookup, index, normalise=False) < 0.8 * 200 * 4000


def test_hot_cells_are_several_blocks(clustered, monkeypatch):
    rows, lookup = clustered
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vector_index, "BLOCK_LOOKUPS", 7)
    index = build(rows, cells=10)
    want = near(vectors.nearest(lookup, rows, 5, "id", "embedding", "embedding"))
    assert near(search(lookup, index, 5, probes=1, exact=True)) == want


def test_rows_are_filed_by_cell_and_only_probed_cells_are_read(spark, clustered):
    rows, lookup = clustered
    index = build(rows)
    filed = spark.read.parquet(index.path)
    assert filed.count() == 6000 and filed.rdd.getNumPartitions() >= 1
    one = index.rows(spark).filter("cell = 3")
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() and one.count() == index.counts[3]


def test_joins_by_an_index_give_the_lists_of_joins_by_a_table(clustered):
    rows, lookup = clustered
    index = build(rows, carry="passage")
    lists = lambda df: {r["k"]: (r["match_ids"], r["passages"], [round(d, 9) for d in r["match_distances"] or []]) for r in df.collect()}
    for kind in ("inner", "outer_right"):
        want = vectors.vector_join(lookup, rows, kind, 5, 3, 0.4, passage_col="passage")
        assert lists(vector_index.vector_join(lookup, index, kind, 5, 3, 0.4, exact=True, passages=True)) == lists(want)


def test_odd_vectors_and_empty_indexes(spark, clustered):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0]), (8, [0.0, 1.0]), (None, [0.6, 0.8])]
    lookup = spark.createDataFrame(odd, "k long, embedding array<double>")
    index = build(lookup.withColumnRenamed("k", "id"))
    got = near(search(lookup, index, 5, exact=True))
    assert len(got) == 9 and {k for k, v in got.items() if v is None} == {1, 2, 3, 4, 5, 7}
    assert {i for i, _ in got[6]} == {6, 8, None}
    empty = build(lookup.limit(0), "k")
    assert {k: v for k, v in near(search(lookup, empty, 3)).items()}[6] == []
    with pytest.raises(CompileError):
        build(lookup, "k", metric="dot")


def test_cells_of_few_distinct_vectors():
    assert len(fit_cells(np.ones((100, 4)), 10)) == 1
    assert len(fit_cells(np.repeat(np.eye(4), 5, 0), 10)) == 4
