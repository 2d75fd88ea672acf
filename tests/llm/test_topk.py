import math

import numpy as np
import pytest

from sluice.llm import topk
from sluice.llm.topk import add_slices, best_rows, powers, top_k

SCHEMA = "vec_id long, embedding array<double>, _rid string, _q string, rank string, score string, _g string, _r string, _block string, _dim string, query_id string"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors):
    return spark.createDataFrame([(i, v, None, "x", None, "x", None, 1, None, "x", None) for i, v in vectors], SCHEMA)


def brute(vectors, k=20, every=20):
    rows = [(i, [math.floor(64 * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, v) in enumerate(rows):
        if i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(rows) if a != b and len(v) == len(w)]
        out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect()), key=repr)


def test_weights_are_signed_powers_with_gaps():
    weights = np.r_[np.arange(-300, 300), [1 << 30, -(1 << 30) - 1]]
    component, power, sign = powers(weights)
    back = np.zeros(len(weights), np.int64)
    np.add.at(back, component, sign << power)
    assert (back == weights).all()
    for j in range(len(weights)):
        own = np.sort(power[component == j])
        assert (np.diff(own) > 1).all()


def test_sums_and_best_rows_are_exact():
    rng = np.random.RandomState(0)
    for n, m in ((1, 1), (64, 5), (130, 40), (1000, 333)):
        bits = rng.randint(0, 2, (m, n)).astype(bool)
        weight, which = rng.randint(0, 9, 3 * m), rng.randint(0, m, 3 * m)
        total = add_slices(topk._packed(bits), which, weight)
        want = (bits[which].astype(np.int64) << weight[:, None]).sum(0)
        got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(np.int64) << b for b, s in enumerate(total))
        assert (got == want).all()
        some = rng.rand(n) < 0.8
        for k in (1, 7, 20, n):
            best = best_rows(total, topk._packed(some), k)
            assert sorted(best) == sorted(sorted(np.flatnonzero(some), key=lambda r: (-want[r], r))[:k])
    assert add_slices(np.zeros((0, 2), np.uint64), np.zeros(0, int), np.zeros(0, int)).tolist() == [[0, 0]]


@pytest.mark.parametrize("block", [1 << 16, 100])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "RANGE_BLOCKS", 3)
    rng = np.random.RandomState(2)
    x = rng.standard_normal((500, 24)) * 0.2
    # A third of all rows is one vector, so that very many rows tie.
    x[300:470] = x[3]
    vectors = [(int(i), v.tolist()) for i, v in zip(rng.permutation(900)[:500], x)]
    assert rows_of(top_k(table(spark, vectors))) == brute(vectors)


def test_odd_vectors(spark):
    odd = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (20, [1.0, 1.0]), (40, None), (60, [NAN, 1.0]), (80, [INF, 1.0]), (100, [None, 1.0]), (120, []), (140, []), (None, [0.5, 0.5]), (None, [2.0, -3.0]), (160, [1.0]), (-20, [0.0, 0.0]), (7, [-1e6, 1e6]), (180, [0.001, -0.001, 0.0])]
    assert rows_of(top_k(table(spark, odd))) == brute(odd)
    assert rows_of(top_k(table(spark, odd), k=2, every=1)) == brute(odd, 2, 1)


def test_scores_beyond_64_bits_fail(spark):
    with pytest.raises(Exception, match="64 bits"):
        top_k(table(spark, [(0, [1e300, 0.0]), (1, [1.0, 0.0])])).collect()


@pytest.mark.parametrize("vectors", [[], [(0, None)], [(3, [1.0])], [(0, [1.0])]])
def test_tables_without_pairs(spark, vectors):
    assert top_k(table(spark, vectors)).collect() == []
