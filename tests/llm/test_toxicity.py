import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import toxicity as toxicity_module
from sluice.llm.toxicity import DISCOUNT, Curve, Model, fit, score, toxicity

BAD = ["vile", "scoundrel", "wretch", "fool"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = [f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "en"))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return dict(labels=dict((i, t) for i, t, _ in labels), out=toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, lang string")).collect())


def test_held_out_accuracy(scored):
    held = [r for r in scored["out"] if r["held_out"]]
    right = sum(r["predicted"] == scored["labels"][r["doc_id"]] for r in held)
    assert right >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in scored["out"])


def test_held_out_is_the_remainder(scored):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored["out"])


def test_held_out_labels_do_not_matter(spark, scored):
    rows, labels = corpus(900)
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, t, x in labels]
    again = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(other, "doc_id long, toxic int, lang string")).collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx({r["doc_id"]: r["score"] for r in scored["out"]})


def test_blocks_of_the_model_give_the_same_scores(spark, scored, monkeypatch):
    monkeypatch.setattr(toxicity_module, "BLOCK_PAIRS", 500)
    rows, labels = corpus(900)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int, lang string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fit(docs, labelled)[0].n > 2
    again = {r["doc_id"]: r["score"] for r in toxicity(docs, labelled).collect()}
    assert again == pytest.approx({r["doc_id"]: r["score"] for r in scored["out"]}, abs=1e-9)


def test_rare_expressions_count_in_large_inputs(spark):
    """Four occurrences are enough, however many words are counted beside them."""
    counted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 < 2]
    rows = [(i, "vile scoundrel") for i in counted[:4]]
    rare = spark.createDataFrame(rows, "doc_id long, text string")
    filler = spark.createDataFrame([(i,) for i in counted[4:104]], "doc_id long").withColumn("text", F.expr("repeat('alpha beta gamma delta ', 15000)"))
    labels = spark.createDataFrame([(i, int(i in counted[:4])) for i in counted], "doc_id long, toxic int")
    model = fit(rare.unionByName(filler), labels)[0].value
    vile, scoundrel = spark.range(1).select(F.xxhash64(F.lit("vile")), F.xxhash64(F.lit("scoundrel"))).first()
    at = {w: k for k, w in enumerate(model.vocabulary.tolist())}
    assert vile in at and scoundrel in at
    assert at[vile] * (len(at) + 2) + at[scoundrel] in model.keys.tolist()


@pytest.mark.parametrize("least", [0, 2, 4, 99])
def test_probabilities_sum_to_one(least):
    """p(word | before) sums to 1 over the vocabulary, the rare word included, and without counts of rare pairs."""
    rng = np.random.RandomState(0)
    n = 8
    counts = rng.poisson(1.5, (n, n, 2)).astype(float)
    counts[:, n - 1] = 0  # nothing is followed by the start
    after = (counts > 0).sum(0).astype(float)
    kept = [(h, w) for h in range(n) for w in range(n) if counts[h, w].sum() >= max(least, 1)]
    keys = [(h * n + w, *counts[h, w]) for h, w in reversed(kept)]
    model = Model(np.arange(n - 2, dtype=np.int64), after, np.array(keys, np.int64).reshape(-1, 3), counts.sum(1))
    p = model.back_chance[:, None, :] * model.word_chance[None, :, :]
    for h, w in kept:
        p[h, w] += np.maximum(counts[h, w] - DISCOUNT, 0) / np.maximum(counts[h].sum(0), 1)
    assert np.allclose(p.sum(1), 1.0)
    words = rng.randint(0, n, 200)
    words[words >= n - 2] = 99  # a rare word
    before = np.r_[n - 1, np.minimum(words[:-1], n - 2)]
    chance = p[before, np.minimum(words, n - 2)]
    assert np.allclose(model.ratios(words, np.array([0, 200])), np.log(chance[:, 0] / chance[:, 1]), atol=1e-5)


def test_best_passage_is_found_wherever_it_begins():
    model = Model(np.array([1, 2], np.int64), np.array([[1.0, 9.0], [9.0, 1.0], [1.0, 1.0], [0.0, 0.0]]), np.zeros((0, 3), np.int64), np.zeros((4, 2)))
    ratio = dict(zip((1, 2), model.ratios(np.array([1, 2]), np.array([0, 1, 2])), strict=True))
    texts = [[1] * k + [2] * 8 + [1] * (30 - k) for k in range(31)] + [[2, 1, 2], [], [2] * 8]
    got = model.features(np.concatenate(texts).astype(np.int64), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(got[:31, 1], ratio[2]) and np.allclose(got[33, 1], ratio[2])
    assert np.isclose(got[31, 1], (2 * ratio[2] + ratio[1]) / 8) and not got[32].any()


def test_curve_learns_a_line():
    x = np.random.RandomState(1).standard_normal((500, 2))
    curve = Curve(x, (x[:, 0] > 0).astype(float))
    assert ((curve(x) > 0.5) == (x[:, 0] > 0)).mean() > 0.95


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (5, 0)], "doc_id long, toxic int")
    out = toxicity(make_docs(odd_rows), labels).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False, False]
    kept = score(make_docs(odd_rows), fit(make_docs(odd_rows), labels)).select("_row.*")
    assert kept.columns == make_docs(odd_rows).columns and kept.count() == len(odd_rows)


def test_empty_tables(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(make_docs([]), labels).count() == 0
    assert toxicity(make_docs([(1, "x")]), labels).count() == 1
