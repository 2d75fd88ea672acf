import random
import re

import numpy as np
import public_tokenizers
import pytest
import test_line_dedup
import test_near_dups
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, rng):
    return " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, out = random.Random(4), tmp_path_factory.mktemp("tables")
    rows, labels = {}, {}
    for i in range(400):
        rows[i] = "\n".join(prose(rng.randint(5, 30), rng) for _ in range(rng.randint(1, 6)))
        labels[i] = 0
    for i in range(0, 400, 8):
        rows[i] += " vile scoundrel you wretch vile fool"
        labels[i] = 1
    items = [(k, prose(40, rng)) for k in range(5)]
    for k in range(5):
        rows[500 + k] = prose(60, rng) + " " + items[k][1] + " " + prose(60, rng)
    for k in range(5):
        base = prose(150, rng)
        rows[600 + 10 * k] = base
        rows[601 + 10 * k] = base.replace(base.split()[70], "changed", 1)
        rows[602 + 10 * k] = base
    passage = "\n".join(prose(20, rng) for _ in range(4))
    for k in range(4):
        rows[700 + k] = prose(40, rng) + "\n" + passage + "\n" + prose(40, rng)
    rows[800], rows[801] = None, ""
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, labels, passage


def test_stages_take_effect(spark, tables):
    sf, rows, labels, passage = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            gone = set(before) - set(kept)
            assert len([i for i in gone if not labels.get(i, 0)]) <= 8
            assert len([i for i in gone if labels.get(i, 0)]) >= 45
        elif name == "line_dedup":
            assert set(kept) == set(before)
            assert sum(passage in (t or "") for t in kept.values()) == 1
            assert all(kept[i] == before[i] for i in kept if not 700 <= i < 704)
        elif name == "near_dups":
            assert {i for i in kept if 600 <= i < 700} == {600 + 10 * k for k in range(5)}
            assert {i for i in before if not 600 <= i < 700} == {i for i in kept if not 600 <= i < 700}
        elif name == "decontamination":
            assert set(before) - set(kept) == {500 + k for k in range(5)}
        path = f"{sf}/after-{name}.parquet"
        after.write.parquet(path)
        docs = spark.read.parquet(path)


def plain(text):
    return " ".join(re.sub("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).split())


def test_run_against_brute_force(spark, tables):
    """What the toxicity stage keeps, taken through plain Python, is what the pipeline packs."""
    sf = tables[0]
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    lines = test_line_dedup.brute([(i, t) for i, t in kept.items() if t is not None]) | {i: None for i, t in kept.items() if t is None}
    groups = test_near_dups.brute(list(lines.items()))
    firsts = {i: t for i, t in lines.items() if groups[i][1] == i}
    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i: t for i, t in firsts.items() if not any(item in plain(t) for item in items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in clean.items()}
    got, used = {}, {}
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["length"] == len(ids)
        got[r["doc_id"]] += ids
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for own in used.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_odd_rows(spark, make_docs, odd_rows, tmp_path, empty):
    rows = [] if empty else [*odd_rows, (7, "the same words in each of two rows"), (8, "the same words in each of two rows")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).filter("piece = 0").collect()
    texts = {t for _, t in rows if t and t.split()}
    # Of rows with equal words one stays; rows without words are no copies of each other.
    assert len(out) == len(texts) + sum(not (t and t.split()) for _, t in rows)
    assert 8 not in {r["doc_id"] for r in out}


def test_registered(spark):
    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names
