import random
import re

import numpy as np
import pytest

from sluice.llm import near_dups
from sluice.llm.near_dups import min_max, near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def edited(words, share, rng):
    return [rng.choice("abcdefgh") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: f"v{int(rng.expovariate(0.01))}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(20, 120)))) for i in range(80)]
    for g in range(8):
        base = [word() for _ in range(rng.randint(30, 200))]
        rows += [(1000 * (g + 1) + k, " ".join(edited(base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]), rng))) for k in range(15)]
    shared = " ".join(word() for _ in range(40))
    rows += [(20_000 + k, shared + " " + " ".join(word() for _ in range(rng.randint(5, 40)))) for k in range(60)]
    rows += [(30_000 + k, rows[0][1].upper()) for k in range(20)]
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_matches_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = corpus(block)
    out = near_duplicates(make_docs(rows)).select("_row.doc_id", "n_shingles", "component_id", "kept", "is_first").collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == r["is_first"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = near_duplicates(docs).collect()
    assert len(out) == len(odd_rows)
    empty = [r for r in out if r["n_shingles"] == 0]
    assert len(empty) == 4 and all(r["kept"] and r["is_first"] and r["component_id"] == r["_row"]["doc_id"] for r in empty)
    pair = [r for r in out if r["_row"]["doc_id"] == 4]
    assert [r["n_shingles"] for r in pair] == [1, 1] and sorted(r["is_first"] for r in pair) == [False, True]
    assert near_duplicates(docs).select("_row.*").columns == docs.columns


def test_null_ids_come_last(make_docs):
    text = "one two three four five six seven"
    out = near_duplicates(make_docs([(None, text), (9, text), (None, text), (None, "other words altogether here now")])).collect()
    assert sorted((str(r["_row"]["doc_id"]), str(r["component_id"]), r["is_first"]) for r in out) == [("9", "9", True), ("None", "9", False), ("None", "9", False), ("None", "None", True)]


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).count() == 0


def test_min_max_estimates_similarity():
    rng = np.random.RandomState(2)
    a = rng.randint(0, 1 << 62, 400).astype(np.uint64) * np.uint64(3)
    for share in (0.2, 0.5, 0.8):
        n = int(400 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.randint(0, 1 << 62, 400 - n).astype(np.uint64) * np.uint64(3)])
        (la, ha), (lb, hb) = min_max(a), min_max(b)
        assert abs(np.r_[la == lb, ha == hb].mean() - n / (800 - n)) < 0.12
