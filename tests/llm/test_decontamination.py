import random
import re

import pytest

from sluice.llm import decontamination
from sluice.llm.decontamination import EDITS, WINDOWS, Patterns, count_regions, find_regions

ITEMS = "item_id long, text string, _plain string, doc_id string"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def damaged(text, edits, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], ["q"], [out[i], "z"]])
    return "".join(out)


def distance(pattern, text):
    """Fewest edits of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("seed", range(10))
def test_windows_within_the_budget_are_found(seed):
    """Against brute force: an item is found if and only if one of its windows has a region in its budget."""
    item = prose(40, seed).encode()[: 50 + 10 * seed].strip()
    block = Patterns([(0, item)])
    windows = [item[s : s + w] for w in {min(w, len(item)) for w in WINDOWS} for s in range(len(item) - w + 1)]
    for edits in (0, 4, 7, 9, 12, 30):
        text = (prose(12, seed + 100) + " " + damaged(item.decode(), edits, seed + edits) + " " + prose(12, seed + 200)).encode()
        need = [distance(w, text) for w in windows]
        found = block.regions([text])
        assert bool(found) == any(n <= int(EDITS * len(w)) for n, w in zip(need, windows, strict=True)), (edits, min(need))
        if found:
            # The alignment stays in its band, so it may need a few edits more than the best, never fewer.
            assert min(need) <= found[0][5] <= int(EDITS * min(len(item), max(WINDOWS)))


def test_short_items_are_found_as_whole_words():
    items = [b"tiny", b"a b", b"what is two plus two", b"two", b"q", b"plus two and"]
    block = Patterns(list(enumerate(items)))
    texts = [b"what is two plus two and three", b"tinyish untiny tiny", b"somewhat is two plus twofold", b"b a b a", b"tiny", b"", b"q q"]
    got = sorted((t, i, texts[t][a:b].strip()) for t, i, a, b, *_ in block.regions(texts))
    want = []
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            spans = [m.start() for m in re.finditer(b"(?= " + item + b" )", b" " + text + b" ")]
            # Finds that touch are one region.
            runs = sum(1 for k, s in enumerate(spans) if not k or s > spans[k - 1] + len(item) + 2)
            want += [(t, i)] * runs
    assert [g[:2] for g in got] == sorted(want)


def test_ids_of_any_type_and_equal_items(spark, make_docs):
    benchmark = spark.createDataFrame([("q-12", prose(30, 1)), ("q-13", prose(30, 1).upper()), (None, prose(30, 2))], "item_id string, text string")
    docs = make_docs([(1, prose(30, 1)), (2, prose(30, 2)), (3, prose(30, 3))])
    assert sorted(((r["doc_id"], r["item_id"]) for r in find_regions(docs, benchmark).collect()), key=str) == [(1, "q-12"), (1, "q-13"), (2, None)]


def test_what_many_items_share_is_laid_out_in_parts(monkeypatch):
    shared = prose(12, 5)
    items = [(n, (shared + " " + prose(20, 100 + n)).encode()) for n in range(40)]
    texts = [(prose(30, 900 + n) + " " + items[n][1].decode()).encode() for n in range(5)] * 3
    whole = Patterns(items).regions(texts)
    monkeypatch.setattr(decontamination, "LAID", 300)
    monkeypatch.setattr(decontamination, "TEXT_BYTES", 1000)
    assert Patterns(items).regions(texts) == whole and {f[0] for f in whole} == set(range(15))


@pytest.mark.parametrize("seed", range(3))
def test_verbatim_parts_of_64_bytes_are_found_at_every_offset(seed):
    item = prose(60, seed).encode()
    block = Patterns([(0, item)])
    before, after = (prose(40, seed + n).encode() for n in (500, 600))
    texts = [before + b" 0 " + item[s : s + 64] + b" 0 " + after for s in range(len(item) - 63)]
    assert [f[0] for f in block.regions(texts)] == list(range(len(texts)))


def test_several_texts_and_items(spark, make_docs, odd_rows):
    items = [(n, prose(45, n)) for n in range(6)] + [(7, "tiny"), (8, None), (9, ""), (0, prose(45, 0))]
    clean = [(100 + n, prose(300, 1000 + n)) for n in range(20)]
    bad = [(200 + n, prose(100, 2000 + n) + ". " + items[n][1].upper() + "! " + prose(50, 3000 + n) + " " + items[n][1]) for n in range(6)]
    benchmark = spark.createDataFrame([(i, t, "x", None) for i, t in items], ITEMS)
    docs = make_docs([*odd_rows, *clean, *bad])
    out = find_regions(docs, benchmark).collect()
    got = sorted((r["doc_id"], r["item_id"]) for r in out)
    assert got == sorted([(200 + n, n) for n in range(6) for _ in range(2)] + [(200, 0)] * 2)
    assert all(r["edits"] == 0 and r["word_end"] - r["word_start"] == 45 for r in out)
    counted = count_regions(docs, benchmark).collect()
    assert len(counted) == len(odd_rows) + 26
    assert sorted(r["_row"]["doc_id"] for r in counted if r["n_regions"]) == [200 + n for n in range(6)]


def test_blocks_give_the_same(spark, make_docs, monkeypatch):
    benchmark = spark.createDataFrame([(n, prose(30, n), None, None) for n in range(12)], ITEMS)
    docs = make_docs([(n, prose(80, 50 + n) + " " + prose(30, n)) for n in range(12)])
    whole = sorted(map(tuple, find_regions(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, find_regions(docs, benchmark).collect())) == whole and len(whole) == 12
    assert sum(r["n_regions"] for r in count_regions(docs, benchmark).collect()) == 12


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    assert find_regions(make_docs([(1, "text")]), none).count() == 0
    assert find_regions(make_docs([]), spark.createDataFrame([(1, prose(30, 1), None, None)], ITEMS)).count() == 0
