import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm.packing import pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(steps):
    """(length, rank) -> (sequence, offset)."""
    return {(length, rank + k): (first + k // each, offset + k % each * length) for length, rank, n, first, each, offset in steps for k in range(n)}


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_gapless_and_whole(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
    slots = placed(plan(histogram, 64))
    assert set(slots) == {(k, r) for k, n in histogram.items() for r in range(n)}
    held = defaultdict(list)
    for (length, _), (s, o) in slots.items():
        held[s].append((o, length))
    assert sorted(held) == list(range(len(held)))
    for own in held.values():
        end = 0
        for o, length in sorted(own):
            assert o == end
            end += length
        assert end <= 64


@pytest.mark.parametrize("seed", range(10))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 20) for _ in range(25)}
    rooms = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - length)
    assert len({s for s, _ in placed(plan(histogram, 100)).values()}) == len(rooms)


def test_lengths_must_fit():
    with pytest.raises(ValueError, match="does not fit"):
        plan({5: 1}, 4)
    assert plan({}, 10) == []


def test_documents(spark, make_docs, odd_rows):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [*odd_rows, (30, "Hello <|endoftext|> wörld, it's 12 o'clock　now"), (31, "A B C\x1cD é")]
    out = pack(make_docs(rows), PATH, capacity=512).collect()
    own = defaultdict(list)
    for r in out:
        own[r["doc_id"]].append(r)
    for i, text in rows:
        if i in (None, 4, 6):
            continue
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(own[i], key=lambda r: r["piece"])
        got = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist()
        assert got == want
        assert [p["start"] for p in pieces] == [512 * k for k in range(len(pieces))]
        assert all(p["length"] == 512 for p in pieces[:-1])
    assert len(own[4]) == 2 and len(own[6]) == 2 and len(own[None]) == 2
    held = defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in held.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= 512
    total = sum(r["length"] for r in out)
    assert len(held) <= -(-total // 512) + 1


def test_checksum_is_of_the_ids(spark, make_docs):
    r = pack(make_docs([(1, "hello world")]), PATH).withColumn("crc", F.crc32("ids")).first()
    assert r["crc"] == zlib.crc32(np.array([*Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_empty_table(make_docs):
    assert pack(make_docs([]), PATH).count() == 0
