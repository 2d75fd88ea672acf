import zlib

import numpy as np

from sluice.llm.sharding import jump_hash, shard


def one(key, shards):
    """The rule for a single key, step by step."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_matches_the_rule():
    keys = np.random.RandomState(0).randint(0, 1 << 63, 2000).astype(np.uint64)
    for n in (1, 2, 7, 40):
        assert jump_hash(keys, n).tolist() == [one(int(k), n) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 5, 40):
        a, b = jump_hash(keys, n), jump_hash(keys, n + 1)
        assert set(b[a != b]) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02
    assert np.bincount(jump_hash(keys, 40)).std() < 60


def test_rows(make_docs, odd_rows):
    rows = [*odd_rows, *[(100 + k, f"text {k % 7}") for k in range(500)]]
    out = shard(make_docs(rows), shards=5, buckets=3).collect()
    assert len(out) == len(rows)
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 5) and r["law"] == "key" for r in out)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert len({r["shard"] for r in out if r["doc_id"] == 4}) == 1


def test_key_alone_decides(make_docs):
    a = {r["doc_id"]: r["shard"] for r in shard(make_docs([(k, "x") for k in range(50)])).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard(make_docs([(k, f"other {k}") for k in range(25, 75)])).collect()}
    assert all(a[k] == b[k] for k in range(25, 50))


def test_empty_table(make_docs):
    assert shard(make_docs([])).count() == 0
