import re
from collections import Counter, defaultdict

import pytest

from sluice.llm import divergence as d

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=30, top=50):
    """The audit of (lang, source, text) rows, step by step."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(lowered(text or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g for g, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: counts[g, s][t] for t in kept} for g, s in counts if g == lang}
        p = {s: {t: 1 + 1_000_000_000 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in own.items()}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        q = {t: 1 + 1_000_000_000 * (n + 5) // (sum(whole.values()) + 5 * len(kept)) for t, n in whole.items()}
        for s in own:
            pairs = [(other, sum(abs(p[s][t] - p[other][t]) for t in kept)) for other in own if other != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, docs long, item string, p string, q string, _part string, _all string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", None, 1, None, "x", None, "x", None) for i, (lang, s, t) in enumerate(rows)], SCHEMA)


def words(seed, n):
    return " ".join(f"W{'abcdefghij'[(seed * k + k * k) % 10]}é{'xyzuv'[(seed + k) % 5]}" for k in range(n))


def test_matches_brute_force(spark):
    rows = [(["en", "de", None][k % 3], [f"s{k % 4}", None, ""][min(2, k % 7)], words(k, 3 + k % 40) + "!The Ünter-scheid 𝒳y [dot]^`{a}~ \x7fB" * (k % 2)) for k in range(300)]
    rows += [("one", "alone", "only a few words"), ("two", "a", None), ("two", "b", ""), ("two", "c", " \n1 2 3 ")] + [("fr", "x", "le même")] * 40 + [("fr", "y", "autre")]
    got = sorted(map(tuple, d.divergence(table(spark, rows)).collect()))
    assert got == brute(rows)
    assert {r[:2] for r in got if r[0] == "two"} == {("two", "a"), ("two", "b"), ("two", "c")} and all(r[4] == 0 for r in got if r[0] == "two")


def test_ranks_stop_at_the_top_and_ties_go_by_bytes(spark):
    terms = [chr(0x61 + k % 26) * (1 + k // 26) + "é" * (k % 3) for k in range(70)] + ["zé", "z\U0001d4b3", "z"]
    rows = [("en", "a", " ".join(terms))] * 31 + [("en", "b", "other")] * 31
    got = sorted(map(tuple, d.divergence(table(spark, rows)).collect()))
    assert got == brute(rows)
    assert max(r[5] for r in got if r[2] == "term") == 50


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    text = words(3, 5000) + " äöü" * 500 + "x" * 3000
    rows = [("en", "a", text), ("en", "b", "x " + text), ("en", "b", text[::-1])] * 11
    want = brute(rows)
    assert sorted(map(tuple, d.divergence(table(spark, rows)).collect())) == want
    import pyarrow as pa

    monkeypatch.setattr(d, "PIECE_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2].encode() for r in rows], pa.binary())], names=["lang", "source", "_text"])
    counts, docs = Counter(), Counter()
    for out in d._matches(iter([batch, batch.slice(5, 3), batch.slice(0, 0)])):
        for r in out.to_pylist():
            counts[r["lang"], r["source"], r["term"].decode()] += r["n"]
            docs[r["lang"], r["source"], r["term"].decode()] += r["docs"]
    wanted, held = Counter(), Counter()
    for lang, source, t in rows + rows[5:8]:
        found = TERM.findall(lowered(t))
        wanted.update((lang, source, x) for x in found)
        held.update((lang, source, x) for x in set(found))
    assert counts == wanted and docs == held


def test_counts_beyond_64_bits_when_scaled(spark):
    from pyspark.sql import functions as F

    rows = [(10**14, 10**15, 7), (d._SHORT - 1, d._SHORT + 10, 1), (d._SHORT, d._SHORT + 10, 1), (0, 0, 1)]
    df = spark.createDataFrame(rows, "n long, m long, v long")
    got = [r[0] for r in df.select(d._frequency(F.col("n"), F.col("m"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (m + 5 * v) for n, m, v in rows]


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("en", "a", "x")]])
def test_tables_without_pairs_or_terms(spark, rows):
    assert d.divergence(table(spark, rows)).collect() == []
