from collections import defaultdict

from sluice.llm.line_dedup import dedup_lines


def brute(rows):
    """Rows (id, text) in order -> texts without the lines that later windows cover."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            w = tuple(s.strip(" ") for s in lines[at : at + 3])
            if not any(w):
                continue
            if w in seen:
                gone |= {at, at + 1, at + 2}
            seen.setdefault(w, i)
        out[i] = "\n".join(s for k, s in enumerate(lines) if k not in gone)
    return out


def result(df):
    return {r["doc_id"]: r["text"] for r in dedup_lines(df).select("_row.doc_id", "text").collect()}


def test_matches_brute_force(make_docs):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nd\ne"), (4, "q\nq\nq\nq\nq\nq"), (5, "short\ntext"), (6, "  b\nc \nd\nz"), (7, "\n\n\n\n"), (8, "m\n\nn\no"), (9, "m\n\nn\np")]
    assert result(make_docs(rows)) == brute(rows)


def test_first_occurrence_stays_and_no_line_is_lost(make_docs):
    rows = [(k, "\n".join(f"line {j}" for j in range(k, k + 6))) for k in range(20)]
    got = result(make_docs(rows))
    assert {s for t in got.values() for s in t.split("\n") if s} == {f"line {j}" for j in range(25)}
    assert got[0] == rows[0][1]


def test_odd_rows_come_back(make_docs, odd_rows):
    out = dedup_lines(make_docs(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert sorted(str(r["_row"]["doc_id"]) for r in out) == sorted(str(i) for i, _ in odd_rows)
    assert sum(r["text"] is None for r in out) == 2
    assert all(r["n_removed"] == 0 for r in out if r["n_lines"] < 3)


def test_rows_equal_in_all_columns_are_copies(make_docs):
    out = dedup_lines(make_docs([(1, "a\nb\nc")] * 3)).collect()
    assert sorted(r["text"] for r in out) == ["", "", "a\nb\nc"]


def test_empty_table(make_docs):
    assert dedup_lines(make_docs([])).count() == 0


def test_whole_groups_of_copies(make_docs):
    text = "\n".join(f"copied {k}" for k in range(8))
    got = result(make_docs([(k, text) for k in range(200)]))
    counts = defaultdict(int)
    for t in got.values():
        counts[t] += 1
    assert counts == {text: 1, "": 199}


def test_a_very_common_window_is_split_over_tasks(spark, make_docs):
    """Its rows meet its first occurrence in a join that Spark may split; results do not change."""
    rows = [(k, f"own {k}\nthe same\nthree\nlines\nlast {k}\nand {k}") for k in range(3000)]
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = dedup_lines(make_docs(rows).repartition(6))
        kept = [r["doc_id"] for r in out.select("_row.doc_id", "text").collect() if "the same" in r["text"]]
        df = out.select("n_removed")
        removed = [r["n_removed"] for r in df.collect()]
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == [0] and sorted(removed) == [0] + [3] * 2999
