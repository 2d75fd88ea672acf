"""Keys of any size: what is dealt to ranges gives the plain window's rows."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice import catalog
from sluice.errors import CompileError
from sluice.operators import aggregates, history, ranges, relational
from tests.conftest import TABLES


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    monkeypatch.setattr(ranges, "HOT_ROWS", 90)


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most of the rows, small keys, single rows, a null key; values with nulls and ties."""
    made = [("hot", i, None if i % 11 == 0 else float(i * 37 % 101), i * 7 % 3) for i in range(500)]
    made += [(k, i, float(i), i % 2) for k in ("a", "b", None) for i in range(30)] + [(f"s{i}", i, 1.0, 0) for i in range(60)]
    return spark.createDataFrame(made, "k string, i int, v double, c int").repartition(5)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_a_hot_key_spans_many_ranges(rows, small_ranges):
    dealt = ranges.deal(rows, ["k"], ["i"])
    spread = {r["k"]: r["n"] for r in dealt.groupBy("k").agg(F.count_distinct("_range").alias("n")).collect()}
    assert spread["hot"] >= 8 and spread["s1"] == 1
    assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] <= 200


def test_only_hot_keys_are_dealt(rows, monkeypatch):
    monkeypatch.setattr(ranges, "HOT_ROWS", 499)
    assert ranges.has_hot_key(rows, ["k"])
    monkeypatch.setattr(ranges, "HOT_ROWS", 500)
    assert not ranges.has_hot_key(rows, ["k"])
    monkeypatch.setattr(ranges, "HOT_ROWS", 10_000)
    assert not ranges.has_hot_key(rows, [])


def test_positions(rows, small_ranges):
    plain = rows.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("i")).cast("long") - 1)
    same(ranges.numbered(rows, ["k"], ["i"], "p"), plain)
    everything = rows.withColumn("p", F.row_number().over(Window.orderBy("k", "i")).cast("long") - 1)
    same(relational.positions(rows, ["k", "i"], "p"), everything)
    chunks = relational.chunk_by_count(rows, ["k"], ["i"], 7)
    assert max(r["count"] for r in chunks.groupBy("k", "chunk").count().collect()) == 7


def test_running_totals(rows, small_ranges):
    so_far = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum("v").over(so_far).alias("s"), F.count("v").over(so_far).alias("n"), F.min("v").over(so_far).alias("low"), F.max("c").over(so_far).alias("high"))
    same(ranges.running(rows, ["k"], ["i"], {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("c"))}), want)
    for op in aggregates.BUILTIN:
        same(aggregates.running(rows, ["k"], op, "v", ["i"]), rows.select("k", aggregates.BUILTIN[op]("v").over(so_far).alias(f"{op}(v)")))
    with pytest.raises(CompileError):
        ranges.running(rows, ["k"], ["i"], {"x": ("median", F.col("v"))})


def test_running_totals_of_nulls_stay_null(spark, small_ranges):
    df = spark.range(200).select(F.lit(1).alias("k"), "id", F.when(F.col("id") == 150, 5.0).alias("v"))
    got = ranges.running(df, ["k"], ["id"], {"s": ("sum", F.col("v"))}).orderBy("id").collect()
    assert [r["s"] for r in got] == [None] * 150 + [5.0] * 50


@pytest.mark.parametrize("n", [1, 2, 10, 39, 40, 41, 130])
def test_frames_over_the_last_rows(rows, small_ranges, n):
    """Also frames longer than a range, whose halo comes from several ranges before."""
    columns = lambda w: {"held": F.collect_list("i").over(w), "sum": F.sum("v").over(w)}
    same(history.over_last(rows, ["k"], ["i"], n, columns), rows.withColumns(columns(history.last(["k"], ["i"], n))))


def test_streaks_and_differences(rows, small_ranges, monkeypatch):
    found = lambda: [aggregates.streaks(rows, "k", "c", ["i"], 2), history.weighted_increase(rows, ["k"], ["i"], "v", 10, "up"), history.fine_interval(rows, ["k"], ["i"], "i", 5, "gap"), aggregates.emit_when(rows, ["k"], ["i"], 4, lambda keys: F.size(keys) > 3, "c")]
    dealt = found()
    monkeypatch.setattr(ranges, "HOT_ROWS", 1 << 40)
    for a, b in zip(dealt, found(), strict=True):
        same(a, b)


def test_empty_and_unordered(rows, small_ranges):
    assert ranges.numbered(rows.limit(0), [], ["i"]).collect() == []
    with pytest.raises(CompileError):
        relational.positions(rows, [])


ORDERED = ["hist_ingress_rate", "hist_fine_rate", "hist_mean_age", "hist_mean_increase", "hist_weighted_increase", "hist_past_counts", "route_cost_shares", "route_lookahead_greedy", "route_lookahead_grouped", "route_money_guard", "money_budget_running", "budget_sub_batches", "budget_pd", "group_sum_running", "group_avg_running", "group_min_running", "agg_streak3", "agg_streak_n", "agg_componentized_emit_when", "chunk_by_count", "stream_positions", "assign_greedy", "output_log"]


@pytest.mark.parametrize("name", ORDERED)
def test_queries_give_their_sql_when_their_keys_are_hot(spark, monkeypatch, name):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 150)
    monkeypatch.setattr(ranges, "HOT_ROWS", 10)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{TABLES}/events.parquet'")
    df = catalog.QUERIES[name](spark, TABLES)
    listed = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, con.sql(f"SELECT {listed} FROM ({catalog.SQL[name]})").fetchall()))


@pytest.mark.parametrize(("window", "most"), [(50, 4), (7, 100), (0, 3), (1 << 40, 5)])
def test_species_counts_hold_both_bounds(spark, window, most):
    """Against a fold over arrivals: times repeat, weights and expectations may be null."""
    made = [("ab"[i % 2], (i * 13 % 97) // 3, i, None if i % 7 == 0 else i % 5 / 4, None if i % 3 else i % 11) for i in range(150)]
    df = spark.createDataFrame(made, "c string, t long, i int, p double, e int")
    got = {r["i"]: (round(r["count"], 9), r["expected_count"]) for r in aggregates.species_counts(df, "c", "t", "p", "e", window, most, ["i"]).collect()}
    for c, t, i, _, _ in made:
        seen = sorted((u, j, p, e) for d, u, j, p, e in made if d == c and (u, j) <= (t, i))[-most:]
        kept = [(p, e) for u, _, p, e in seen if u >= t - window]
        top = max((e for _, e in kept if e is not None), default=0)
        assert got[i] == (round(sum(p or 0.0 for p, _ in kept), 9), top or None)


@pytest.mark.parametrize("name", ["agg_species_count_capped", "agg_species_count_prob", "agg_species_count_simple"])
def test_species_counts_meet_no_row_once_for_each_frame(spark, monkeypatch, name):
    """No frame in time that slides, which would go through all its rows again for each row; hot keys give the SQL's rows."""
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "specifiedwindowframe(RangeFrame, -" not in plan(catalog.QUERIES[name](spark, TABLES))
    test_queries_give_their_sql_when_their_keys_are_hot(spark, monkeypatch, name)


@pytest.mark.parametrize("small", [True, False])
def test_recent_totals_look_back_to_the_first_row_near_enough(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
        monkeypatch.setattr(ranges, "HOT_ROWS", 20)
    made = [("ab"[i % 2], None if i % 50 == 0 else (i * i % 211) - 60, i, None if i % 7 == 0 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(made, "k string, t long, i int, v double")
    got = {r["i"]: (r["s"], r["n"], r["m"]) for r in ranges.recent(df, ["k"], "t", ["i"], 25, {"s": ("sum", F.col("v")), "n": ("count", F.col("i")), "m": ("min", F.col("v"))}).collect()}
    for k, t, i, _ in made:
        seen = [v for d, u, j, v in made if d == k and ((u is None and j <= i) if t is None else u is not None and t - 25 <= u and (u, j) <= (t, i))]
        kept = [v for v in seen if v is not None]
        assert got[i] == (sum(kept) if kept else None, len(seen), min(kept, default=None))
