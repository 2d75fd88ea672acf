import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice import catalog
from sluice.errors import CompileError
from sluice.functions import boxes, images, signal, text
from sluice.operators import aggregates, assign, budget, classify, history, joins, models, relational, routing, scheduler, vectors
from sluice.operators.classify import Bucket
from sluice.operators.history import Lookahead
from sluice.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- assignment: known values and seeded comparison ---------------------------------------------

P1, P2 = Bucket([0, 14, 18], [0, 1, 2], 1), Bucket([0, 12, 15], [0, 1, 2], 2)


def test_grouping_of_buckets():
    indices, grouped = assign.group_buckets([Bucket([1], [2], "A"), Bucket([2], [3], "A"), Bucket([3], [4], "B"), Bucket([9], [9]), Bucket([9], [9])])
    assert indices == [0, 0, 1, 2, 3]
    assert [(b.rewards, b.costs) for b in grouped[:2]] == [([1.5], [2.5]), ([3], [4])]


def test_greedy_known_values():
    two = assign.greedy([P1, P2], [1, 2], 2)
    assert (two.swaps, two.reward, two.cost) == (2, 26, 2)
    four = assign.greedy([P1, P2], [2, 1], 4)
    assert (four.swaps, four.reward, four.cost) == (4, 43, 4)
    single = assign.per_item_greedy([P2, P2, P1], 2)
    assert single[1:] == (26, 2)


@pytest.mark.parametrize("n", range(1, 13))
def test_optimal_is_never_worse(n):
    for seed in range(60):
        rng = random.Random(seed * 100 + n)
        own = [Bucket([0, *sorted(rng.random() for _ in range(3))], [0, *sorted(rng.random() for _ in range(3))]) for _ in range(n)]
        money = rng.random() * n
        greedy, best = assign.greedy(own, [1] * n, money), assign.optimal(own, [1] * n, money)
        assert greedy.cost <= money + 1e-9 and best.cost <= money + 1e-9
        assert best.reward >= greedy.reward - 1e-9


def test_optimal_against_enumeration():
    from itertools import product

    for seed in range(40):
        rng = random.Random(seed)
        own = [Bucket([0, rng.random(), rng.random()], [0, rng.random(), rng.random()]) for _ in range(4)]
        money = rng.random() * 2
        best = max(sum(b.rewards[p] for b, p in zip(own, ps, strict=True)) for ps in product(range(3), repeat=4) if sum(b.costs[p] for b, p in zip(own, ps, strict=True)) <= money)
        assert assign.optimal(own, [1] * 4, money).reward == pytest.approx(best)


def test_optimal_by_counts_is_the_one_by_items(monkeypatch):
    rng = random.Random(1)
    for seed in range(200):
        price = lambda whole=seed % 2: float(rng.randint(0, 6)) if whole else rng.random() * 5
        own = [Bucket([0.0, *(float(rng.randint(0, 20)) for _ in range(3))], [0.0, price(), price(), price()], k) for k in range(rng.randint(1, 3))]
        items, money = [rng.randint(0, 5) for _ in own], rng.random() * 20
        monkeypatch.setattr(assign, "BY_ITEM", 64)
        one = assign.optimal(own, items, money)
        monkeypatch.setattr(assign, "BY_ITEM", -1)
        if not sum(items):
            continue
        many = assign.optimal(own, items, money)
        assert many.reward == pytest.approx(one.reward)
        for done in (one, many):
            assert [sum(c.values()) for c in done.counts] == items and done.cost <= money + 1e-6
            assert sum(b.costs[p] * n for b, c in zip(own, done.counts, strict=True) for p, n in c.items()) == pytest.approx(done.cost)


def test_optimal_takes_a_window_of_a_hundred_thousand_items():
    done = assign.optimal([P1, P2], [60_000, 40_000], 90_000.0)
    assert [sum(c.values()) for c in done.counts] == [60_000, 40_000] and done.cost == 90_000
    assert done.reward == 60_000 * 14 + 30_000 * 12


def test_counts_and_distribution():
    done = assign.greedy([P1, P2], [3, 4], 5)
    assert [sum(c.values()) for c in done.counts] == [3, 4]
    classes = [0, 1, 1, 0, 1, 0, 1]
    given = assign.distribute(done, classes, seed=3)
    for c in (0, 1):
        own = [p for p, k in zip(given, classes, strict=True) if k == c]
        assert sorted(own) == sorted(p for p, n in done.counts[c].items() for _ in range(n))
    assert assign.optimal_or_start([P1], [2], 0.5).cost == 0
    assert assign.within(assign.Assignment([{2: 1}], 18, 2), [P1], [1], 1.0).reward == 0


def test_swaps_skip_bad_pipelines():
    dear = Bucket([0, 5, 4, 9], [0, 3, 4, 6])
    assert [(s.start, s.end) for s in assign.swaps([dear])] == [(1, 3), (0, 1)]
    cheaper = Bucket([5, 1, 9], [3, 1, 6])
    assert [(s.start, s.end) for s in assign.swaps([cheaper])] == [(1, 2)]


def test_windows_keep_their_budget(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "i int, w int, c int")
    out = assign.assign_windows(df, "w", "c", ["i"], [P1, P2], F.lit(7.0), "greedy")
    spent = out.groupBy("w").agg(F.sum("pipeline").alias("s"), F.count("*").alias("n")).collect()
    assert [(r["s"], r["n"]) for r in spent] == [(7, 20)] * 3


def test_swap_table_walks_over_bad_pipelines(spark):
    rows_ = [("a", p, float(r), float(c)) for p, (r, c) in enumerate([(0, 0), (5, 1), (4, 2), (9, 3)])]
    rows_ += [("b", p, float(r), float(c)) for p, (r, c) in enumerate([(5, 3), (1, 1), (9, 6)])] + [("c", 0, 1.0, 1.0)]
    out = assign.swap_table(spark.createDataFrame(rows_, "l string, p int, r double, c double"), "l", "p", "r", "c")
    assert rows(out.select("l", "start_pipeline", "end_pipeline")) == [("a", 0, 1), ("a", 1, 3), ("b", 1, 2)]
    rng = random.Random(5)
    many = [(str(k), [(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 7))]) for k in range(40)]
    df = spark.createDataFrame([(k, p, float(r), float(c)) for k, own in many for p, (r, c) in enumerate(own)], "l string, p int, r double, c double")
    got = rows(assign.swap_table(df, "l", "p", "r", "c").select("l", "start_pipeline", "end_pipeline", "swap_cost"))
    want = [(k, s.start, s.end, float(s.cost)) for k, own in many for s in assign.swaps([Bucket([float(r) for r, _ in own], [float(c) for _, c in own])])]
    assert got == sorted(want)


def test_windows_with_unknown_classes(spark):
    df = spark.createDataFrame([(0, None, 0), (1, 5, 0), (2, -1, 0), (3, 1, 0), (4, 0, None), (5, None, None)], "i int, c int, w int")
    got = {r["i"]: r["pipeline"] for r in assign.assign_windows(df, "w", "c", ["i"], [P1, P2], F.lit(9.0)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 0}
    assert assign.assign_windows(df.limit(0), "w", "c", ["i"], [P1, P2], F.lit(9.0)).count() == 0


def test_single_items_leave_dear_pipelines_out():
    bins = [Bucket([0.0, 9.0, 5.0], [0.0, 2.0, 3.0]), Bucket([0.0, 9.0, 5.0], [0.0, 2.0, 3.0]), Bucket([0.0, 4.0], [0.0, 1.0])]
    assert [(s.bucket, s.start, s.end) for s in assign.item_swaps(bins[:1])] == [(0, 0, 1)]
    assert assign.per_item_greedy(bins, 3.0) == ([0, 1, 1], 13.0, 3.0)
    assert assign.per_item_greedy(bins, 0.0)[0] == [0, 0, 0] and assign.per_item_greedy([], 5.0) == ([], 0, 0)


@pytest.mark.parametrize("seed", range(20))
def test_scheduler_keeps_its_budget(seed):
    rng = random.Random(seed)
    buckets = [Bucket([0.0, *sorted(rng.uniform(0, 9) for _ in range(2))], [0.0, *sorted(rng.uniform(0, 4) for _ in range(2))], k) for k in range(3)]
    known, past = [rng.randrange(3) for _ in range(rng.randrange(1, 30))], {0: 3, 1: 0, 2: 4}
    for strategy in ("greedy", "optimal"):
        for look in (Lookahead(count=len(known)), Lookahead(count=len(known) + 8), Lookahead(time_ms=4.0), Lookahead(count=5, time_ms=40.0)):
            routes = scheduler.schedule(known, buckets, past, look, 1000.0, 20, 12.0, strategy)
            assert len(routes) == len(known) and sum(buckets[c].costs[p] for c, p in zip(known, routes, strict=True)) <= 12 + 1e-6
    assert scheduler.capped(Lookahead(time_ms=9.0), "optimal") == Lookahead(10, 9.0) and scheduler.capped(Lookahead(time_ms=9.0), "greedy").count is None
    # An adjuster that makes everything but dropping too dear.
    nothing = lambda bins: [Bucket(b.rewards, [0.0] + [99.0] * (len(b.costs) - 1), b.id) for b in bins]
    assert set(scheduler.schedule(known, buckets, past, Lookahead(count=5), 1000.0, 20, 12.0, adjust=nothing)) == {0}


def test_scheduler_scales_the_budget_by_the_share_kept():
    look = Lookahead(count=4, time_ms=8.0)
    assert scheduler.schedule([0] * 4, [P1], {0: 1}, look, 1000.0, 5, 4.0) == [0, 0, 1, 1]
    assert scheduler.schedule([0] * 4, [P1], {0: 1}, Lookahead(count=4), 1000.0, 5, 4.0) == [1, 1, 1, 1]


def test_language_model_buckets(spark):
    assert [b.id for b in classify.llm_buckets([1.0, 2.0, 3.0])] == ["000", "001", "010", "011", "100", "101", "110", "111"]
    assert classify.llm_buckets([1.0, 2.0, 3.0])[5].rewards == [0.0, 0.856, 0.814, 0.893]
    df = spark.createDataFrame([([1.0, -1.0],), ([-1.0, 1.0],)], "x array<double>")
    form = lambda *w: {"weights": list(w), "intercept": 0.0}
    got = classify.llm_bucket(df, F.col("x"), [form(1, 0), form(0, 1), form(2, 1)], [form(1, 1), form(3, 0), form(0, 2)]).collect()
    assert [(r["class"], list(r["costs"])) for r in got] == [(5, [0.0, 0.0, 3.0, -2.0]), (2, [0.0, 0.0, -3.0, 2.0])]
    assert list(got[1]["rewards"]) == [0.0, 0.704, 0.860, 0.814]
    pre = classify.Preclassifier("static", {}, [Bucket([1.0], [2.0], "a"), Bucket([3.0], [4.0], "b")])
    ids = spark.createDataFrame([("b",), ("z",), (None,)], "label string")
    assert rows(pre.bucketed_by_id(ids, "label").select("label", "class", F.get("costs", F.lit(0)))) == sorted([("b", 1, 4.0), ("z", None, None), (None, None, None)], key=str)


def test_static_routes_drop_old_rows_first_and_then_those_without_room(spark):
    df = spark.createDataFrame([(i, 0, 999 if i % 2 else 5) for i in range(10)], "i int, tick int, age int")
    out = routing.static_with_overflow(df, 2, F.col("age"), 100, "tick", ["i"], 3)
    assert {r["i"]: r["__route"] for r in out.collect()} == {i: 2 if i in (0, 2, 4) else 0 for i in range(10)}
    same, seen = routing.noop_counter(df)
    assert same.count() == 10 and seen.get["n"] == 10
    assert routing.blocking_noop(df, 0.001).count() == 10


def test_outputs_stop_at_a_count(spark):
    df = spark.range(50).select((49 - F.col("id")).alias("v"))
    assert rows(relational.log_output(df, ["v"], 3)) == [(0, 1), (1, 2), (2, 3)]
    assert relational.log_output(df, ["v"]).count() == 50
    assert rows(relational.repeat(df, 3, order=["v"], total=52).groupBy("cycle").count()) == [(0, 50), (1, 2)]


# --- history, forecast, budgets ------------------------------------------------------------------


def test_weighted_increase(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([0, 2, 4, 7, 11, 16])], "k int, t int, v double")
    last = history.weighted_increase(df, ["k"], ["t"], "v", 6, "inc").orderBy("t").collect()
    assert last[0]["inc"] == 0.0 and last[-1]["inc"] == pytest.approx((2 + 4 + 9 + 16 + 25) / 15)


def test_forecast():
    bins, kept = history.forecast([0] * 16, {0: 25, 1: 25}, history.Lookahead(10, 1000.0), 1000.0, 50)
    assert len(bins) == 16 and kept < 0.1
    more, kept = history.forecast([0], {0: 1, 1: 3}, history.Lookahead(9), None, 4)
    assert more == [0, 0, 0, *[1] * 6] and kept == 1.0
    assert history.window_size(history.Lookahead(None, 1000.0), 50.0, 10) == 0
    assert history.window_size(history.Lookahead(None, 1000.0), 1000.0, 1) == 0
    with pytest.raises(CompileError):
        history.window_size(history.Lookahead(), 1.0, 5)
    assert history.perfect_forecast([1, 2, 3], 2, 4) == [3, 1, 2, 3]


def test_stale_cleanup(spark):
    df = spark.createDataFrame([(1, 0)], "id int, created int")
    for include, past in ((True, 1), (False, 0)):
        left, purged = history.stale_cleanup(df, "id", "created", F.lit(1001), 1000, include)
        assert left.count() == 0 and purged.count() == past
    assert history.stale_cleanup(df, "id", "created", F.lit(1001), 1000)[1].first()["pipeline"] == 0


def test_budgets(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert one(budget.v2(lit(100.0), lit(-1.0), lit(10.0))) == 100
    assert one(budget.v2(lit(100.0), lit(2.5), lit(10.0), "sqrt")) == 50
    assert one(budget.v2(lit(100.0), lit(11.0), lit(10.0))) == 0
    assert one(budget.v3(lit(100.0), lit(5.0), lit(-100.0), lit(10.0))) == pytest.approx(52.5)
    assert one(budget.v3(lit(100.0), lit(20.0), lit(0.0), lit(10.0))) == 0
    assert one(budget.penalty("prop_mean", lit(1.0), lit(2.0), lit(3.0))) == 3
    assert budget.options(gain_p=2).gain_p == 2 and budget.options().scheduling_batch == 16
    for bad in (lambda: budget.options(other=1), lambda: budget.v2(lit(1.0), lit(1.0), lit(1.0), "x"), lambda: budget.penalty("x", lit(1), lit(1), lit(1))):
        with pytest.raises(CompileError):
            bad()


def test_window_budgets_follow_the_options(spark):
    df = spark.createDataFrame([(100.0, 200.0, 50.0, 10.0)], "l double, d double, growth double, age double")
    of = lambda **o: df.select(budget.for_window(budget.options(**o), F.col("l"), F.col("d"), F.col("growth"), F.col("age"), F.lit(4), F.lit(2.0)).alias("b")).first()["b"]
    assert of(budget_version=1) == 4 * 2 * 100 / 200
    assert of(budget_version=2, penalty="linear_max") == 100 * (1 - 0.25) and of(budget_version=2, penalty="none") == 100
    assert of(budget_version=2, penalty="linear_max", large_excess="sqrt") == 100 * (1 - 0.25**0.5)
    assert of(budget_version=3, penalty="prop_mean") == 100 * (1 - 10 / 200) * 0.75
    with pytest.raises(CompileError):
        of(budget_version=4)
    assert df.select(budget.for_window(budget.options(), F.col("l"), F.col("d"), controlled=F.lit(7.0)).alias("b")).first()["b"] == 7


def test_pd_control_follows_the_fold(spark):
    ages = [10.0, 20.0, 15.0, 40.0, 80.0]
    df = spark.createDataFrame([(0, i, a, 100.0, 200.0) for i, a in enumerate(ages)], "k int, t int, age double, L double, D double")
    got = [r["budget"] for r in budget.pd_control(df, ["k"], ["t"], "age", "L", "D").orderBy("t").collect()]
    ema, want, before = 0.0, [], None
    for a in ages:
        if before is not None:
            ema = 0.9 * ema + 0.1 * (a - before)
        before = a
        want.append(max(100 * (1 - 1.05 * a / 200) * min(1.05, 1 - ema / 200), 0))
    assert got == pytest.approx(want)


# --- routing -----------------------------------------------------------------------------------


def test_eddies_prefer_free_pipes(spark):
    df = spark.range(300).select(F.lit(1).alias("tick"), F.col("id"))
    out = routing.eddies(df, "tick", "id", ["id"], routing.draw(F.col("id")), [10, 1000], 0)
    counts = {r["__route"]: r["count"] for r in out.groupBy("__route").count().collect()}
    assert counts[2] > 200 and counts[1] <= 10 and sum(counts.values()) == 300


def test_full_pipes_drop(spark):
    df = spark.range(20).select(F.lit(1).alias("tick"), F.col("id"))
    out = routing.eddies(df, "tick", "id", ["id"], routing.draw(F.col("id")), [3, 4], 0)
    assert {r["__route"]: r["count"] for r in out.groupBy("__route").count().collect()} == {0: 13, 1: 3, 2: 4}


def test_reroute_options(spark):
    with pytest.raises(CompileError):
        routing.reroute_zero(F.lit(0), "other", F.lit(0.5), 2)
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(routing.reroute_zero(F.lit(0), "first", F.lit(0.5), 2)) == 1
    assert one(routing.reroute_zero(F.lit(0), "random", F.lit(0.9), 2)) == 2
    assert one(routing.reroute_zero(F.lit(0), "ignore", F.lit(0.9), 2)) == 0


def test_money_guard_spends_a_budget_to_the_cent(spark):
    costs = {1: [0.7] * 2857 + [0.1, 0.01], 2: [None, 1e18, -1e18, 1e-13, 2000.0, float("inf"), 1.0], 3: [None, None], 4: [1.0, float("nan"), 5000.0]}
    df = spark.createDataFrame([(k, i, v) for k, own in costs.items() for i, v in enumerate(own)], "k int, i int, v double")
    spent = routing.money_spent(df, ["k"], ["i"], "v")
    out = spent.withColumn("route", routing.money_guard(F.col("spent"), F.lit(2000), 2)).orderBy("k", "i").collect()
    assert [r["route"] for r in out if r["k"] == 1] == [2] * 2858 + [0]
    assert [r["spent"] for r in out if r["k"] == 1][-2:] == [2000.0, 2000.01]
    assert [r["spent"] for r in out if r["k"] == 2] == [None, 1e18, 0.0, 1e-13, 2000.0 + 1e-13, float("inf"), float("inf")]
    assert [r["route"] for r in out if r["k"] != 1] == [2, 0, 2, 2, 2, 0, 0, 2, 2, 2, 2, 2]
    assert [r["spent"] for r in out if r["k"] == 3] == [None, None]


def test_route_money_guard_is_exact(spark, tmp_path):
    rows = [(i, 1704067200 + i, 5, v) for i, v in enumerate([0.7] * 2857 + [0.1, 0.01])]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double")
    df.select("event_id", "user_id", F.lit("click").alias("event_type"), "value", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), F.lit("").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    assert [r["event_id"] for r in catalog.route_money_guard(spark, str(tmp_path)).filter("route = 0").collect()] == [2858]


# --- preclassifiers ----------------------------------------------------------------------------


def test_preclassifier_files(spark):
    raw = {"preclassifier": {"kind": "binary", "weights": [1.0], "intercept": 0.0}, "buckets": [{"class": 1, "rewards": [3], "costs": [4]}, {"class": 0, "rewards": [0, 1], "costs": [0, 2]}]}
    pre = classify.load(raw)
    assert pre.buckets[1].costs == [0, 4] and pre.buckets[0].costs == [0, 2] and pre.buckets[1].valid == [0, 1]
    df = spark.createDataFrame([([1000.0],), ([-1000.0],), ([0.0],)], "x array<double>")
    assert [r[0] for r in df.select(pre.classify(F.col("x"))).collect()] == [1, 0, 0]
    raw["buckets"][0]["class"] = 2
    with pytest.raises(CompileError, match="run from 0"):
        classify.load(raw)
    assert df.select(classify.classify("Static", {"class": 3}, F.col("x"))).first()[0] == 3
    tie = {"weights": [[1.0], [1.0], [-1.0]], "intercept": [0.0, 0.0, 0.0]}
    assert [r[0] for r in df.select(classify.classify("multi", tie, F.col("x"))).collect()] == [1, 2, 2]


# --- aggregates --------------------------------------------------------------------------------


def test_componentized(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 7), ("b", 1, 1)], "k string, t int, v int")
    out = aggregates.componentized(df, ["k"], ["t"], lambda r: r["v"], lambda keys: sum(keys) > 10, lambda r: r["t"], lambda keys, i: i < len(keys) - 2)
    assert rows(out) == sorted([("a", 1, 5, 0), ("a", 2, 6, 0), ("a", 1, 5, 1), ("a", 2, 6, 1), ("a", 3, 7, 1)], key=str)


def test_streaks_with_null_labels(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["x", None, None, None, "x", "x", "x", "x"])], "k int, t int, label string")
    assert [r["t"] for r in aggregates.streaks(df, "k", "label", ["t"], 3).orderBy("t").collect()] == [3, 6, 7]


def test_species_counts_keep_both_bounds(spark):
    df = spark.createDataFrame([("a", t, 1.0, e) for t, e in ((0, 0), (1000, 3), (4000, None), (9500, None))], "c string, t long, p double, e int")
    got = [(r["count"], r["expected_count"]) for r in aggregates.species_counts(df, "c", "t", "p", "e", 5000, 2).orderBy("time_ms").collect()]
    assert got == [(1.0, None), (2.0, 3), (2.0, 3), (1.0, None)]


def test_complete_by_count(spark):
    df = spark.createDataFrame([("a", 2), ("a", None), ("b", 3), ("c", None)], "k string, n int")
    assert rows(aggregates.complete_by_count(df, "k", "n")) == [("a", 2, 2), ("c", 1, 0)]


def test_custom_aggregate_and_errors(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert rows(aggregates.custom(df, ["k"], lambda f: f.assign(v=f["v"] * 2), "k string, v int")) == [("a", 2), ("a", 4)]
    for bad in (lambda: aggregates.final(df, ["k"], "median", "v"), lambda: aggregates.running(df, ["k"], "sum", "v", [])):
        with pytest.raises(CompileError):
            bad()


# --- relational --------------------------------------------------------------------------------


def test_flat_map_skips_failing_rows(spark):
    df = spark.createDataFrame([(1,), (0,), (2,)], "v int")
    out = relational.flat_map(df, lambda r: [{"w": 10 // r["v"]}] * 2, "w int")
    assert rows(out) == [(10,), (10,), (5,), (5,)]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        relational.flat_map(df, lambda r: [{"w": 10 // r["v"]}], "w int", on_error="raise").collect()


def test_chunks(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, 2, 3, 4)], "t long")
    assert [n for _, n in rows(relational.chunk_by_count(df, [], ["t"], 3).groupBy("chunk").count())] == [3, 2]
    with pytest.raises(CompileError):
        relational.chunk_by_time(df, [], "t", 3, 100)
    timed = spark.createDataFrame([(1, t) for t in (0, 10, 200, 205, 206, 500)], "k int, t long")
    assert [r["chunk"] for r in relational.chunk_by_time(timed, ["k"], "t", 3, 100).orderBy("t").collect()] == [0, 0, 1, 1, 1, 2]
    assert relational.chunk_by_time(timed.limit(0), ["k"], "t", 3, 100).count() == 0


def test_positions_and_repeats(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("v"))
    assert [r["position"] for r in relational.positions(df, ["v"]).orderBy("v").collect()] == list(range(1000))
    assert relational.repeat(df, 0).count() == 0 and relational.repeat(df, 2).count() == 2000
    assert relational.take(df, ["v"], 2, 3).collect()[0]["v"] == 3


def test_positions_are_gapless_beyond_the_sample_of_the_ranges(spark):
    df = spark.range(0, 60000, 1, 3).select("id", F.expr("timestamp_micros((id * 7919 % 60000) div 7 * 1000003)").alias("at"), F.expr("cast(if(id % 5 = 0, null, id % 5) as string)").alias("s"))
    for order in (["at", "id"], ["s", "at", "id"]):
        placed = relational.positions(df, order).orderBy(*order)
        assert placed.columns == ["id", "at", "s", "position"]
        assert [r["position"] for r in placed.select("position").collect()] == list(range(60000))
    assert relational.positions(df.limit(0), ["at"]).count() == 0


@pytest.mark.parametrize("strategy", sorted(signal.STRATEGIES))
def test_images_of_one_shape_have_the_features_of_each(strategy):
    images = np.random.default_rng(5).integers(0, 256, (30, 13, 17, 3)).astype(np.uint8)
    images[3], images[4] = 0, 255
    together = signal.features_of_images(images, strategy)
    assert all((f == signal.image_features(i, strategy)).all() for i, f in zip(images, together, strict=True))


def test_a_block_of_pairs_of_vectors_holds_few_distances_at_once(monkeypatch):
    import pyarrow as pa

    sizes, plain = [], vectors.distances
    monkeypatch.setattr(vectors, "distances", lambda q, x, metric: sizes.append(len(q) * len(x)) or plain(q, x, metric))
    monkeypatch.setattr(vectors, "TILE", 1000, raising=False)
    x = np.random.default_rng(2).normal(size=(300, 4))
    index = pa.table({"i": list(range(300)), "c": pa.nulls(300, pa.string()), "v": list(x)})
    found = vectors.block_search(3, "cosine", False, None, [pa.int64(), pa.string()], pa.list_(pa.float64()))(index, pa.table({"_q": list(x[:50])}))
    assert found.num_rows == 50 and max(sizes) <= 1000
    want = np.argsort(plain(x[:50], x, "cosine"), axis=1, kind="stable")[:, :3]
    assert [[n["id"] for n in near] for near in found.column("_n").to_pylist()] == want.tolist()


def test_pairs_of_a_key_are_dealt_to_blocks(spark):
    """Few rows of a key make many pairs: a block's rows are few, and pairs are those of the plain join."""
    a = spark.createDataFrame([(k, i) for k, n in ((1, 90), (None, 40), (2, 5), (3, 1)) for i in range(n)], "k int, a int")
    b = spark.createDataFrame([(k, i) for k, n in ((1, 30), (None, 20), (2, 2), (4, 9)) for i in range(n)], "k int, b int")
    plain, dealt = (joins.inner_build_right(a, b, ["k"], F.col("a") + F.col("b") != 7, block_pairs=n) for n in (None, 50))
    assert rows(plain) == rows(dealt) and plain.columns == dealt.columns
    made = dealt.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert made < 90 * 30 / 4


@pytest.mark.parametrize(("lefts", "rights"), [(400, 300), (1, 900), (900, 2)])
def test_right_rows_come_once_for_a_slice_of_the_left(spark, monkeypatch, lefts, rights):
    """No more blocks than partitions, whatever the pairs; in each, a right row meets a short round of left ones before the next does."""
    monkeypatch.setattr(joins, "MOST_PARTITIONS", 40)
    monkeypatch.setattr(joins, "ROUND_ROWS", 16, raising=False)
    monkeypatch.setattr(joins, "written", lambda df, name: spark.createDataFrame(df.collect(), df.schema))
    a = spark.range(lefts).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    b = spark.range(rights).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where both sides are large
    try:
        got = joins.inner_build_right(a, b, ["k"], block_pairs=50).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["a"], r["b"]) for r in got) == [(i, j) for i in range(lefts) for j in range(rights)]
    copies = sum(x["p"] != y["p"] or x["b"] != y["b"] for x, y in zip(got, got[1:], strict=False))
    assert copies <= max(45, -(-lefts // 16)) * rights


def test_range_join_matches_theta(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(i, rng.randrange(3), rng.randrange(-200, 200)) for i in range(80)], "i int, k int, t long")
    b = a.select(F.col("i").alias("j"), "k", F.col("t").alias("s"))
    want = a.alias("l").join(b.alias("r"), (F.col("l.k") == F.col("r.k")) & F.col("s").between(F.col("t") - 10, F.col("t") + 5))
    got = joins.range_join(a, b, ["k"], "t", "s", 10, 5)
    assert rows(got.select("i", "j")) == rows(want.select("i", "j"))


# --- vectors, models ---------------------------------------------------------------------------


def test_vector_blocks_agree(spark):
    rng = np.random.RandomState(0)
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 8)))], "id int, v array<double>")
    look = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((10, 8)))] + [(98, None), (99, [1.0])], "q int, embedding array<double>")
    one = vectors.nearest(look, index, 4, "id", "v", "embedding")
    many = vectors.nearest(look, index, 4, "id", "v", "embedding", block_rows=17)
    pick = lambda df: {r["q"]: None if r["_near"] is None else [n["id"] for n in r["_near"]] for r in df.collect()}
    assert pick(one) == pick(many) and pick(one)[98] is None and pick(one)[99] is None
    with pytest.raises(CompileError):
        vectors.vector_join(look, index, "left")
    empty = vectors.vector_join(look, index.limit(0), "inner", id_col="id", vector_col="v").collect()
    assert [r["match_ids"] for r in sorted(empty, key=lambda r: r["q"])] == [[]] * 10 + [None, []]
    told = vectors.vector_join(look, index.withColumn("passage", F.concat(F.lit("p"), "id")), "inner", 3, 3, id_col="id", vector_col="v", passage_col="passage").collect()
    assert all(r["passages"] == (None if r["match_ids"] is None else ["p" + m for m in r["match_ids"]]) for r in told) and len(told) == 12


def test_lookup_rejects_and_leaves_out_long_vectors(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [5.0, 5.0])], "id int, v array<double>")
    look = spark.createDataFrame([(1, [2.0, 0.1]), (2, [-1.0, 0.0])], "q int, e array<double>")
    got = {r["q"]: r["match_ids"] for r in vectors.top1_lookup(look, index, 0.95, "id", "v", "e").collect()}
    assert got == {1: ["1"], 2: []}


def test_inline_python_drops_or_keeps(spark):
    df = spark.createDataFrame([(1,), (0,)], "v int")
    f = lambda v: (10 // v, str(v))
    assert rows(models.inline_python(df, f, ["v"], "a int, b string")) == [(1, 10, "1")]
    assert rows(models.inline_python(df, f, ["v"], "a int, b string", "null")) == [(0, None, None), (1, 10, "1")]
    assert rows(models.inline_python(df, lambda v: (1, 2, 3), ["v"], "a int, b int")) == []


def test_script_function(tmp_path):
    (tmp_path / "double.py").write_text("def run(x):\n    return x * 2\n")
    assert models.script_function(str(tmp_path), "double", "run")(4) == 8


def test_onnx_failures_give_nulls(spark):
    model = models.linear_onnx(np.ones((2, 1)), np.zeros(1))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "i int, x array<float>")
    assert {r["i"]: r["y"] for r in models.onnx_inference(df, model, ["x"], ["y"]).collect()} == {1: [3.0], 2: None}
    wrong = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "i int, x array<float>")
    assert models.onnx_inference(wrong, model, ["x"], ["y"]).first()["y"] is None


def test_hash_embedding_is_unit(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(models.hash_embedding(F.col("t"), 32)).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1) and not any(got[1]) and got[2] is None


# --- functions ---------------------------------------------------------------------------------


def test_text_functions(spark):
    df = spark.createDataFrame([("Yes, sir. No!",), ("no",), (None,)], "t string")
    got = df.select(text.is_yes(F.col("t")), text.punctuation_count(F.col("t")), text.sentence_count(F.col("t")), text.byte_length(F.col("t"))).collect()
    assert tuple(got[0]) == (True, 3, 2, 13) and tuple(got[1]) == (False, 0, 1, 2) and got[2][0] is None
    d = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0],)], "d array<double>").select(text.first_and_mean_distance(F.col("d")).alias("s")).select("s.*").collect()
    assert tuple(d[0]) == (1.0, 3.0) and tuple(d[1]) == (5.0, float("inf"))
    m = spark.createDataFrame([({"expected_count_14": 2, "other": 1},)], "m map<string,int>")
    assert m.select(text.split_prefix(F.col("m"), "expected_count_")).first()[0] == {"14": 2}
    ids = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in ids.select(text.first_id(F.col("a"))).collect()] == ["a", None, None]


def test_suppression():
    b = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30]], float)
    assert boxes.suppress(b, np.array([0.8, 0.9, 0.5])) == [1, 2]
    assert boxes.suppress(b, np.array([0.8, 0.9, 0.5]), top_k=1) == [1]
    found, p = boxes.ssd_postprocess(np.array([[0.1, 0.9], [0.8, 0.2]]), np.array([[0, 0, 0.5, 0.5], [0, 0, 1, 1]]), 100, 50)
    assert found.tolist() == [[0, 0, 50, 25]] and p.tolist() == [0.9]


def test_yolo_postprocess_undoes_the_letterbox():
    out = np.zeros((1, 84, 3))
    out[0, :4, 0] = [320, 320, 64, 64]
    out[0, :4, 1] = [322, 320, 64, 64]
    out[0, 4 + 15, 0], out[0, 4 + 15, 1], out[0, 4 + 16, 2] = 0.9, 0.8, 0.1
    b, p, c = boxes.yolo_postprocess(out, 1280, 640)
    assert c.tolist() == [15] and p.tolist() == [0.9]
    assert b[0].tolist() == [576, 256, 704, 384]


def test_split_boxes(spark):
    df = spark.createDataFrame([(1, [[-5, 0, 20, 10], [1, 1, 1, 9]], 15, 8), (2, [], 15, 8), (3, None, 15, 8)], "i int, b array<array<int>>, w int, h int")
    got = {(r["i"], r["my_box_number"]): (r["my_bounding_box"], r["boxes_detected"], r["new_area_float"], r["new_hw_ratio_float"]) for r in boxes.split_boxes(df, "b", "w", "h").collect()}
    assert got == {(1, 0): ([0, 0, 15, 8], 2, 120.0, 8 / 15), (1, 1): ([1, 1, 1, 8], 2, 0.0, None), (2, None): (None, None, None, None), (3, None): (None, None, None, None)}


def test_softmax_split(spark):
    df = spark.createDataFrame([([0.0, 1000.0],)], "p array<double>")
    assert df.select(boxes.softmax_split(F.col("p"), 0.5)).first()[0] == [(1, 1.0)]


def test_fft_features(spark):
    wave = np.sin(np.arange(200) * 2 * np.pi * 5 / 200)
    f = signal.channel_features(wave)
    assert len(f) == 10 and f[5:].tolist() == sorted(f[5:].tolist())
    df = spark.createDataFrame([(np.stack([wave] * 12, 1).ravel().tolist(),), ([1.0] * 13,), (None,)], "s array<float>")
    got = [r[0] for r in df.select(signal.fft_features("s")).collect()]
    assert len(got[0]) == 120 and got[1] is None and got[2] is None
    assert np.allclose(got[0][:10], f, rtol=1e-4)


@pytest.mark.parametrize(("strategy", "n"), [("thirds", 59), ("baseline", 59), ("luma_only", 26), ("fft1024", 59), ("more_rows", 59)])
def test_image_features(strategy, n):
    image = np.tile((128 + 100 * np.sin(np.arange(64) * 2 * np.pi * 8 / 64)).astype(np.uint8)[None, :, None], (48, 1, 3))
    f = signal.image_features(image, strategy)
    assert len(f) == n and f[:4].tolist() == pytest.approx([64, 48, 3072, 64 / 48])
    peak = f[4 + 5]
    assert abs(peak * (1024 if strategy == "fft1024" else 512) - 8) <= 1
    with pytest.raises(CompileError):
        signal.image_features(image, "other")


def test_images(spark, tmp_path):
    image = np.random.RandomState(0).randint(0, 255, (20, 30, 3)).astype(np.uint8)
    assert (images.decode(images.encode_ppm(image)) == image).all()
    assert images.decode(b"P5\n# note\n2 1\n255\n\x01\x02").tolist() == [[[1, 1, 1], [2, 2, 2]]]
    assert images.resize(image, 30, 20, "box").tolist() == image.tolist()
    assert images.resize(np.full((4, 4, 3), 9, np.uint8), 2, 2, "box").tolist() == [[[9] * 3] * 2] * 2
    assert images.to_tensor(np.full((2, 2, 3), 127, np.uint8), "detector").tolist() == [[[0.0] * 2] * 2] * 3
    boxed = images.letterboxed(image, 64)
    assert boxed.shape == (64, 64, 3) and boxed[0, 0].tolist() == [114] * 3
    out = images.blur_regions(image, [[2, 2, 14, 14], [20, 2, 24, 18]], 3.0)
    assert (out[2:14, 2:14] != image[2:14, 2:14]).any() and (out[:, 20:] == image[:, 20:]).all()
    for method in ("gaussian", "box", "fast"):
        assert images.blur(np.full((8, 8, 3), 50, np.uint8), 2, method).tolist() == np.full((8, 8, 3), 50).tolist()
    (tmp_path / "a.ppm").write_bytes(images.encode_ppm(image))
    (tmp_path / "b.ppm").write_bytes(b"no image")
    for name in ("1.ppm", "11.ppm", "sub/1.ppm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(images.encode_ppm(image))
    index = spark.createDataFrame([(1, "1.ppm"), (11, "11.ppm"), (21, "./sub/1.ppm"), (3, "none.ppm")], "img_id int, img_path string")
    named = readers.images(spark, str(tmp_path), index, "*.ppm").select("img_id", "img_path").collect()
    assert sorted((r["img_id"], r["img_path"].rpartition(tmp_path.name)[2]) for r in named) == [(1, "/1.ppm"), (1, "/sub/1.ppm"), (11, "/11.ppm"), (21, "/sub/1.ppm")]
    got = {r["img_path"].rpartition(tmp_path.name + "/")[2]: r for r in readers.images(spark, str(tmp_path)).collect()}
    assert got["a.ppm"]["original_width"] == 30 and bytes(got["a.ppm"]["image"]["data"]) == image.tobytes() and got["b.ppm"]["shape"] is None


# --- sources -----------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"title":"b","question":"q2","answer":true,"passage":"p"}\n{"title":"a","question":"q1","answer":false,"passage":"p"}\n')
    assert [r["title"] for r in readers.json_lines(spark, str(tmp_path / "q.jsonl"), order=["title"], skip=1, take=1).collect()] == ["b"]
    with pytest.raises(CompileError):
        readers.json_lines(spark, str(tmp_path / "q.jsonl"), skip=1)
    (tmp_path / "p.csv").write_text("id,who,years,mins\n1,ann,40,2.5\n")
    assert rows(readers.patients(spark, str(tmp_path / "p.csv"))) == [(1, "ann", 40, 2.5)]
    assert readers.empty(spark, "a int").count() == 0 and readers.from_list(spark, [(1,)], "a int").count() == 1


def test_npy(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 2, dtype=np.float32).reshape(2, 3, 4, 2)
    np.save(tmp_path / "x.npy", data)
    np.save(tmp_path / "y.npy", np.arange(6).reshape(2, 3))
    out = readers.sequences(spark, str(tmp_path / "x.npy"), str(tmp_path / "y.npy"), 3).orderBy("patient_id", "label").collect()
    assert len(out) == 6 and out[4]["label"] == 4 and out[4]["sequence"] == data[1, 1].ravel().tolist() and out[4]["sequence_dims"] == [4, 2]
    assert len({r["sequence_id"] for r in out}) == 6


def test_npy_by_uri_in_parts(spark, tmp_path):
    data = np.arange(60, dtype=np.int16).reshape(10, 2, 3)
    np.save(tmp_path / "x.npy", data)
    got = readers.npy(spark, f"file://{tmp_path}/x.npy", 3).orderBy("position").collect()
    assert [(r["position"], r["values"], r["dims"]) for r in got] == [(i, data[i].ravel().astype(float).tolist(), [2, 3]) for i in range(10)]
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((4, 5))))
    with pytest.raises(Exception, match="rows of numbers"):
        readers.npy(spark, f"{tmp_path}/f.npy").collect()



def test_arrivals_and_replay(spark, tmp_path):
    df = spark.range(400).withColumnRenamed("id", "i")
    gaps = [readers.wave_interval(F.col("i"), 8, 20, 5, 3).alias("g")]
    got = readers.wave_arrivals(df, "i", 8, 20, 5, 3).select("arrival_us", *gaps).orderBy("i").collect()
    total = 0
    for r in got:
        assert r["arrival_us"] == total
        total += r["g"]
    assert {r["g"] for r in got} == {8, 13, 18, 20}
    assert readers.random_arrivals(df, "i", 100.0).agg(F.min("arrival_us")).first()[0] >= 0
    readers.capture(readers.fixed_arrivals(df, "i", 10, "relative_ns"), str(tmp_path / "cap"), ["i"], 5)
    again = readers.replay(spark, str(tmp_path / "cap"), "relative_ns", 1000, 2, -5).orderBy("cycle", "i").collect()
    assert [r["created_ns"] for r in again[:2]] == [1000, 1010] and again[5]["created_ns"] == 1000 + 41 - 5
    log = readers.event_log(readers.fixed_arrivals(df, "i", 10, "t"), "router", "i", "t", 0, ["i"]).first()
    assert log["location"] == "router" and log["aux"] == {"i": "0"}
    meta = spark.createDataFrame([(1, {"cat": 2})], "image_id int, c map<string,bigint>")
    assert readers.class_counts(meta, "image_id", "c", {"cat": 15, "dog": 16}).first()["expected_count_16"] == 0


def test_replay_takes_a_sequence_of_adjustments_around_all_cycles(spark, tmp_path):
    spark.createDataFrame([(i, i * 10) for i in range(5)], "id int, r long").repartition(3).write.parquet(f"{tmp_path}/captured")
    got = {(r["cycle"], r["id"]): r["created_ns"] for r in readers.replay(spark, f"{tmp_path}/captured", "r", 1000, 2, [3, -2, 0]).collect()}
    by = [3, -2, 0]
    assert got == {(c, i): 1000 + c * 41 + i * 10 + (by[(c * 5 + i) % 3] if c else max(by[i % 3], 0)) for c in range(2) for i in range(5)}
    with pytest.raises(CompileError):
        readers.replay(spark, f"{tmp_path}/captured", "r", adjust_ns=[])
