import pytest
from pyspark.sql import functions as F

from sluice import catalog
from sluice.errors import CompileError
from sluice.operators import aggregates, routing
from sluice.operators.history import Lookahead
from sluice.streaming import streams
from tests.conftest import TABLES


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Events in files in order of arrival, as a table and as a way to stream them."""
    path = str(tmp_path_factory.mktemp("feed") / "events")
    df = catalog.events(spark, TABLES).withColumn("ts", F.timestamp_micros("us"))
    low, high = df.agg(F.min("us"), F.max("us")).first()
    for k in range(3):  # the stream takes files in the order they were written
        step = (high - low) // 3 + 1
        df.filter(F.floor((F.col("us") - low) / step) == k).coalesce(1).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    return table, lambda: streams.files(spark, path, table.schema, 1)


def collect(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, df.sparkSession.table(name).collect()), key=str)


@pytest.fixture(autouse=True, scope="module")
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stateless_operators_are_the_same(feed):
    table, stream = feed
    pick = lambda df: routing.branch(routing.route(df, F.col("event_id") % 3), 1).select("event_id", "value")
    assert collect(pick(stream()), "stateless") == sorted(map(tuple, pick(table).collect()), key=str)


def test_windows(feed):
    table, stream = feed
    batch = streams.windowed(table, ["event_type"], "ts", "1 day", None, F.count("*").alias("n"))
    live = streams.windowed(streams.with_event_time(stream(), "ts", "1 hour"), ["event_type"], "ts", "1 day", None, F.count("*").alias("n"))
    got = collect(live, "windows", "complete")
    assert got == sorted(map(tuple, batch.collect()), key=str)


def test_interval_join(spark, feed):
    table, stream = feed
    right = lambda df: df.select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("other_ts"))
    left = lambda df: df.select("event_id", "user_id", "ts")
    batch = streams.interval_join(left(table), right(table), ["user_id"], "ts", "other_ts", "6 hours", "0 hours")
    a = streams.with_event_time(left(stream()), "ts", "1 hour")
    b = streams.with_event_time(right(stream()), "other_ts", "1 hour")
    assert collect(streams.interval_join(a, b, ["user_id"], "ts", "other_ts", "6 hours", "0 hours"), "joined") == sorted(map(tuple, batch.collect()), key=str)
    with pytest.raises(CompileError):
        streams.interval_join(a, b, ["user_id"], "ts", "other_ts", "", "")


def test_running_sum(feed):
    table, stream = feed
    batch = {(r["user_id"], r["us"]): r["v"] for r in table.select("user_id", "us", F.sum("value").over(catalog.Window.partitionBy("user_id").orderBy("us").rowsBetween(catalog.Window.unboundedPreceding, 0)).alias("v")).collect()}
    got = collect(streams.running(stream(), ["user_id"], "sum", "value", "us"), "running")
    assert len(got) == len(batch) and all(v == pytest.approx(batch[u, t]) for u, t, v in got)


def test_streaks(feed):
    table, stream = feed
    batch = aggregates.streaks(table, "user_id", "event_type", ["us"], 2).select("user_id", "event_type", "streak_length", "us")
    assert collect(streams.streaks(stream(), "user_id", "event_type", "us", 2), "streaks") == sorted(map(tuple, batch.collect()), key=str)


def test_budget_router_keeps_its_budget(feed):
    table, stream = feed
    df = stream().select((F.col("user_id") % 2).alias("router"), "us", "event_id", (F.col("value") > 250).cast("int").alias("class"))
    got = collect(streams.budget_route(df, "router", catalog.BUCKETS, "class", "us", "event_id", 0.5), "routed")
    n = table.count()
    assert len(got) == n and {r[3] for r in got} <= {0, 1, 2}
    assert 0.4 * n <= sum(r[3] for r in got) <= 0.5 * n


def test_budget_router_looks_ahead_and_drops_unknown_classes(feed):
    """Money kept back for forecast items is not spent on known ones; null classes take no part."""
    table, stream = feed
    classes = F.when(F.col("event_id") % 10 != 0, (F.col("value") > 250).cast("int"))
    df = stream().select((F.col("user_id") % 2).alias("router"), "us", "event_id", classes.alias("class"))
    got = collect(streams.budget_route(df, "router", catalog.BUCKETS, "class", "us", "event_id", 0.5, Lookahead(100_000)), "looking")
    assert len(got) == table.count() and all(r[3] == 0 for r in got if r[2] is None)
    known = sum(r[2] is not None for r in got)
    assert 0 < sum(r[3] for r in got) <= 0.5 * known
    with pytest.raises(CompileError):
        streams.budget_route(df, "router", catalog.BUCKETS, "class", "us", "event_id", 0.5, Lookahead(None, 5.0))


def test_sinks_and_late_rows(spark, feed, tmp_path):
    _, stream = feed
    seen = []

    def write(batch, epoch):
        on_time, late = streams.split_late(batch, "ts", "5 days")
        seen.append((epoch, on_time.count(), late.count()))

    streams.to_sinks(stream(), str(tmp_path / "checkpoint"), write).awaitTermination()
    assert len(seen) == 3 and sum(a + b for _, a, b in seen) == feed[0].count() and sum(b for *_, b in seen) > 0
    once = collect(streams.dedup_feedback(streams.with_event_time(stream(), "ts", "40 days"), "user_id", "event_type").select("user_id", "event_type"), "once")
    assert once == sorted(map(tuple, feed[0].select("user_id", "event_type").distinct().collect()), key=str)


def test_an_event_log_of_streams(spark, feed, tmp_path):
    import time

    table, stream = feed
    log = streams.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        streams.to_sinks(stream(), str(tmp_path / "checkpoint"), lambda batch, epoch: batch.count()).awaitTermination()
        bad = streams.to_sinks(stream(), str(tmp_path / "bad"), lambda batch, epoch: batch.select(F.raise_error(F.lit("broken"))).collect())
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination()
        end = time.time() + 40
        while time.time() < end and (not (tmp_path / "log").exists() or log.rows().filter("event = 'ended'").count() < 2):
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    rows = log.rows().collect()
    first = [r for r in rows if r["event"] == "progress"]
    assert sum(r["input_rows"] for r in first) == table.count() and sorted(r["batch"] for r in first) == [0, 1, 2]
    assert sorted(r["error"] is None for r in rows if r["event"] == "ended") == [False, True]
