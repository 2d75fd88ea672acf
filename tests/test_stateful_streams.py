import time

import pytest
from pyspark.sql import functions as F

from sluice import catalog
from sluice.errors import CompileError
from sluice.operators import aggregates
from sluice.streaming import stateful, streams
from tests.conftest import TABLES


@pytest.fixture(autouse=True, scope="module")
def store(spark):
    stateful.state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A folder that files come to one by one, and a stream of it."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).write.mode("append").parquet(self.path)

    def add(self, rows):
        df = rows if hasattr(rows, "columns") else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return streams.files(self.spark, self.path, self.schema, 1)


def start(df, name, checkpoint=None):
    writer = df.writeStream.format("memory").queryName(name).outputMode("append")
    return writer.option("checkpointLocation", str(checkpoint)).start() if checkpoint else writer.start()


def rows_of(spark, name):
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def until(spark, name, n, seconds=60):
    end = time.time() + seconds
    while time.time() < end and spark.table(name).count() < n:
        time.sleep(0.3)
    return rows_of(spark, name)


def chunk_sizes(rows):
    sizes = {}
    for r in rows:
        sizes[r[-1]] = sizes.get(r[-1], 0) + 1
    return [sizes[k] for k in sorted(sizes)]


@pytest.mark.parametrize(
    ("arriving", "size", "timeout", "sizes"),
    [([5], 3, 1500, [3, 2]), ([3], 10, 100, [3]), ([2], 2, 50, [2]), ([1, 2, 4], 3, 60_000, [3, 3])],
    ids=["a full chunk, and the rest by timeout", "a pause", "full before the timeout", "over micro-batches"],
)
def test_chunks(spark, tmp_path, arriving, size, timeout, sizes):
    feed, n = Feed(spark, tmp_path / "in", "k string, a int, note string"), 0
    for count in arriving:
        feed.add([("x", n + i, None) for i in range(count)])
        n += count
    name = f"chunks_{abs(hash(tmp_path)) % 10**9}"
    query = start(stateful.chunks(feed.stream(), ["k"], ["a"], size, timeout), name)
    try:
        got = until(spark, name, sum(sizes))
        assert chunk_sizes(got) == sizes
        assert [r[1] for r in sorted(got, key=lambda r: r[1])] == list(range(sum(sizes)))
    finally:
        query.stop()


def test_chunks_of_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k string, a int")
    query = start(stateful.chunks(feed.stream(), ["k"], ["a"], 3, 10), "chunks_none")
    try:
        time.sleep(3)
        assert rows_of(spark, "chunks_none") == []
    finally:
        query.stop()
    with pytest.raises(CompileError):
        stateful.chunks(feed.stream(), [], ["a"], 3, 10)


def in_parts(feed, df, order, parts=3):
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // parts + 1
    for k in range(parts):
        feed.add(df.filter(F.floor((F.col(order) - low) / step) == k))


def test_a_join_with_an_eviction_is_the_join_of_tables(spark, tmp_path):
    """Over micro-batches in order of time, rows leave when the other side is half an hour further."""
    df = catalog.events(spark, TABLES).select("event_id", "user_id", "event_type", "us", "value")
    feeds = [Feed(spark, tmp_path / side, df.schema) for side in ("a", "b")]
    for feed in feeds:
        in_parts(feed, df, "us", 4)
    a = feeds[0].stream().filter("event_type = 'error'").select("event_id", "user_id", "us")
    b = feeds[1].stream().filter("event_type = 'click'").select(F.col("event_id").alias("other_id"), "user_id", "us")
    day = 86_400_000_000
    seen = lambda left, right: max([*left["us"], *right["us"]], default=0)

    def evict(left, right):
        # What is stored meets rows that come later than any of it, so what is older than the bound meets none.
        now = seen(left, right)
        return left["us"] >= now - 40 * day, right["us"] >= now - 40 * day

    joined = stateful.double_stream(a, b, ["user_id"], "us", lambda x, y: (x["us"] - y["us"]).abs() <= day, evict)
    query = start(joined.select("event_id", "other_id"), "evicted")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    e = df.select(F.col("event_id"), "user_id", "us").filter("event_type = 'error'")
    c = df.filter("event_type = 'click'").select(F.col("event_id").alias("other_id"), F.col("user_id").alias("u"), F.col("us").alias("t"))
    want = e.join(c, (F.col("user_id") == F.col("u")) & (F.abs(F.col("us") - F.col("t")) <= day)).select("event_id", "other_id")
    assert rows_of(spark, "evicted") == sorted(map(tuple, want.collect()), key=repr) != []


def test_evicted_rows_are_gone_from_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "side int, k int, t long")
    for batch in range(5):
        feed.add([(s, 1, batch * 1000 + i) for s in (0, 1) for i in range(20)])
    sides = [feed.stream().filter(f"side = {s}").select("k", F.col("t").alias("t"), F.col("t").alias(f"t{s}")) for s in (0, 1)]
    keep = lambda left, right: (left["t"] >= left["t"].max() - 5, right["t"] >= right["t"].max() - 5)
    counted = stateful.double_stream(sides[0], sides[1], ["k"], "t", lambda x, y: x["t0"] == x["t0"], keep)
    query = start(counted.select("t0", "t1"), "bounded")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    # 20 new rows of each side meet each other, and the six of the last batch that stayed.
    assert len(rows_of(spark, "bounded")) == 20 * 20 + 4 * (20 * 20 + 2 * 6 * 20)
    with pytest.raises(CompileError):
        stateful.double_stream(sides[0], sides[1], ["absent"], "t", None, None)


def test_completion_by_count(spark, tmp_path):
    lines = spark.read.parquet(f"{TABLES}/lineitem.parquet").filter("l_orderkey <= 400").dropDuplicates(["l_orderkey", "l_linenumber"])
    most = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("expected"))
    df = lines.join(most, "l_orderkey").select("l_orderkey", "expected", F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").cast("long").alias("nth"))
    feed = Feed(spark, tmp_path / "in", df.schema)
    in_parts(feed, df, "nth")
    query = start(stateful.complete_by_count(feed.stream(), "l_orderkey", "expected", "q"), "complete")
    try:
        query.processAllAvailable()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    batch = aggregates.complete_by_count(df, "l_orderkey", "expected", F.sum("q").alias("total"))
    assert rows_of(spark, "complete") == sorted(map(tuple, batch.collect()), key=repr)
    unfinished = df.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("expected").alias("m")).filter("n < m").count()
    assert held <= 3 * unfinished


def test_groups_that_never_complete_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k int, expected long, v double")
    feed.add([(1, 5, 1.0), (2, 1, 2.0), (3, None, 3.0)])
    query = start(stateful.complete_by_count(feed.stream(), "k", "expected", "v", 500), "dropped")
    held = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    try:
        until(spark, "dropped", 2)
        end = time.time() + 30
        while time.time() < end and (not held() or held()[-1]):
            time.sleep(0.3)
        assert held()[-1] == 0
    finally:
        query.stop()
    assert rows_of(spark, "dropped") == [(2, 1, 1, 2.0), (3, 1, 0, 3.0)]


def drained(df, path):
    df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def test_calls_of_the_processor_do_not_grow_with_the_groups(spark, tmp_path):
    """Of 3,000 groups some complete within a micro-batch, some over two, some never; a call and a state are a bucket's."""
    feed = Feed(spark, tmp_path / "in", "k long, expected long, v double")
    for batch in range(2):
        feed.add(spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 + 1).alias("expected"), (F.col("id") + batch).cast("double").alias("v")))
    query = start(stateful.complete_by_count(feed.stream(), "k", "expected", "v"), "bucketed")
    try:
        query.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    want = [(k, 1, 1, float(k + b)) for k in range(0, 3000, 3) for b in (0, 1)] + [(k, 2, 2, 2.0 * k + 1) for k in range(1, 3000, 3)]
    assert rows_of(spark, "bucketed") == sorted(want, key=repr)
    # 2,000 groups wait after the first micro-batch, 1,000 after the second.
    assert 0 < max(held) <= 1024


@pytest.mark.parametrize(
    ("kind", "keys"),
    [("bigint", ["9007199254740993", "9007199254740992", "NULL", "0"]), ("string", ["'a'", "''", "NULL"]), ("double", ["0.0D", "1.5D", "NULL"]), ("date", ["date'9999-12-31'", "NULL"])]
    + [("decimal(30,6)", ["12345678901234567890.123456BD", "NULL"]), ("timestamp", ["timestamp'1969-01-01 00:00:00.000001'", "NULL"])],
    ids=["bigint", "string", "double", "date", "decimal", "timestamp"],
)
def test_keys_stay_what_they_are_beside_nulls(spark, tmp_path, kind, keys):
    """Large whole numbers beside a null key pass through no double, and keys of a bucket are told apart."""
    feed = Feed(spark, tmp_path / "in", f"k {kind}, e long, v double")
    rows = spark.sql(" UNION ALL ".join(f"SELECT CAST({k} AS {kind}) AS k, 3L AS e, {i + 1}.5D AS v" for i, k in enumerate(keys)))
    for _ in range(3):
        feed.add(rows)
    got = drained(stateful.complete_by_count(feed.stream(), "k", "e", "v", buckets=2), tmp_path / "out")
    want = rows.select("k", F.lit(3).cast("long"), F.lit(3).cast("long"), F.col("v") * 3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_zero_of_either_sign_is_one_group_and_nested_keys_are_none(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k double, e long, v double")
    feed.add([(0.0, 2, 1.0), (-0.0, 2, 2.0)])
    assert list(map(tuple, drained(stateful.complete_by_count(feed.stream(), "k", "e", "v"), tmp_path / "out").collect())) == [(0.0, 2, 2, 3.0)]
    with pytest.raises(CompileError):
        stateful.complete_by_count(feed.stream().withColumn("k", F.array("k")), "k", "e", "v")


@pytest.mark.parametrize("include", [True, False])
def test_outcomes_of_a_stream_are_those_of_the_tables(spark, tmp_path, include):
    """Stale items become pipeline 0 with the limit as elapsed time, or are left out; feedback after the limit meets none."""
    df = catalog.events(spark, TABLES).select("event_id", "user_id", F.timestamp_micros("us").alias("created"), F.timestamp_micros(F.col("us") + 1000).alias("sent"), "us", "value")
    late = F.when(F.col("event_id") % 4 == 0, 7200).otherwise(30)
    back = df.filter("event_id % 3 <> 0").select("event_id", (F.col("event_id") % 2 + 1).cast("int").alias("pipeline"), F.timestamp_micros(F.col("us") + late.cast("long") * 1_000_000).alias("done"), "us")
    feeds = [Feed(spark, tmp_path / n, d.schema) for n, d in (("routed", df), ("back", back))]
    in_parts(feeds[0], df, "us")
    in_parts(feeds[1], back, "us")
    # A last row of each side far ahead moves the watermark past all others.
    feeds[0].add(df.limit(1).select(F.lit(-1).cast("long").alias("event_id"), "user_id", *[(F.col(c) + F.expr("interval 900 days")).alias(c) for c in ("created", "sent")], "us", "value"))
    feeds[1].add(back.limit(1).select(F.lit(-2).cast("long").alias("event_id"), "pipeline", (F.col("done") + F.expr("interval 900 days")).alias("done"), "us"))
    routed = feeds[0].stream().withWatermark("created", "1 hour").drop("us", "value")
    feedback = feeds[1].stream().withWatermark("done", "1 hour").drop("us")
    query = start(stateful.outcomes(routed, feedback, "event_id", "created", "sent", "done", "1 hour", include), f"outcomes_{include}", tmp_path / "checkpoint")
    try:
        query.processAllAvailable()
        time.sleep(1)
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table(f"outcomes_{include}").filter("event_id >= 0").select("event_id", "pipeline", "elapsed_ms")
    in_time = "event_id % 3 <> 0 AND event_id % 4 <> 0"
    want = df.select("event_id", F.expr(f"CASE WHEN {in_time} THEN CAST(event_id % 2 + 1 AS INT) ELSE 0 END").alias("pipeline"), F.expr(f"CASE WHEN {in_time} THEN 29999D ELSE 3600000D END").alias("elapsed_ms"))
    want = want if include else want.filter(in_time)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_restart_repeats_and_loses_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k int, expected long, v double")
    feed.add([(k, 2, 1.0) for k in range(20)])
    made = lambda: stateful.complete_by_count(feed.stream(), "k", "expected", "v")

    def run():
        out = made().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        out.awaitTermination()

    run()
    feed.add([(k, 2, 5.0) for k in range(20)])
    run()
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(k, 2, 2, 6.0) for k in range(20)]


def test_a_feed_is_written_by_many_tasks_in_order(spark, monkeypatch, tmp_path):
    """No task takes a whole part, and a micro-batch has the next part's files."""
    monkeypatch.setattr(catalog, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(catalog, "FEED_FILE_ROWS", 50, raising=False)
    monkeypatch.setattr(catalog, "FEED_BATCH_ROWS", 400, raising=False)
    fed = catalog._feed(spark.range(2000).withColumn("v", F.col("id") * 2).repartition(3), "id")
    (path,) = tmp_path.glob("feed-*")
    counts = [r["count"] for r in spark.read.parquet(str(path)).groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == 2000 and max(counts) < 200
    seen = []
    query = fed.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r["id"] for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [len(s) for s in seen] == [400] * 5 and sum(seen, []) == list(range(2000))


def test_outcomes_are_whole_when_parts_have_many_files(spark, monkeypatch):
    """Files that differ in number between the two feeds, and more micro-batches."""
    import duckdb

    monkeypatch.setattr(catalog, "FEED_FILE_ROWS", 60)
    monkeypatch.setattr(catalog, "FEED_BATCH_ROWS", 400)
    df = catalog.QUERIES["stream_outcomes"](spark, TABLES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{TABLES}/events.parquet'")
    listed = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {listed} FROM ({catalog.SQL['stream_outcomes']})").fetchall())


@pytest.mark.parametrize("name", ["stream_outcomes", "stream_complete_by_count"])
def test_a_drained_stream_keeps_one_store_for_a_partition(spark, monkeypatch, tmp_path, name):
    """Micro-batches leave their changes, not whole stores; the session's own settings stay as they were."""
    monkeypatch.setattr(catalog, "shared_dir", lambda _: str(tmp_path))
    before = {n: spark.conf.get(n, None) for n in stateful.LEAN_STORE}
    catalog.QUERIES[name](spark, TABLES)
    assert {n: spark.conf.get(n, None) for n in stateful.LEAN_STORE} == before
    (partition,) = tmp_path.glob("drained-*/checkpoint/state/0/0")
    assert list(partition.glob("**/*.changelog"))
    assert not [p.name for p in partition.iterdir() if p.is_dir() and "keyTo" in p.name or "keyWith" in p.name]


def test_a_part_of_a_feed_reads_its_own_rows_only(spark, monkeypatch, tmp_path):
    """Parts grow with the rows, so none may read them all again."""
    monkeypatch.setattr(catalog, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(catalog, "FEED_BATCH_ROWS", 100)
    catalog._feed(spark.range(1000).withColumn("v", F.col("id") * 2), "id")
    (filed,) = tmp_path.glob("filed-*")
    counts = {p.name: spark.read.parquet(str(p)).count() for p in filed.glob("_part=*")}
    assert counts == {f"_part={k}": 100 for k in range(10)}
