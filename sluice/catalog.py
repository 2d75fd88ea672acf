"""The engine's queries, each with the SQL that says the same.

Events stand for streams: users for patients or routers, event types for labels or classes, values for
probabilities or costs.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import boxes, signal, text
from sluice.functions.expressions import Rules, compile_expression, returning, rounded
from sluice.operators import aggregates, assign, budget, classify, history, joins, models, relational, routing, scheduler, vector_index, vectors
from sluice.plans.compiler import Compiler, Settings
from sluice.plans.registry import Registry
from sluice.sources import readers
from sluice.streaming import stateful, streams
from sluice.tables import shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time in micro- and milliseconds, whatever the session's time zone."""
    us = F.unix_micros(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))
    return table(spark, sf, "events").withColumn("us", us).withColumn("ms", F.expr("us div 1000")).drop("ts", "props")


E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms FROM events)"
ARRIVAL = ["us", "event_id"]


def r6(c: Column) -> Column:
    return rounded(c, 6)


def field(name: str) -> dict:
    return {"kind": "field", "name": name}


def lit(kind: str, value) -> dict:
    return {"kind": "literal", "type": kind, "value": value}


def binary(op: str, left: dict, right: dict) -> dict:
    return {"kind": "binary", "op": op, "left": left, "right": right}


def run(spark: SparkSession, operators: list[dict], sources: dict[str, Callable], order: list[str] | None = None, registry: Registry | None = None, **settings) -> DataFrame:
    """A descriptor given as its operators, compiled."""
    registry = registry or Registry()
    for name, source in sources.items():
        registry.add("source", name, source)
    described = {"name": "", "description": "", "sql_form": "", "operators": [{"id": i, **o} for i, o in enumerate(operators)]}
    return Compiler(spark, registry, Settings(order=order or [], **settings)).run(described)


# --- projection, selection, expressions --------------------------------------------------------


@query("SELECT p_partkey, p_size, p_size + CAST(p_partkey AS BIGINT) * 5 AS derived FROM part WHERE p_size = 4")
def filter_derive_project(spark, sf):
    operators = [
        {"kind": "udf_source", "name": "part"},
        {"kind": "filter", "source": 0, "predicate": binary("=", field("p_size"), lit("int", 4))},
        {"kind": "derive", "source": 1, "new_field_name": "derived", "expression": binary("+", field("p_size"), binary("*", field("p_partkey"), lit("int", 5)))},
        {"kind": "project", "source": 2, "fields": ["p_partkey", "p_size", "derived", "absent"]},
    ]
    return run(spark, operators, {"part": lambda s: table(s, sf, "part")})


def _expressions(df: DataFrame, keep: list[str], made: dict[str, dict], rules: Rules = Rules()) -> DataFrame:
    typed = {k: compile_expression(d, df.schema, None, rules) for k, d in made.items()}
    return df.select(*keep, *[(r6(t.column) if t.family == "float" else t.column).alias(k) for k, t in typed.items()])


@query("SELECT p_partkey, CAST((p_size - 20) // 7 + CASE WHEN (p_size - 20) % 7 <> 0 AND p_size < 20 THEN CASE WHEN (p_size - 20) // 7 = trunc((p_size - 20) / 7.0) THEN 0 ELSE 1 END ELSE 0 END AS INTEGER) AS quotient, CAST((p_size - 20) % 7 AS INTEGER) AS remainder FROM part")
def expr_int_div_mod(spark, sf):
    less = binary("-", field("p_size"), lit("int", 20))
    return _expressions(table(spark, sf, "part"), ["p_partkey"], {"quotient": binary("/", less, lit("int", 7)), "remainder": binary("%", less, lit("int", 7))})


@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value - 250 <> 0 THEN round(1000.0 / (value - 250), 6) ELSE CAST('inf' AS DOUBLE) END AS quotient, round(value % 7.5, 6) AS remainder FROM events")
def expr_float_div(spark, sf):
    less = binary("-", field("value"), lit("float", 250))
    return _expressions(table(spark, sf, "events"), ["event_id"], {"quotient": binary("/", lit("float", 1000), less), "remainder": binary("%", field("value"), lit("float", 7.5))})


@query("SELECT event_id, value > 100 AND event_type = 'click' AS both, value > 100 OR event_type = 'click' AS either, (value > 100) <> (event_type = 'click') AS one, NOT (value <= 100) AS negated FROM events")
def expr_bool_ops(spark, sf):
    a, b = binary(">", field("value"), lit("float", 100)), binary("=", field("event_type"), lit("string", "click"))
    negated = {"kind": "unary", "op": "!", "expr": binary("<=", field("value"), lit("float", 100))}
    return _expressions(table(spark, sf, "events"), ["event_id"], {"both": binary("&", a, b), "either": binary("|", a, b), "one": binary("^", a, b), "negated": negated})


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN round(-value, 6) ELSE round(value * 2.0, 6) END AS chosen, -event_id AS minus FROM events")
def expr_ternary(spark, sf):
    even = binary("=", binary("%", field("user_id"), lit("int", 2)), lit("int", 0))
    chosen = {"kind": "ternary", "cond": even, "left": {"kind": "unary", "op": "-", "expr": field("value")}, "right": binary("*", field("value"), lit("float", 2))}
    return _expressions(table(spark, sf, "events"), ["event_id"], {"chosen": chosen, "minus": {"kind": "unary", "op": "-", "expr": field("event_id")}})


@query("SELECT event_id, value < 10 OR value > 480 AS extreme, event_id >= 100 AS late, event_id <= 5 AS first, event_id <> 7 AS other FROM events")
def expr_comparisons(spark, sf):
    made = {"extreme": binary("|", binary("<", field("value"), lit("float", 10)), binary(">", field("value"), lit("float", 480))), "late": binary(">=", field("event_id"), lit("int", 100)), "first": binary("<=", field("event_id"), lit("int", 5)), "other": binary("!=", field("event_id"), lit("int", 7))}
    return _expressions(table(spark, sf, "events"), ["event_id"], made)


@query("SELECT event_id, round(1 / (1 + exp(-(value - 250) / 100)), 6) AS p FROM events")
def expr_udf(spark, sf):
    registry = Registry()
    registry.add("expression", "scaled", returning("double")(lambda v: text.logistic((v - 250) / 100)))
    registry.add("expression", "round6", returning("double")(r6))
    call = {"kind": "udf", "name": "round6", "args": [{"kind": "udf", "name": "scaled", "args": [field("value")]}]}
    operators = [{"kind": "udf_source", "name": "events"}, {"kind": "derive", "source": 0, "new_field_name": "p", "expression": call}, {"kind": "project", "source": 1, "fields": ["event_id", "p"]}]
    return run(spark, operators, {"events": lambda s: table(s, sf, "events")}, registry=registry)


@query("SELECT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> ''")
def flat_map_words(spark, sf):
    df = table(spark, sf, "documents")
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return relational.flat_map(df, words, keep=["doc_id", "lang"], name="word")


# --- joins -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o.k AS k, c_name FROM (SELECT *, o_custkey AS k FROM orders) o JOIN (SELECT c_custkey AS k, c_name FROM customer) c ON o.k IS NOT DISTINCT FROM c.k")
def join_inner_build_right(spark, sf):
    operators = [
        {"kind": "udf_source", "name": "orders"},
        {"kind": "udf_source", "name": "customers"},
        {"kind": "join", "left": 0, "right": 1, "predicate": lit("bool", True), "join_info": {"kind": "inner_build_right", "fields": ["k"]}},
        {"kind": "project", "source": 2, "fields": ["o_orderkey", "o_totalprice", "k", "c_name"]},
    ]
    return run(spark, operators, {"orders": lambda s: table(s, sf, "orders").withColumnRenamed("o_custkey", "k"), "customers": lambda s: table(s, sf, "customer").withColumnRenamed("c_custkey", "k")})


@query("SELECT c.k AS k, c_name, o_orderkey, o_totalprice FROM (SELECT c_custkey AS k, c_name FROM customer) c LEFT JOIN (SELECT o_custkey AS k, o_orderkey, o_totalprice FROM orders) o ON c.k IS NOT DISTINCT FROM o.k AND o_totalprice > 300000")
def join_outer_build_right(spark, sf):
    operators = [
        {"kind": "udf_source", "name": "customers"},
        {"kind": "udf_source", "name": "orders"},
        {"kind": "join", "left": 0, "right": 1, "predicate": binary(">", field("o_totalprice"), lit("float", 300000)), "join_info": {"kind": "outer_build_right", "fields": ["k"]}},
        {"kind": "project", "source": 2, "fields": ["k", "c_name", "o_orderkey", "o_totalprice"]},
    ]
    return run(spark, operators, {"customers": lambda s: table(s, sf, "customer").withColumnRenamed("c_custkey", "k"), "orders": lambda s: table(s, sf, "orders").withColumnRenamed("o_custkey", "k")})


@query("SELECT a.k AS k, c_custkey, s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(spark, sf):
    key = lambda c: F.when(F.col(c) != 3, F.col(c)).alias("k")
    a = table(spark, sf, "customer").select("c_custkey", key("c_nationkey"))
    return joins.inner_build_right(a, table(spark, sf, "supplier").select("s_suppkey", key("s_nationkey")), ["k"], block_pairs=joins.BLOCK_PAIRS).select("k", "c_custkey", "s_suppkey")


@query("SELECT l.k AS k, l.price AS price, l_quantity, p_name FROM (SELECT l_partkey AS k, l_extendedprice AS price, l_quantity FROM lineitem) l JOIN (SELECT p_partkey AS k, p_name FROM part) p ON l.k = p.k")
def join_collision_probe_wins(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("price"), "l_quantity")
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), "p_name")
    return joins.inner_build_right(a, b, ["k"])


@query(E + " SELECT a.event_id AS event_id, b.event_id AS other_id, a.user_id AS user_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.us BETWEEN a.us - 3600000000 AND a.us AND a.event_id <> b.event_id")
def join_theta_double_stream(spark, sf):
    a = events(spark, sf).select("event_id", "user_id", "us")
    b = a.select(F.col("event_id").alias("other_id"), "user_id", F.col("us").alias("other_us"))
    found = joins.range_join(a, b, ["user_id"], "us", "other_us", 3_600_000_000, 0)
    return found.filter("event_id <> other_id").select("event_id", "other_id", "user_id")


@query("SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_retailprice > 1800 AND s_acctbal > p_retailprice * 5 AND p_size = s_nationkey")
def join_double_stream_predicate(spark, sf):
    a, b = table(spark, sf, "part").filter("p_retailprice > 1800"), table(spark, sf, "supplier")
    return joins.double_stream(a, b, lambda l, r: (F.col("s_acctbal") > F.col("p_retailprice") * 5) & (F.col("p_size") == F.col("s_nationkey"))).select("p_partkey", "s_suppkey")


# --- aggregates --------------------------------------------------------------------------------

for _op, _sql in (("sum", "round(sum(value) OVER w, 6)"), ("count", "count(value) OVER w"), ("min", "min(value) OVER w"), ("max", "max(value) OVER w"), ("avg", "round(avg(value) OVER w, 9)")):

    def _running(spark, sf, op=_op):
        df = events(spark, sf)
        operators = [{"kind": "udf_source", "name": "e"}, {"kind": "group_by", "source": 0, "fields": ["user_id"], "aggregate": {"kind": "builtin", "op": op, "field": "value"}}]
        out = run(spark, operators, {"e": lambda s: df}, order=ARRIVAL)
        value = F.col(f"{op}(value)")
        return out.select("user_id", (r6(value) if op == "sum" else rounded(value, 9) if op == "avg" else value).alias("value"))

    query(f"{E} SELECT user_id, {_sql} AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)", f"group_{_op}_running")(_running)

    def _final(spark, sf, op=_op):
        out = aggregates.final(table(spark, sf, "events"), ["event_type"], op, "value")
        value = F.col(f"{op}(value)")
        return out.select("event_type", (r6(value) if op in ("sum", "avg") else value).alias("value"))

    _fin = f"{_op}(value)" if _op in ("count", "min", "max") else f"round({_op}(value), 6)"
    query(f"SELECT event_type, {_fin} AS value FROM events GROUP BY event_type", f"group_{_op}_final")(_final)


@query(E + ", w AS (SELECT event_id, user_id, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 4 PRECEDING) AS n FROM e) SELECT event_id, user_id, n FROM w WHERE n >= 3")
def agg_componentized_emit_when(spark, sf):
    errors = lambda keys: F.size(F.filter(keys, lambda k: k == "error"))
    held = aggregates.emit_when(events(spark, sf).select("event_id", "user_id", "event_type", "us"), ["user_id"], ARRIVAL, 5, lambda keys: errors(keys) >= 3, "event_type")
    return held.select("event_id", "user_id", errors(F.transform("window", lambda r: r["event_type"])).cast("long").alias("n"))


@query(E + ", l AS (SELECT event_id, user_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) SELECT event_id, user_id, event_type, 3 AS streak_length FROM l WHERE event_type = a AND event_type = b")
def agg_streak3(spark, sf):
    return aggregates.streaks(events(spark, sf), "user_id", "event_type", ARRIVAL, 3).drop("us")


@query(E + ", l AS (SELECT event_id, user_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b, lag(event_type, 3) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) SELECT event_id, user_id, event_type, 4 AS streak_length FROM l WHERE event_type = a AND event_type = b AND event_type = c")
def agg_streak_n(spark, sf):
    return aggregates.streaks(events(spark, sf), "user_id", "event_type", ARRIVAL, 4).drop("us")


@query(E + " SELECT event_id, event_type AS class_id, ms AS time_ms, round(sum(value / 500) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 5000000 PRECEDING AND CURRENT ROW), 6) AS count FROM e")
def agg_species_count_prob(spark, sf):
    df = events(spark, sf).withColumn("p", F.col("value") / 500)
    return aggregates.species_counts(df, "event_type", "ms", "p", None, 5_000_000, None, ["event_id"]).drop("expected_count").withColumn("count", r6(F.col("count")))


@query(E + " SELECT event_id, event_type AS class_id, ms AS time_ms, CAST(count(*) OVER w AS DOUBLE) AS count, CAST(nullif(greatest(max(user_id) OVER w, 0), 0) AS INTEGER) AS expected_count FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 5000000 PRECEDING AND CURRENT ROW)")
def agg_species_count_simple(spark, sf):
    df = events(spark, sf).withColumn("expected", F.col("user_id").cast("int"))
    return aggregates.species_counts(df, "event_type", "ms", None, "expected", 5_000_000, None, ["event_id"])


@query(E + " SELECT event_id, event_type AS class_id, ms AS time_ms, CAST(least(20, count(*) OVER (PARTITION BY event_type ORDER BY ms, event_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS DOUBLE) AS count FROM e")
def agg_species_count_capped(spark, sf):
    return aggregates.species_counts(events(spark, sf), "event_type", "ms", None, None, 1 << 50, 20, ["event_id"]).drop("expected_count")


@query("SELECT l_orderkey, count(*) AS n_rows, max(l_linenumber) AS n_expected, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_orderkey HAVING count(*) >= max(l_linenumber)")
def agg_complete_by_count(spark, sf):
    return aggregates.complete_by_count(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", r6(F.sum("l_quantity")).alias("quantity"))


@query("SELECT k[1] AS user_id, k[2] AS bucket, n FROM (SELECT [user_id, CAST(floor(value / 100) AS BIGINT)] AS k, count(*) AS n FROM events GROUP BY 1)")
def agg_list_keys(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.array("user_id", F.floor(F.col("value") / 100)))
    operators = [{"kind": "udf_source", "name": "e"}, {"kind": "group_by", "source": 0, "fields": ["k"], "aggregate": {"kind": "builtin", "op": "count", "field": "k"}}]
    out = run(spark, operators, {"e": lambda s: df}, running=False).withColumnRenamed("count(k)", "n")
    return out.select(F.get("k", F.lit(0)).alias("user_id"), F.get("k", F.lit(1)).alias("bucket"), "n")


@query("SELECT user_id, round(sum(value * value), 4) AS squares, count(*) AS n FROM events GROUP BY user_id")
def agg_custom(spark, sf):
    """An aggregate by name, as a descriptor's user-defined one."""
    registry = Registry()
    squares = lambda df, keys, order: aggregates.custom(df, keys, lambda g: g.iloc[:1][keys].assign(squares=(g["value"] ** 2).sum(), n=len(g)), "user_id bigint, squares double, n bigint")
    registry.add("aggregate", "squares", squares)
    operators = [{"kind": "udf_source", "name": "e"}, {"kind": "group_by", "source": 0, "fields": ["user_id"], "aggregate": {"kind": "udf", "name": "squares"}}]
    out = run(spark, operators, {"e": lambda s: table(s, sf, "events").select("user_id", "value")}, registry=registry)
    return out.select("user_id", rounded(F.col("squares"), 4).alias("squares"), "n")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_acctbal > 0")
def filters_by_name(spark, sf):
    """A filter and a residual join predicate by name."""
    registry = Registry()
    registry.add("filter", "dear", lambda df: F.col("o_totalprice") > 200000)
    registry.add("join_filter", "solvent", lambda a, b: F.col("r.c_acctbal") > 0)
    operators = [
        {"kind": "udf_source", "name": "orders"},
        {"kind": "udf_source", "name": "customers"},
        {"kind": "filter", "source": 0, "predicate": {"kind": "udf", "name": "dear", "args": []}},
        {"kind": "join", "left": 2, "right": 1, "predicate": {"kind": "udf", "name": "solvent", "args": []}, "join_info": {"kind": "inner_build_right", "fields": ["k"]}},
        {"kind": "project", "source": 3, "fields": ["o_orderkey", "c_name"]},
    ]
    sources = {"orders": lambda s: table(s, sf, "orders").withColumnRenamed("o_custkey", "k"), "customers": lambda s: table(s, sf, "customer").withColumnRenamed("c_custkey", "k")}
    return run(spark, operators, sources, registry=registry, inner_predicate=True)


@query(E + " SELECT a.event_id AS event_id, b.event_id AS other_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(a.us - b.us) <= 1800000000")
def join_eviction(spark, sf):
    """A join of two streams whose rows leave when the other side is half an hour further."""
    registry = Registry()
    registry.add("join_evict", "half_hour", 1_800_000_000)
    same = binary("=", field("user_id"), field("other_user"))
    operators = [
        {"kind": "udf_source", "name": "a"},
        {"kind": "udf_source", "name": "b"},
        {"kind": "join", "left": 0, "right": 1, "predicate": same, "join_info": {"kind": "double_stream", "eviction_policy": {"kind": "udf", "name": "half_hour", "args": []}}},
        {"kind": "project", "source": 2, "fields": ["event_id", "other_id"]},
    ]
    df = events(spark, sf)
    a = df.filter("event_type = 'error'").select("event_id", "user_id", "us")
    b = df.filter("event_type = 'click'").select(F.col("event_id").alias("other_id"), F.col("user_id").alias("other_user"), "us")
    return run(spark, operators, {"a": lambda s: a, "b": lambda s: b}, registry=registry, event_time="us")


@query(E + " SELECT event_id, row_number() OVER (ORDER BY us, event_id) AS output_number FROM e QUALIFY row_number() OVER (ORDER BY us, event_id) <= 500")
def output_log(spark, sf):
    """Outputs numbered in order of arrival, until the five-hundredth (a limit that is the feature)."""
    return relational.log_output(events(spark, sf).select("us", "event_id"), ARRIVAL, 500).select("event_id", "output_number")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5")
def take_and_skip(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice").withColumn("minus", -F.col("p_retailprice"))
    return relational.take(df, ["minus", "p_partkey"], 20, 5).drop("minus")


# --- unions, top-k, chunks ---------------------------------------------------------------------


@query("SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE value > 400")
def union_all(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    operators = [{"kind": "udf_source", "name": "a"}, {"kind": "udf_source", "name": "b"}, {"kind": "union", "left": 0, "right": 1}]
    return run(spark, operators, {"a": lambda s: df.filter("event_type = 'click'").drop("event_type"), "b": lambda s: df.filter("value > 400").drop("event_type")})


@query("SELECT event_id, value, NULL::VARCHAR AS event_type FROM events WHERE value > 450 UNION ALL SELECT event_id, NULL, event_type FROM events WHERE value < 20")
def union_missing_columns(spark, sf):
    df = table(spark, sf, "events")
    return relational.union(df.filter("value > 450").select("event_id", "value"), df.filter("value < 20").select("event_id", "event_type"))


@query("SELECT event_id, n FROM (SELECT event_id FROM events WHERE value > 300 INTERSECT ALL SELECT event_id FROM events WHERE event_type = 'view'), (SELECT 1 AS n)")
def intersect_all(spark, sf):
    df = table(spark, sf, "events")
    return relational.intersect_all(df.filter("value > 300").select("event_id"), df.filter("event_type = 'view'").select("event_id")).withColumn("n", F.lit(1))


@query("SELECT event_id FROM events WHERE value > 300 EXCEPT ALL SELECT event_id FROM events WHERE event_type = 'view'")
def except_all(spark, sf):
    df = table(spark, sf, "events")
    return relational.except_all(df.filter("value > 300").select("event_id"), df.filter("event_type = 'view'").select("event_id"))


@query("SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def top_k_per_group(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "value")
    return relational.top_k(df, ["user_id"], [F.desc("value"), F.asc("event_id")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT r_name, c AS cycle FROM region, (SELECT unnest([0, 1, 2]) AS c)")
def repeat_cycles(spark, sf):
    return relational.repeat(table(spark, sf, "region"), 3).select("r_name", "cycle")


@query(E + ", n AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 16 AS chunk FROM e) SELECT user_id, chunk, count(*) AS n, min(event_id) AS low FROM n GROUP BY user_id, chunk")
def chunk_by_count(spark, sf):
    df = relational.chunk_by_count(events(spark, sf), ["user_id"], ARRIVAL, 16)
    return df.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("low"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def stream_positions(spark, sf):
    return relational.positions(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "position")


_WAVE = "least(8000 + (CASE WHEN (i // 100) % 48 <= 24 THEN (i // 100) % 48 ELSE 48 - (i // 100) % 48 END) * 500, 20000)"


@query(f"WITH x AS (SELECT event_id AS i FROM events), t AS (SELECT i, {_WAVE} AS gap FROM x) SELECT i AS event_id, CAST(gap AS BIGINT) AS gap_us, CAST(sum(gap) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - gap AS BIGINT) AS arrival_us FROM t")
def arrival_wave(spark, sf):
    df = table(spark, sf, "events").select("event_id")
    out = readers.wave_arrivals(df, "event_id", 8000, 20000, 500, 100)
    return out.select("event_id", readers.wave_interval(F.col("event_id"), 8000, 20000, 500, 100).cast("long").alias("gap_us"), "arrival_us")


@query("SELECT event_id, event_id * 16666 AS arrival_us FROM events")
def arrival_fixed(spark, sf):
    return readers.fixed_arrivals(table(spark, sf, "events").select("event_id"), "event_id", 16666)


# --- routing -----------------------------------------------------------------------------------

_ROUTE = "event_id % 4"


def _router(spark, sf, route: dict, backup: dict | None = None, routing_fn=None) -> DataFrame:
    registry = Registry()
    if routing_fn:
        registry.add("routing", "routing_fn", routing_fn)
    operators = [
        {"kind": "udf_source", "name": "e"},
        {"kind": "channel_router", "source": 0, "route_expression": route, "routes": [2, 5], **({"backup_route": backup} if backup else {})},
        {"kind": "channel_spout", "source": 1, "timeout": 10},
        {"kind": "derive", "source": 2, "new_field_name": "branch", "expression": lit("int", 1)},
        {"kind": "merge", "source": 3, "parent": 8},
        {"kind": "channel_spout", "source": 1, "timeout": 10},
        {"kind": "derive", "source": 5, "new_field_name": "branch", "expression": lit("int", 2)},
        {"kind": "merge", "source": 6, "parent": 8},
        {"kind": "merge_spout", "sources": [4, 7], "timeout": 10},
    ]
    return run(spark, operators, {"e": lambda s: table(s, sf, "events").select("event_id", "user_id", "value")}, registry=registry)


@query("SELECT event_id, user_id, value, CAST(event_id % 4 AS INTEGER) AS branch FROM events WHERE event_id % 4 IN (1, 2)")
def route_expr(spark, sf):
    return _router(spark, sf, binary("%", field("event_id"), lit("int", 4)))


@query("SELECT event_id, user_id, value, CAST(event_id % 4 - 1 AS INTEGER) AS branch FROM events WHERE event_id % 4 IN (2, 3)")
def route_negative_drop(spark, sf):
    return _router(spark, sf, binary("-", binary("%", field("event_id"), lit("int", 4)), lit("int", 1)))


@query("SELECT count(*) AS kept, (SELECT count(*) FROM events) - count(*) AS lost FROM events WHERE event_id % 7 IN (1, 2)")
def route_out_of_range(spark, sf):
    df = table(spark, sf, "events").select("event_id")
    routed = routing.route(df, F.col("event_id") % 7)
    flags = routed.select(F.col(routing.ROUTE).between(1, 2).alias("k"))
    return flags.agg(F.count(F.when(F.col("k"), 1)).alias("kept"), F.count(F.when(~F.col("k"), 1)).alias("lost"))


@query("SELECT event_id, user_id, value, CASE WHEN event_id % 4 IN (1, 2) THEN CAST(event_id % 4 AS INTEGER) END AS branch FROM events WHERE event_id % 4 IN (0, 1, 2)")
def route_backup_defaults(spark, sf):
    backup = {"kind": "forward_with_values", "merge_spout_position": 8, "values_to_set": [{"key": "branch", "value": None}]}
    return _router(spark, sf, binary("%", field("event_id"), lit("int", 4)), backup)


@query(E + ", x AS (SELECT event_id, row_number() OVER (PARTITION BY ms // 86400000 ORDER BY us, event_id) AS nth FROM e WHERE event_id % 3 = 0) SELECT event_id FROM x WHERE nth <= 20")
def route_custom_backup(spark, sf):
    """Shed rows go to a channel of their own, which holds twenty in a day."""
    operators = [
        {"kind": "udf_source", "name": "e"},
        {"kind": "channel_router", "source": 0, "route_expression": binary("%", field("event_id"), lit("int", 3)), "routes": [2], "backup_route": {"kind": "custom", "max_capacity": 20, "spout_position": 3}},
        {"kind": "channel_spout", "source": 1, "timeout": 10},
        {"kind": "channel_spout", "source": 1, "timeout": 10},
        {"kind": "project", "source": 3, "fields": ["event_id"]},
    ]
    df = events(spark, sf).withColumn("tick", F.expr("ms div 86400000"))
    return run(spark, operators, {"e": lambda s: df}, order=ARRIVAL, tick="tick")


@query(E + ", n AS (SELECT event_id, CAST(event_id % 2 + 1 AS INTEGER) AS pipe, ms // 3600000 AS tick, us FROM e) SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY pipe, tick ORDER BY us, event_id) <= 4 THEN pipe ELSE 0 END AS route FROM n")
def route_capacity_overflow(spark, sf):
    df = events(spark, sf).withColumns({"pipe": (F.col("event_id") % 2 + 1).cast("int"), "tick": F.expr("ms div 3600000")})
    return routing.overflow(df, "pipe", "tick", ARRIVAL, 4).select("event_id", F.col(routing.ROUTE).alias("route"))


@query(E + ", a AS (SELECT event_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY us, event_id) AS age FROM e) SELECT event_id, age FROM a WHERE age IS NOT NULL AND NOT age > 3600000")
def late_expire(spark, sf):
    own = Window.partitionBy("user_id").orderBy(*ARRIVAL)
    df = events(spark, sf).withColumn("created", F.lag("ms").over(own)).filter("created is not null")
    return routing.expire(df, "created", F.col("ms"), 3_600_000)[0].select("event_id", (F.col("ms") - F.col("created")).alias("age"))


@query("SELECT DISTINCT user_id, event_type AS pipeline FROM events")
def merge_feedback_dedup(spark, sf):
    return routing.dedup_feedback(table(spark, sf, "events").select("user_id", F.col("event_type").alias("pipeline")), "user_id", "pipeline")


_U = "((event_id * 7919 + 104729) % 100003) / 100003.0"

for _k in (1, 2, 3):

    def _static(spark, sf, k=_k):
        return table(spark, sf, "events").select("event_id", routing.static(k).alias("route"))

    query(f"SELECT event_id, {_k} AS route FROM events", f"route_static_{_k}")(_static)


@query(E + ", s AS (SELECT event_id, sum(CAST(value AS DECIMAL(27,12))) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM e) SELECT event_id, CASE WHEN 2000 - spent < 0 THEN 0 ELSE 2 END AS route FROM s")
def route_money_guard(spark, sf):
    df = routing.money_spent(events(spark, sf), ["user_id"], ARRIVAL, "value")
    return df.select("event_id", routing.money_guard(F.col("spent"), F.lit(2000), 2).alias("route"))


@query(f"SELECT event_id, CASE WHEN {_U} * (value + 750) < value THEN 1 WHEN {_U} * (value + 750) < value + 250 THEN 2 ELSE 3 END AS route FROM events")
def route_eddies_weighted(spark, sf):
    df = table(spark, sf, "events")
    weights = [F.col("value"), F.lit(250.0), F.lit(500.0)]
    return df.select("event_id", routing.weighted(routing.draw(F.col("event_id")), weights).alias("route"))


@query(f"SELECT event_id, CASE WHEN {_U} < 0.5 THEN CASE WHEN value < 300 THEN 1 WHEN value > 200 THEN 2 ELSE 0 END ELSE CASE WHEN value > 200 THEN 2 WHEN value < 300 THEN 1 ELSE 0 END END AS route FROM events")
def route_half_and_half(spark, sf):
    return table(spark, sf, "events").select("event_id", routing.half_and_half(routing.draw(F.col("event_id")), F.col("value") < 300, F.col("value") > 200).alias("route"))


@query("""
WITH RECURSIVE n AS (SELECT event_id, epoch_us(ts) // 1000 // 86400000 AS tick, row_number() OVER (PARTITION BY epoch_us(ts) // 1000 // 86400000 ORDER BY ts, event_id) AS nth, ((event_id * 7919 + 104729) % 100003) / CAST(100003 AS DOUBLE) AS u FROM events),
r AS (SELECT tick, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS l1, CAST(0 AS DOUBLE) AS l2, CAST(0 AS DOUBLE) AS l3, 0 AS pipe FROM (SELECT DISTINCT tick FROM n)
  UNION ALL SELECT tick, nth, event_id, g1 + CASE WHEN pipe = 1 THEN 1 ELSE 0 END, g2 + CASE WHEN pipe = 2 THEN 1 ELSE 0 END, g3 + CASE WHEN pipe = 3 THEN 1 ELSE 0 END, pipe FROM (
    SELECT *, CASE WHEN f1 + f2 + f3 <= 0 THEN 0 WHEN u * (f1 + f2 + f3) < f1 THEN 1 WHEN u * (f1 + f2 + f3) < f1 + f2 THEN 2 ELSE 3 END AS pipe FROM (
      SELECT *, greatest(1 - g1 / 50, 0) AS f1, greatest(1 - g2 / 100, 0) AS f2, greatest(1 - g3 / 200, 0) AS f3 FROM (
        SELECT n.tick AS tick, n.nth AS nth, n.event_id AS event_id, n.u AS u, greatest(l1 - 1, 0) AS g1, greatest(l2 - 1, 0) AS g2, greatest(l3 - 1, 0) AS g3 FROM r JOIN n ON n.tick = r.tick AND n.nth = r.nth + 1))))
SELECT event_id, CAST(pipe AS INTEGER) AS route FROM r WHERE nth > 0
""")
def route_eddies_queues(spark, sf):
    df = events(spark, sf).withColumn("tick", F.expr("ms div 86400000")).select("tick", "us", "event_id")
    return routing.eddies(df, "tick", "event_id", ARRIVAL, routing.draw(F.col("event_id")), [50, 100, 200], 1).select("event_id", F.col(routing.ROUTE).alias("route"))


@query(f"SELECT event_id, CASE CAST(floor({_U} * 2) AS INTEGER) WHEN 0 THEN CASE WHEN value < 100 THEN 1 WHEN value > 400 THEN 2 ELSE 0 END ELSE CASE WHEN value > 400 THEN 2 WHEN value < 100 THEN 1 ELSE 0 END END AS route FROM events")
def route_random_order(spark, sf):
    return table(spark, sf, "events").select("event_id", routing.random_order(routing.draw(F.col("event_id")), [F.col("value") < 100, F.col("value") > 400]).alias("route"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor({_U} * 2) + 1 AS INTEGER) ELSE CAST(event_id % 3 AS INTEGER) END AS route FROM events")
def route_reroute_zero(spark, sf):
    pipe = (F.col("event_id") % 3).cast("int")
    return table(spark, sf, "events").select("event_id", routing.reroute_zero(pipe, "random", routing.draw(F.col("event_id")), 2).alias("route"))


@query(E + ", a AS (SELECT event_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY us, event_id) AS age FROM e) SELECT event_id, CASE WHEN age > 7200000 THEN 0 ELSE 2 END AS route FROM a")
def route_too_old(spark, sf):
    own = Window.partitionBy("user_id").orderBy(*ARRIVAL)
    df = events(spark, sf).withColumn("age", F.col("ms") - F.lag("ms").over(own))
    return df.select("event_id", routing.too_old(F.col("age"), 7_200_000, F.lit(2)).alias("route"))


@query(E + ", c AS (SELECT event_id, coalesce(sum(CASE WHEN user_id % 2 = 0 THEN value / 1e6 END) OVER w, 0) AS a, coalesce(sum(CASE WHEN user_id % 2 = 1 THEN value / 1e6 END) OVER w, 0) AS b FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id ROWS 49 PRECEDING)) SELECT event_id, round(1 - (a + 0.00045) / (a + b + 0.0009), 8) AS weight_a, round(1 - (b + 0.00045) / (a + b + 0.0009), 8) AS weight_b FROM c")
def route_cost_shares(spark, sf):
    cost = lambda k: F.when(F.col("user_id") % 2 == k, F.col("value") / 1e6)
    df = history.over_last(events(spark, sf), ["event_type"], ARRIVAL, 50, lambda w: {f"cost_{k}": F.coalesce(F.sum(cost(k)).over(w), F.lit(0.0)) for k in (0, 1)})
    a, b = routing.cost_share_weights([F.col("cost_0"), F.col("cost_1")])
    return df.select("event_id", rounded(a, 8).alias("weight_a"), rounded(b, 8).alias("weight_b"))


# --- preclassifiers and buckets ----------------------------------------------------------------

_FEATURES = "value / 100, CAST(user_id AS DOUBLE) / 50"


def _featured(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("x", F.array(F.col("value") / 100, F.col("user_id") / F.lit(50.0)))


@query("SELECT event_id, CASE WHEN value / 100 * 1.5 - user_id / 50.0 * 2.0 - 0.5 > 0 THEN 1 ELSE 0 END AS class FROM events")
def preclass_binary(spark, sf):
    spec = {"weights": [1.5, -2.0], "intercept": -0.5}
    return _featured(spark, sf).select("event_id", classify.classify("binary", spec, F.col("x")).alias("class"))


@query("SELECT event_id, 2 * CASE WHEN value / 100 - 2.25 > 0 THEN 1 ELSE 0 END + CASE WHEN user_id / 50.0 - 1.55 > 0 THEN 1 ELSE 0 END AS class FROM events")
def preclass_nway(spark, sf):
    spec = {"components": [{"weights": [1.0, 0.0], "intercept": -2.25}, {"weights": [0.0, 1.0], "intercept": -1.55}]}
    return _featured(spark, sf).select("event_id", classify.classify("nway", spec, F.col("x")).alias("class"))


@query("SELECT event_id, CASE WHEN c >= a AND c >= b THEN 2 WHEN b >= a THEN 1 ELSE 0 END AS class FROM (SELECT event_id, value / 100 AS a, user_id / 50.0 * 2 AS b, CAST(2.5 AS DOUBLE) AS c FROM events)")
def preclass_multiclass(spark, sf):
    spec = {"weights": [[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]], "intercept": [0.0, 0.0, 2.5]}
    return _featured(spark, sf).select("event_id", classify.classify("multi", spec, F.col("x")).alias("class"))


_PRE = {"preclassifier": {"kind": "binary", "weights": [1.0, 0.0], "intercept": -2.505}, "buckets": [{"class": 0, "rewards": [0.8, 0.9], "costs": [2.0, 9.0]}, {"class": 1, "rewards": [0.6, 0.95], "costs": [2.0, 9.0]}]}


@query("SELECT event_id, CASE WHEN value / 100 - 2.505 > 0 THEN 1 ELSE 0 END AS class, 3 AS n_pipelines, 0.0::DOUBLE AS first_cost, CASE WHEN value / 100 - 2.505 > 0 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS best_reward FROM events")
def bucket_lookup_with_drop(spark, sf):
    pre = classify.load(_PRE)
    df = _featured(spark, sf).withColumn("class", pre.classify(F.col("x")))
    return pre.bucketed(df, "class").select("event_id", "class", F.size("valid").alias("n_pipelines"), F.get("costs", F.lit(0)).alias("first_cost"), F.array_max("rewards").alias("best_reward"))


@query("SELECT event_id, 7 AS class FROM events")
def preclass_static(spark, sf):
    return _featured(spark, sf).select("event_id", classify.classify("static", {"class": 7}, F.col("x")).alias("class"))


@query("SELECT event_id, event_type = 'click' AS found, CASE WHEN event_type = 'click' THEN CAST(0.5 AS DOUBLE) END AS reward FROM events")
def bucket_lookup_by_id(spark, sf):
    pre = classify.Preclassifier("static", {}, [classify.Bucket([0.25], [1.0], "other"), classify.Bucket([0.5], [1.0], "click")])
    return pre.bucketed_by_id(table(spark, sf, "events"), "event_type").select("event_id", F.col("class").isNotNull().alias("found"), F.get("rewards", F.lit(0)).alias("reward"))


@query("WITH b AS (SELECT event_id, value / 100 AS x, user_id / CAST(50 AS DOUBLE) AS y FROM events) SELECT event_id, 4 * CASE WHEN x > 2 THEN 1 ELSE 0 END + 2 * CASE WHEN y > 1 THEN 1 ELSE 0 END + CASE WHEN x > y THEN 1 ELSE 0 END AS class, CASE WHEN x > y THEN CAST(0.893 AS DOUBLE) ELSE CAST(0.814 AS DOUBLE) END AS best, round(x * 0.5 + y * 0.25 + 1, 6) AS cost FROM b")
def llm_bucket(spark, sf):
    form = lambda x, y, b: {"weights": [x, y], "intercept": b}
    out = classify.llm_bucket(_featured(spark, sf), F.col("x"), [form(1.0, 0.0, -2.0), form(0.0, 1.0, -1.0), form(1.0, -1.0, 0.0)], [form(0.1, 0.0, 0.0), form(0.2, 0.0, 0.0), form(0.5, 0.25, 1.0)])
    return out.select("event_id", "class", F.get("rewards", F.lit(3)).alias("best"), r6(F.get("costs", F.lit(3))).alias("cost"))


@query("SELECT event_type AS label, 0 AS pipeline, round(avg(value), 6) AS reward, round(avg(user_id), 6) AS cost FROM events GROUP BY 1 UNION ALL SELECT event_type, 1, round(avg(value * 2), 6), round(avg(user_id + 1), 6) FROM events GROUP BY 1")
def bucket_group_mean(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.array("value", F.col("value") * 2).alias("r"), F.array(F.col("user_id").cast("double"), (F.col("user_id") + 1).cast("double")).alias("c"))
    out = assign.group_means(df, "label", "r", "c")
    return out.select("label", "pipeline", r6(F.col("reward")).alias("reward"), r6(F.col("cost")).alias("cost"))


@query("""
WITH RECURSIVE b AS (SELECT event_type AS label, CAST(user_id % 10 AS INTEGER) AS pipeline, round(avg(value), 3) AS reward, CAST(user_id % 10 * 7 % 10 AS DOUBLE) AS cost FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pipeline) AS nth FROM b),
w AS (SELECT label, nth, pipeline AS p, reward AS r, cost AS c, CAST(NULL AS INTEGER) AS a, CAST(NULL AS DOUBLE) AS ar, CAST(NULL AS DOUBLE) AS ac FROM n WHERE nth = 1
  UNION ALL SELECT n.label, n.nth, CASE WHEN w.c > cost OR w.r <= reward THEN pipeline ELSE w.p END, CASE WHEN w.c > cost OR w.r <= reward THEN reward ELSE w.r END, CASE WHEN w.c > cost OR w.r <= reward THEN cost ELSE w.c END,
    CASE WHEN w.c <= cost AND w.r <= reward THEN w.p END, w.r, w.c FROM w JOIN n ON n.label = w.label AND n.nth = w.nth + 1)
SELECT label, a AS start_pipeline, p AS end_pipeline, round((CASE WHEN c = 0 THEN r ELSE r / c END) - (CASE WHEN ac = 0 THEN ar ELSE ar / ac END), 6) AS score_diff, round(c - ac, 6) AS swap_cost, round(r - ar, 6) AS reward_diff FROM w WHERE a IS NOT NULL
""")
def swap_list(spark, sf):
    own = table(spark, sf, "events").groupBy(F.col("event_type").alias("label"), (F.col("user_id") % 10).cast("int").alias("pipeline"), (F.col("user_id") % 10 * 7 % 10).cast("double").alias("cost")).agg(rounded(F.avg("value"), 3).alias("reward"))
    out = assign.swap_table(own, "label", "pipeline", "reward", "cost")
    return out.select("label", "start_pipeline", "end_pipeline", *[r6(F.col(c)).alias(c) for c in ("score_diff", "swap_cost", "reward_diff")])


# --- assignment --------------------------------------------------------------------------------

BUCKETS = [classify.Bucket([0.0, 14.0, 18.0], [0.0, 1.0, 2.0], 0), classify.Bucket([0.0, 12.0, 15.0], [0.0, 1.0, 2.0], 1)]


def _adaptive(spark, sf, strategy: str, window_ms: int, per_item: float) -> DataFrame:
    df = events(spark, sf).select("event_id", "us", F.floor(F.col("ms") / window_ms).alias("window"), (F.col("value") > 250).cast("int").alias("class"))
    return assign.assign_windows(df, "window", "class", ARRIVAL, BUCKETS, F.lit(per_item), strategy)


_ASSIGN = """
WITH e AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000 // {window} AS w, CASE WHEN value > 250 THEN 1 ELSE 0 END AS class FROM events),
n AS (SELECT w, count(*) FILTER (WHERE class = 0) AS a, count(*) FILTER (WHERE class = 1) AS b FROM e GROUP BY w),
g AS (SELECT w, a, b, least(a, {budget}) AS a1, least(b, {budget} - least(a, {budget})) AS b1 FROM n),
h AS (SELECT *, {budget} - a1 - b1 AS left_over FROM g),
k AS (SELECT *, least(b1, left_over) AS b2 FROM h),
m AS (SELECT *, least(a1, left_over - b2) AS a2 FROM k),
r AS (SELECT event_id, w, class, row_number() OVER (PARTITION BY w, class ORDER BY us, event_id) AS nth FROM e)
SELECT event_id, class, CAST(CASE WHEN class = 0 THEN CASE WHEN nth <= a2 THEN 2 WHEN nth <= a1 THEN 1 ELSE 0 END
       ELSE CASE WHEN nth <= b2 THEN 2 WHEN nth <= b1 THEN 1 ELSE 0 END END AS INTEGER) AS pipeline
FROM r JOIN m USING (w)
"""


@query(_ASSIGN.format(window=86_400_000, budget=300))
def assign_greedy(spark, sf):
    return _adaptive(spark, sf, "greedy", 86_400_000, 300.0).select("event_id", "class", "pipeline")


# With rising prices for ever smaller gains the optimum takes gains in order: 14, 12, then 4, 3.
_OPTIMAL = _ASSIGN.replace("least(b1, left_over) AS b2 FROM h", "least(a1, left_over) AS a2 FROM h").replace("least(a1, left_over - b2) AS a2 FROM k", "least(b1, left_over - a2) AS b2 FROM k")


@query(_OPTIMAL.format(window=600_000, budget=5))
def assign_optimal(spark, sf):
    out = _adaptive(spark, sf, "optimal", 600_000, 5.0)
    return out.select("event_id", "class", "pipeline")


@query(_ASSIGN.format(window=3_600_000, budget=12))
def route_adaptive_greedy(spark, sf):
    """Classes, assignment within the hour's budget, branches for the pipelines, and their merge."""
    routed = _adaptive(spark, sf, "greedy", 3_600_000, 12.0).withColumnRenamed("pipeline", routing.ROUTE)
    by_branch = routing.tagged(routed, {k: {"pipeline": F.lit(k)} for k in (0, 1, 2)})
    return by_branch.select("event_id", "class", "pipeline")


_SCALED = "floor(CASE WHEN a + b <= 60 THEN 300 WHEN (a + b - 60) / 250.0 <= 0.1 THEN 300 * (1 - (a + b - 60) / 250.0) WHEN (a + b - 60) / 250.0 <= 1 THEN 300 * (1 - sqrt((a + b - 60) / 250.0)) ELSE 0 END + 1e-9)"


@query(_ASSIGN.format(window=43_200_000, budget=_SCALED))
def route_controlled_budget(spark, sf):
    """Windows whose budget a controller cuts as their backlog grows."""
    df = events(spark, sf).select("event_id", "us", F.floor(F.col("ms") / 43_200_000).alias("window"), (F.col("value") > 250).cast("int").alias("class"))
    backlog = F.count("*").over(Window.partitionBy("window")) - 60
    money = budget.for_window(budget.options(budget_version=2, large_excess="sqrt", penalty="linear_mean"), F.lit(300.0), F.lit(250.0), backlog)
    held = df.withColumn("money", money)
    return assign.assign_windows(held, "window", "class", ARRIVAL, BUCKETS, F.col("money")).select("event_id", "class", "pipeline")


_LOOKAHEAD = """
, r AS (SELECT event_id, event_type, us, value, ms // {window} AS w, CASE WHEN value > 250 THEN 1 ELSE 0 END AS class,
    count(CASE WHEN value <= 250 THEN 1 END) OVER h AS p0, count(CASE WHEN value > 250 THEN 1 END) OVER h AS p1, count(*) OVER h AS pn, min(us) OVER h AS t0, max(us) OVER h AS t1,
    row_number() OVER (PARTITION BY event_type, ms // {window} ORDER BY us, event_id) AS nth
  FROM e WINDOW h AS (PARTITION BY event_type ORDER BY us, event_id ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)),
k AS (SELECT event_type, w, count(*) FILTER (WHERE class = 0) AS k0, count(*) FILTER (WHERE class = 1) AS k1, any_value(p0) FILTER (WHERE nth = 1) AS p0, any_value(p1) FILTER (WHERE nth = 1) AS p1,
    any_value(CASE WHEN pn >= 2 AND (t1 - t0) / (pn - 1) >= 100 THEN floor({time} * 1000.0 / ((t1 - t0) / (pn - 1))) ELSE 0 END) FILTER (WHERE nth = 1) AS by_time FROM r GROUP BY ALL),
m AS (SELECT *, CASE WHEN p0 + p1 > 0 THEN greatest(least(by_time, {cap}) - k0 - k1, 0) ELSE 0 END AS more FROM k),
f AS (SELECT *, CASE WHEN more > 0 THEN floor(more * p0 / (p0 + p1)) ELSE 0 END AS f0, CASE WHEN more > 0 THEN floor(more * p1 / (p0 + p1)) ELSE 0 END AS f1 FROM m),
g AS (SELECT *, f0 + CASE WHEN more > f0 + f1 AND more * p0 / (p0 + p1) - f0 >= more * p1 / (p0 + p1) - f1 THEN 1 ELSE 0 END AS more0 FROM f),
t AS (SELECT *, k0 + more0 AS a, k1 + more - more0 AS b, floor({budget} * least(1, (k0 + k1 + more) / greatest(by_time, k0 + k1)) + 1e-9) AS money FROM g),
u AS (SELECT *, least(a, money) AS a1, least(b, money - least(a, money)) AS b1 FROM t),
v AS (SELECT *, least(b1, money - a1 - b1) AS b2 FROM u),
x AS (SELECT *, least(a1, money - a1 - b1 - b2) AS a2 FROM v),
y AS (SELECT event_id, event_type, w, class, row_number() OVER (PARTITION BY event_type, w, class ORDER BY us, event_id) AS n FROM r)
SELECT event_id, class, CAST(CASE WHEN a + b <= 100 THEN CASE WHEN class = 0 THEN CASE WHEN n > a - a2 THEN 2 WHEN n > a - a1 THEN 1 ELSE 0 END ELSE CASE WHEN n > b - b2 THEN 2 WHEN n > b - b1 THEN 1 ELSE 0 END END
  ELSE CASE WHEN class = 0 THEN CASE WHEN n <= a2 THEN 2 WHEN n <= a1 THEN 1 ELSE 0 END ELSE CASE WHEN n <= b2 THEN 2 WHEN n <= b1 THEN 1 ELSE 0 END END END AS INTEGER) AS pipeline
FROM y JOIN x USING (event_type, w)
"""


@query(E + _LOOKAHEAD.format(window=14_400_000, rows=30, time=14_400_000, cap=60, budget=25))
def route_lookahead_greedy(spark, sf):
    """The whole scheduler: known classes, forecast, scaled budget, assignment, and the known rows' routes."""
    df = events(spark, sf).withColumns({"window": F.expr("ms div 14400000"), "class": (F.col("value") > 250).cast("int")})
    look = history.Lookahead(60, 14_400_000.0)
    out = scheduler.lookahead_windows(df, ["event_type"], "window", "class", ARRIVAL, "us", BUCKETS, F.lit(25.0), look, 30)
    return out.select("event_id", "class", "pipeline")


@query(E + _LOOKAHEAD.format(window=864_000_000, rows=30, time=86_400_000, cap=400, budget=300))
def route_lookahead_grouped(spark, sf):
    """As above over windows of more than a hundred items, which are assigned by label."""
    df = events(spark, sf).withColumns({"window": F.expr("ms div 864000000"), "class": (F.col("value") > 250).cast("int")})
    look = history.Lookahead(400, 86_400_000.0)
    out = scheduler.lookahead_windows(df, ["event_type"], "window", "class", ARRIVAL, "us", BUCKETS, F.lit(300.0), look, 30)
    return out.select("event_id", "class", "pipeline")


@query(_OPTIMAL.format(window=1_200_000, budget=8))
def route_adaptive_optimal(spark, sf):
    """The optimum within the budget of twenty minutes, branches for the pipelines, and their merge."""
    routed = _adaptive(spark, sf, "optimal", 1_200_000, 8.0).withColumnRenamed("pipeline", routing.ROUTE)
    return routing.tagged(routed, {k: {"pipeline": F.lit(k)} for k in (0, 1, 2)}).select("event_id", "class", "pipeline")


# --- history, forecast, budgets ----------------------------------------------------------------


@query(E + " SELECT event_id, CASE WHEN count(us) OVER w > 1 THEN CAST(floor(greatest((max(us) OVER w - min(us) OVER w) / (count(us) OVER w - 1), 1000)) AS BIGINT) END AS interval_us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS 9 PRECEDING)")
def hist_ingress_rate(spark, sf):
    out = history.over_last(events(spark, sf), ["user_id"], ARRIVAL, 10, lambda w: {"interval": history.coarse_interval("us", w)})
    return out.select("event_id", F.floor("interval").alias("interval_us"))


@query(E + ", d AS (SELECT event_id, user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM e) SELECT event_id, CAST(floor(greatest(avg(gap) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 8 PRECEDING), 1000)) AS BIGINT) AS interval_us FROM d WHERE gap IS NOT NULL")
def hist_fine_rate(spark, sf):
    out = history.fine_interval(events(spark, sf), ["user_id"], ARRIVAL, "us", 10, "interval_us")
    return out.filter("interval_us is not null").select("event_id", F.floor("interval_us").alias("interval_us"))


@query(E + " SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 19 PRECEDING), 9) AS mean_elapsed FROM e")
def hist_mean_age(spark, sf):
    out = history.over_last(events(spark, sf), ["user_id"], ARRIVAL, 20, lambda w: {"mean": history.mean_of("value", w)})
    return out.select("event_id", rounded(F.col("mean"), 9).alias("mean_elapsed"))


@query(E + ", d AS (SELECT event_id, user_id, us, value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM e) SELECT event_id, round(coalesce(avg(d) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 8 PRECEDING), 0), 9) AS increase FROM d")
def hist_mean_increase(spark, sf):
    return history.mean_increase(events(spark, sf), ["user_id"], ARRIVAL, "value", 10, "increase").select("event_id", rounded(F.col("increase"), 9).alias("increase"))


@query(E + ", d AS (SELECT event_id, user_id, us, value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM e), s AS (SELECT event_id, coalesce(list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 8 PRECEDING), []) AS l FROM d) SELECT event_id, CASE WHEN len(l) > 0 THEN round(list_sum(list_transform(l, lambda x, i: x * i)) / (len(l) * (len(l) + 1) / 2), 9) ELSE 0 END AS increase FROM s")
def hist_weighted_increase(spark, sf):
    return history.weighted_increase(events(spark, sf), ["user_id"], ARRIVAL, "value", 10, "increase").select("event_id", rounded(F.col("increase"), 9).alias("increase"))


@query(E + ", m AS (SELECT max(ms) AS now FROM e) SELECT user_id, count(*) AS pending, CAST(floor(avg(now - ms)) AS BIGINT) AS mean_age, max(now - ms) AS max_age FROM e, m WHERE event_id % 5 = 0 GROUP BY user_id")
def hist_pending(spark, sf):
    df = events(spark, sf)
    now = df.agg(F.max("ms").alias("now"))
    routed = df.crossJoin(F.broadcast(now))  # one row
    out = history.pending_marked(routed, F.col("event_id") % 5 != 0, ["user_id"], F.col("now"), "ms")
    return out.withColumn("mean_age", F.floor("mean_age"))


@query(E + " SELECT event_id, count(CASE WHEN user_id % 2 = 0 THEN 1 END) OVER w AS class_0, count(CASE WHEN user_id % 2 = 1 THEN 1 END) OVER w AS class_1 FROM e WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id ROWS 29 PRECEDING)")
def hist_past_counts(spark, sf):
    df = events(spark, sf).withColumn("class", (F.col("user_id") % 2).cast("int"))
    return history.past_counts(df, ["event_type"], ARRIVAL, "class", [0, 1], 30).select("event_id", "class_0", "class_1")


@query(E + ", m AS (SELECT max(ms) AS now FROM e) SELECT event_id, 0 AS pipeline, CAST(864000000 AS BIGINT) AS elapsed FROM e, m WHERE now - ms > 864000000")
def hist_stale_cleanup(spark, sf):
    df = events(spark, sf)
    routed = df.crossJoin(F.broadcast(df.agg(F.max("ms").alias("now"))))  # one row
    return history.stale_cleanup(routed, "event_id", "ms", F.col("now"), 864_000_000)[1].select("event_id", "pipeline", "elapsed")


@query(E + " SELECT event_id, CAST(event_id % 2 AS INTEGER) AS pipeline, CAST(floor(value) AS BIGINT) AS elapsed FROM e WHERE event_id % 3 = 0")
def hist_feedback_match(spark, sf):
    df = events(spark, sf).withColumn("pipeline", (F.col("event_id") % 2).cast("int"))
    merged = df.filter("event_id % 3 = 0").withColumn("done", F.col("ms") + F.floor("value"))
    return history.match_feedback(df.select("event_id", "pipeline", "ms"), merged.select("event_id", "pipeline", "done"), "event_id", "ms", "done").select("event_id", "pipeline", "elapsed")


@query(E + ", w AS (SELECT user_id, (max(us) - min(us)) / (count(*) - 1) AS gap FROM e GROUP BY user_id HAVING count(*) > 1) SELECT user_id, CAST(least(40, floor(1.2e11 / gap)) AS INTEGER) AS window_size, round(least(1, least(40, floor(1.2e11 / gap)) / greatest(floor(1.2e11 / gap), 1)), 6) AS ratio_kept FROM w")
def forecast_window_size(spark, sf):
    grouped = events(spark, sf).groupBy("user_id").agg(((F.max("us") - F.min("us")) / (F.count("*") - 1)).alias("gap"), F.count("*").alias("n")).filter("n > 1")
    size, unclipped = history.window_sizes(F.col("gap"), F.col("n"), history.Lookahead(40, 1.2e8))
    return grouped.select("user_id", size.alias("window_size"), r6(history.kept_ratio(size, F.greatest(unclipped, F.lit(1)))).alias("ratio_kept"))


@query("SELECT event_id, round(user_id * 0.5 * 1000.0 / 250.0, 6) AS full, round(user_id * 0.5 * 1000.0 / 250.0 * greatest(0, 1 - value / 500), 6) AS reduced FROM events")
def budget_v1(spark, sf):
    args = (F.col("user_id"), F.lit(0.5), F.lit(1000.0), F.lit(250.0))
    return table(spark, sf, "events").select("event_id", r6(budget.v1(*args)).alias("full"), r6(budget.v1(*args, F.col("value") / 500)).alias("reduced"))


@query("WITH p AS (SELECT event_id, (value - 50) / 250 AS e FROM events) SELECT event_id, round(CASE WHEN e <= 0 THEN 1000.0 WHEN e <= 0.1 THEN 1000 * (1 - e) WHEN e <= 1 THEN 1000 * (1 - sqrt(e)) ELSE 0 END, 6) AS punished, round(CASE WHEN e <= 0 THEN 1000.0 WHEN e <= 1 THEN 1000 * (1 - e) ELSE 0 END, 6) AS linear FROM p")
def budget_v2(spark, sf):
    args = (F.lit(1000.0), F.col("value") - 50, F.lit(250.0))
    return table(spark, sf, "events").select("event_id", r6(budget.v2(*args, "sqrt")).alias("punished"), r6(budget.v2(*args)).alias("linear"))


@query("SELECT event_id, round(greatest(1000 * (1 - user_id / 250.0) * least(greatest(1 - (value - 250) / 250, 0), 1.05), 0), 6) AS budget FROM events")
def budget_v3(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(budget.v3(F.lit(1000.0), F.col("user_id").cast("double"), F.col("value") - 250, F.lit(250.0))).alias("budget"))


@query("""
WITH RECURSIVE d AS (SELECT event_id, user_id, value, row_number() OVER o AS nth, value - lag(value) OVER o AS d FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, nth, event_id, value, CAST(0 AS DOUBLE) AS ema FROM d WHERE nth = 1
  UNION ALL SELECT d.user_id, d.nth, d.event_id, d.value, r.ema * (1 - 0.1::DOUBLE) + d.d * 0.1::DOUBLE FROM r JOIN d ON d.user_id = r.user_id AND d.nth = r.nth + 1)
SELECT event_id, round(greatest(1000 * (1 - 1.05::DOUBLE * value / 500) * least(1.05::DOUBLE, 1 - ema / 500), 0), 6) AS budget FROM r
""")
def budget_pd(spark, sf):
    df = events(spark, sf).withColumns({"L": F.lit(1000.0), "D": F.lit(500.0)})
    return budget.pd_control(df, ["user_id"], ARRIVAL, "value", "L", "D").select("event_id", r6(F.col("budget")).alias("budget"))


@query(E + ", d AS (SELECT event_id, user_id, us, value, ms // 86400000 AS day FROM e) SELECT event_id, round((day - min(day) OVER w + 1) * 200.0::DOUBLE - CAST(sum(CAST(value AS DECIMAL(27,12))) OVER w AS DOUBLE), 6) AS money_left FROM d WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")
def money_budget_running(spark, sf):
    df = events(spark, sf).withColumn("day", F.expr("ms div 86400000"))
    return budget.money(df, ["user_id"], ARRIVAL, "day", "value", 200.0).select("event_id", r6(F.col("money_left")).alias("money_left"))


@query(E + ", n AS (SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1) // 16 AS batch FROM e) SELECT event_id, CAST(batch AS BIGINT) AS batch FROM n")
def budget_sub_batches(spark, sf):
    return budget.sub_batches(events(spark, sf), ["event_type"], ARRIVAL).select("event_id", "batch")


# --- sources -----------------------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_csv(spark, sf):
    """Customers as CSV with a header, read again by position."""
    path = _place(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return readers.csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT conv_id, turn, role, text, question_index FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS question_index FROM conversations) WHERE question_index >= 10")
def source_json_lines(spark, sf):
    """Turns as JSON lines, numbered in their order, without the first ten (an offset that is the feature)."""
    path = _place(spark, "json")
    table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").write.json(path)
    return readers.json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string", ["conv_id", "turn"], 10)


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def source_empty(spark, sf):
    """A source without rows lends its fields to a union."""
    return relational.union(table(spark, sf, "nation").select("n_nationkey", "n_name"), readers.empty(spark, "n_nationkey bigint, note string"))


@query(E + ", m AS (SELECT min(us) AS t0, max(us) - min(us) AS span FROM e) SELECT event_id, cycle, CAST(7000000 + cycle * (span * 1000 + 1) + (us - t0) * 1000 + CASE WHEN cycle = 0 THEN 0 ELSE -500 END AS BIGINT) AS created_ns FROM e, m, (SELECT unnest([0, 1]) AS cycle)")
def source_replay(spark, sf):
    """Captured events replayed twice; the first pass takes no adjustment below 0."""
    path, df = _place(spark, "captured"), events(spark, sf)
    first = df.agg(F.min("us").alias("_t0"))
    df.crossJoin(F.broadcast(first)).select("event_id", ((F.col("us") - F.col("_t0")) * 1000).alias("relative_ns")).write.parquet(path)  # one row
    return readers.replay(spark, path, "relative_ns", 7_000_000, 2, -500).select("event_id", "cycle", "created_ns")


@query(E + " SELECT 'router' AS location, event_id AS tuple_id, CAST(us * 1000 AS VARCHAR) AS unix_ns, CAST(us * 1000 - 1000000 AS VARCHAR) AS relative_ns, event_type FROM e")
def sink_event_log(spark, sf):
    df = events(spark, sf).withColumn("ns", F.col("us") * 1000)
    out = readers.event_log(df, "router", "event_id", "ns", 1_000_000, ["event_type"])
    return out.select("location", "tuple_id", F.col("unix_time_ns").cast("string").alias("unix_ns"), F.col("relative_time_ns").cast("string").alias("relative_ns"), F.col("aux")["event_type"].alias("event_type"))


@query("SELECT event_id, us FROM (SELECT event_id, epoch_us(ts) AS us FROM events) ORDER BY us, event_id LIMIT 25")
def sink_capture(spark, sf):
    """The first rows of an operator, kept to be looked at (a limit that is the feature)."""
    path = _place(spark, "tap")
    readers.capture(events(spark, sf).select("event_id", "us"), path, ARRIVAL)
    return spark.read.parquet(path)


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS INTEGER) AS expected_count_15, CAST(count(*) FILTER (WHERE event_type = 'view') AS INTEGER) AS expected_count_16, CAST(0 AS INTEGER) AS expected_count_17 FROM events GROUP BY user_id")
def source_class_counts(spark, sf):
    """A map of counts for each user as a column for each class; a class that never occurs counts 0."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    return readers.class_counts(maps, "user_id", "counts", {"click": 15, "view": 16, "absent": 17}).drop("counts")


@query("SELECT event_id, event_type AS class_id, CAST(value AS DOUBLE) AS count FROM events")
def text_split_prefix(spark, sf):
    """Fields named by a prefix and a class, taken apart again."""
    named = F.create_map(F.concat(F.lit("expected_count_"), "event_type"), F.col("value"), F.lit("other_field"), F.lit(-1.0))
    kept = table(spark, sf, "events").select("event_id", text.split_prefix(named, "expected_count_").alias("m"))
    return kept.select("event_id", F.explode("m").alias("class_id", "count"))


@query("SELECT r_name, c AS cycle FROM region, (SELECT unnest([0, 1, 2]) AS c) QUALIFY row_number() OVER (ORDER BY c, r_regionkey) <= 12")
def repeat_with_total(spark, sf):
    """Cycles over the regions, until twelve rows are out (a limit that is the feature)."""
    return relational.repeat(table(spark, sf, "region").select("r_regionkey", "r_name"), 3, order=["r_regionkey"], total=12).select("r_name", "cycle")


@query("SELECT event_id, 0 AS route FROM events")
def route_drop_all(spark, sf):
    return table(spark, sf, "events").select("event_id", routing.static(0).alias("route"))


@query("SELECT event_id, user_id, value, CAST(CASE WHEN value > 250 THEN 2 ELSE 1 END AS INTEGER) AS branch FROM events")
def route_by_function(spark, sf):
    """A routing function by name instead of an expression."""
    return _router(spark, sf, {"kind": "udf", "name": "routing_fn", "args": []}, routing_fn=lambda df: routing.route(df, F.when(F.col("value") > 250, 2).otherwise(1)))


# --- streams -----------------------------------------------------------------------------------


#: Rows of a file and of a micro-batch of a fed stream.
FEED_FILE_ROWS, FEED_BATCH_ROWS = 250_000, 6_000_000


def _feed(df: DataFrame, order: str, last: DataFrame | None = None, parts: int = 3) -> DataFrame:
    """``df`` as a stream in an order, in ``parts`` micro-batches or more; ``last`` comes after them.

    A part's rows are written by many tasks, to about equal files that make a micro-batch.  Rows are first filed by
    their part, so that each part reads its own only, however many parts there are.
    """
    df = written(df, "fed")
    path, filed = (f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}" for name in ("feed", "filed"))
    n, low, high = df.agg(F.count("*"), F.min(order), F.max(order)).first()
    parts = max(parts, -(-n // FEED_BATCH_ROWS))
    files = max(1, -(-n // (parts * FEED_FILE_ROWS)))
    step = ((high or 0) - (low or 0)) // parts + 1
    df.withColumn("_part", F.floor((F.col(order) - F.lit(low)) / step).cast("int")).write.partitionBy("_part").parquet(filed)
    rows = df.sparkSession.read.schema(df.withColumn("_part", F.lit(0)).schema).parquet(filed)
    for k in range(parts):
        rows.filter(F.col("_part") == k).drop("_part").repartition(files, order).write.mode("append").parquet(path)
    if last is not None:
        last.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return streams.files(df.sparkSession, path, df.schema, files)


def _drained(df: DataFrame) -> DataFrame:
    """What a stream gives for all that is there, written with a checkpoint, as a table."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/drained-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name, None) for name in stateful.LEAN_STORE}
    stateful.state_store(spark, lean=True)
    try:
        writer = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 THEN CAST(event_id % 2 + 1 AS INTEGER) ELSE 0 END AS pipeline, CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 THEN CAST(30000 AS DOUBLE) ELSE CAST(3600000 AS DOUBLE) END AS elapsed_ms FROM events")
def stream_outcomes(spark, sf):
    """Routed items meet their feedback; what has none within the hour is purged once the watermark has passed."""
    df = events(spark, sf).select("event_id", "us", F.timestamp_micros("us").alias("created"), F.timestamp_micros("us").alias("sent"))
    done = F.timestamp_micros(F.col("us") + F.when(F.col("event_id") % 4 == 0, 7_200_000_000).otherwise(30_000_000))
    back = df.filter("event_id % 3 <> 0").select("event_id", "us", (F.col("event_id") % 2 + 1).cast("int").alias("pipeline"), done.alias("done"))
    ahead = lambda df, time: df.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), time: F.col(time) + F.expr("interval 9000 days")})
    routed = _feed(df, "us", ahead(df, "created")).withWatermark("created", "1 hour").drop("us")
    merged = _feed(back, "us", ahead(back, "done").withColumn("event_id", F.lit(-2).cast("long"))).withWatermark("done", "1 hour").drop("us")
    out = _drained(stateful.outcomes(routed, merged, "event_id", "created", "sent", "done", "1 hour"))
    return out.filter("event_id >= 0").select("event_id", "pipeline", "elapsed_ms")


@query("SELECT o_custkey, count(*) AS n_rows, count(*) AS n_expected, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def stream_complete_by_count(spark, sf):
    """A customer's orders, over micro-batches in order of their numbers, given out when the last has come."""
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    df = df.join(df.groupBy("o_custkey").agg(F.count("*").alias("expected")), "o_custkey")
    out = _drained(stateful.complete_by_count(_feed(df, "o_orderkey"), "o_custkey", "expected", "o_totalprice"))
    return out.withColumn("total", rounded(F.col("total"), 2))


# --- vectors -----------------------------------------------------------------------------------


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return df.filter("vec_id % 100 = 0"), df.filter("vec_id % 100 <> 0")


_PAIRS = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0), i AS (SELECT * FROM v WHERE vec_id % 100 <> 0), d AS (SELECT q.vec_id AS vec_id, i.vec_id AS other, list_distance(q.x, i.x) AS dist FROM q, i), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS n FROM d)"


@query(_PAIRS + " SELECT vec_id, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 5 AND dist < 1.12), '') AS match_ids, count(*) FILTER (WHERE n <= 5 AND dist < 1.12) AS n_matches, round(coalesce(sum(dist) FILTER (WHERE n <= 5 AND dist < 1.12), 0), 5) AS total FROM r GROUP BY vec_id")
def knn_topk_lists_inner(spark, sf):
    a, b = _vectors(spark, sf)
    out = vectors.vector_join(a, b, "inner", 5, 5, 1.12, "euclidean", "vec_id")
    total = F.aggregate("match_distances", F.lit(0.0), lambda s, d: s + d)
    return out.select("vec_id", F.concat_ws(",", "match_ids").alias("match_ids"), F.size("match_ids").cast("long").alias("n_matches"), rounded(total, 5).alias("total"))


@query(_PAIRS + " SELECT vec_id, CASE WHEN dist < 1.05 THEN CAST(other AS VARCHAR) END AS match_id, CASE WHEN dist < 1.05 THEN round(dist, 5) END AS distance FROM r WHERE n = 1")
def knn_topk_lists_outer(spark, sf):
    a, b = _vectors(spark, sf)
    out = vectors.vector_join(a, b, "outer_right", 5, 5, 1.05, "euclidean", "vec_id")
    return out.select("vec_id", F.get("match_ids", F.lit(0)).alias("match_id"), rounded(F.get("match_distances", F.lit(0)), 5).alias("distance"))


@query(_PAIRS + " SELECT vec_id, CASE WHEN dist <= 1.01 THEN CAST(other AS VARCHAR) ELSE '' END AS match_ids FROM r WHERE n = 1")
def knn_top1_threshold(spark, sf):
    a, b = _vectors(spark, sf)
    out = vectors.top1_lookup(a, b, vectors.LOOKUP_THRESHOLDS["small"], "vec_id", "embedding", "embedding")
    return out.select("vec_id", F.concat_ws(",", "match_ids").alias("match_ids"))


@query(_PAIRS + " SELECT vec_id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY n) AS match_ids, round(sum(dist), 5) AS total FROM r WHERE n <= 10 GROUP BY vec_id")
def knn_index(spark, sf):
    """By an index of cells, going on until no cell left can hold a nearer row."""
    a, b = _vectors(spark, sf)
    index = vector_index.build(b, "vec_id", "embedding")
    out = vector_index.vector_join(a, index, "inner", 10, 10, probes=4, exact=True, normalise=False)
    total = F.aggregate("match_distances", F.lit(0.0), lambda s, d: s + d)
    return out.select("vec_id", F.concat_ws(",", "match_ids").alias("match_ids"), rounded(total, 5).alias("total"))


@query(_PAIRS.replace("list_distance(q.x, i.x)", "1 - list_cosine_similarity(q.x, i.x)") + " SELECT vec_id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY n) AS match_ids FROM r WHERE n <= 3 GROUP BY vec_id")
def knn_cosine(spark, sf):
    a, b = _vectors(spark, sf)
    return vectors.vector_join(a, b, "inner", 3, 3, 10.0, "cosine", "vec_id").select("vec_id", F.concat_ws(",", "match_ids").alias("match_ids"))


# --- text --------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, lower(left(text, 3)) = 'yes' AS yes, strlen(text) AS bytes, CAST(len(string_split(text, '.')) AS INTEGER) AS sentences FROM conversations")
def text_is_yes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.is_yes(F.col("text")).alias("yes"), text.byte_length(F.col("text")).cast("long").alias("bytes"), text.sentence_count(F.col("text")).alias("sentences"))


@query("SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g')) AS INTEGER) AS punctuation FROM documents")
def text_punct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.punctuation_count(F.col("text")).alias("punctuation"))


@query("SELECT conv_id, '" + text.PROMPT.replace("'", "''") + "' || string_agg(text, chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Is it so?' AS prompt FROM conversations GROUP BY conv_id")
def text_prompt(spark, sf):
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("passages"))
    return grouped.select("conv_id", text.finalize_question(F.lit("Is it so?"), F.col("passages")).alias("prompt"))


@query("WITH d AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(v[1], 6) AS first, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN NULL WHEN len(v) > 1 THEN round(list_sum(v) / (len(v) - 1), 6) ELSE CAST('inf' AS DOUBLE) END AS mean FROM d")
def first_mean_distance(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("v"))
    both = text.first_and_mean_distance(F.col("v"))
    return d.select("user_id", r6(both["first"]).alias("first"), r6(both["mean"]).alias("mean"))


@query("SELECT doc_id, round(CAST(length(text) AS DOUBLE) * CAST(2.5e-6 AS DOUBLE) + n_chars % 100 * CAST(1e-5 AS DOUBLE), 9) AS cost FROM documents")
def token_cost(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rounded(text.token_cost(F.length("text"), F.col("n_chars") % 100, "4o"), 9).alias("cost"))


@query("SELECT user_id, min_by(event_type, event_id) AS first_id FROM events GROUP BY user_id")
def first_id(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("ids"))
    return d.select("user_id", text.first_id(F.col("ids")).alias("first_id"))


@query("SELECT c.conv_id AS conv_id, c.turn AS turn, round(strlen(c.text) * 3.75e-8 + strlen(a.text) * 1.5e-7, 12) AS cost, lower(left(a.text, 3)) = 'yes' AS yes FROM conversations c JOIN conversations a ON c.conv_id = a.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user' AND a.role = 'assistant'")
def llm_recorded_call(spark, sf):
    """A model call as a lookup of the recorded answer, with its price."""
    df = table(spark, sf, "conversations")
    asked = df.filter("role = 'user'").select("conv_id", "turn", "text", (F.col("turn") + 1).alias("at"))
    answers = df.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("answer"))
    out = joins.inner_build_right(asked, answers, ["conv_id", "at"])
    return out.select("conv_id", "turn", rounded(text.token_cost(F.octet_length("text"), F.octet_length("answer"), "1.5-8b"), 12).alias("cost"), text.is_yes(F.col("answer")).alias("yes"))


# --- detections --------------------------------------------------------------------------------


def _scores(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.lit(0).alias("box"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("p"))


for _kind, _norm in (("none", "p"), ("l1", "p / sum(p) OVER (PARTITION BY vec_id)"), ("softmax", "exp(p) / sum(exp(p)) OVER (PARTITION BY vec_id)")):

    def _topk(spark, sf, kind=_kind):
        out = boxes.split_classes(_scores(spark, sf), "vec_id", "p", ["box"], 3, 0.01, (14, 23), kind)
        return out.select("vec_id", "class_id", r6(F.col("probability")).alias("probability"))

    query(f"WITH s AS (SELECT vec_id, unnest(range(64)) AS c, unnest(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS p FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS n FROM s WHERE p >= 0.01 AND c BETWEEN 14 AND 23) SELECT vec_id, CAST(c AS VARCHAR) AS class_id, round({_norm}, 6) AS probability FROM k WHERE n <= 3 UNION ALL SELECT DISTINCT vec_id, '0', 0.0 FROM embeddings", f"topk_classes_{_kind}")(_topk)


def _boxed(spark, sf) -> DataFrame:
    x, y = F.col("value").cast("int"), (F.col("user_id") * 3).cast("int")
    return table(spark, sf, "events").select("event_id", F.array(x - 20, y - 20, x + 80, y + 40).alias("a"), F.array(x, y, x + 100, y + 50).alias("b"), F.lit(400).alias("w"), F.lit(300).alias("h"))


_BOX = "WITH b AS (SELECT event_id, CAST(trunc(value) AS INTEGER) AS x, CAST(user_id * 3 AS INTEGER) AS y FROM events)"


@query(_BOX + ", c AS (SELECT event_id, least(greatest(x - 20, 0), 400) AS x1, least(greatest(y - 20, 0), 300) AS y1, least(greatest(x + 80, 0), 400) AS x2, least(greatest(y + 40, 0), 300) AS y2 FROM b) SELECT event_id, 0 AS my_box_number, CAST(y2 - y1 AS DOUBLE) AS height, CAST(x2 - x1 AS DOUBLE) AS width, CAST((y2 - y1) * (x2 - x1) AS DOUBLE) AS area, CASE WHEN x2 > x1 THEN round((y2 - y1) / (x2 - x1), 6) END AS ratio FROM c")
def box_split(spark, sf):
    out = boxes.split_boxes(_boxed(spark, sf).withColumn("boxes", F.array("a")), "boxes", "w", "h")
    return out.select("event_id", "my_box_number", F.col("new_height_float").alias("height"), F.col("new_width_float").alias("width"), F.col("new_area_float").alias("area"), r6(F.col("new_hw_ratio_float")).alias("ratio"))


_TWO_BOXES = "SELECT event_id, CAST(event_id % 90 AS DOUBLE) AS ax, CAST(user_id % 70 AS DOUBLE) AS ay, CAST(40 + event_id % 50 AS DOUBLE) AS aw, CAST(30 + user_id % 40 AS DOUBLE) AS ah, CAST(event_id * 7 % 110 AS DOUBLE) AS bx, CAST(user_id * 3 % 80 AS DOUBLE) AS b_y, CAST(20 + event_id % 70 AS DOUBLE) AS bw, CAST(25 + event_id % 60 AS DOUBLE) AS bh FROM events"


@query(f"WITH t AS ({_TWO_BOXES}), i AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) AS shared FROM t) SELECT event_id, round(shared / (aw * ah + bw * bh - shared), 6) AS iou FROM i")
def box_iou(spark, sf):
    """Two boxes of each event, of every size and distance: apart, overlapping and one inside the other."""
    i, u = F.col("event_id"), F.col("user_id")
    box = lambda x, y, w, h: F.array(*[c.cast("double") for c in (x, y, x + w, y + h)])
    a, b = box(i % 90, u % 70, 40 + i % 50, 30 + u % 40), box(i * 7 % 110, u * 3 % 80, 20 + i % 70, 25 + i % 60)
    return table(spark, sf, "events").select("event_id", r6(boxes.iou(a, b)).alias("iou"))


def _iou_sql(p: str, q: str) -> str:
    """The overlap of two boxes given as four columns each (``p_x1`` and so on)."""
    shared = f"greatest(0, least({p}_x2, {q}_x2) - greatest({p}_x1, {q}_x1)) * greatest(0, least({p}_y2, {q}_y2) - greatest({p}_y1, {q}_y1))"
    area = lambda c: f"({c}_x2 - {c}_x1) * ({c}_y2 - {c}_y1)"
    return f"({shared}) / ({area(p)} + {area(q)} - ({shared}))"


_THREE_BOXES = f"SELECT event_id, ax AS a_x1, ay AS a_y1, ax + aw AS a_x2, ay + ah AS a_y2, bx AS b_x1, b_y AS b_y1, bx + bw AS b_x2, b_y + bh AS b_y2, ax + bx % 60 AS c_x1, ay + 5 AS c_y1, ax + bx % 60 + aw AS c_x2, ay + 5 + bh AS c_y2 FROM ({_TWO_BOXES})"


@query(f"WITH t AS ({_THREE_BOXES}), o AS (SELECT event_id, {_iou_sql('a', 'b')} AS ab, {_iou_sql('a', 'c')} AS ac, {_iou_sql('c', 'b')} AS cb FROM t) SELECT event_id, '0' || CASE WHEN ac <= 0.5 THEN ',2' ELSE '' END || CASE WHEN ab <= 0.5 AND NOT (ac <= 0.5 AND cb > 0.5) THEN ',1' ELSE '' END AS kept FROM o")
def nms(spark, sf):
    """Three boxes of each event, of every size and distance; the best score first."""
    i, u = F.col("event_id"), F.col("user_id")
    box = lambda x, y, w, h: F.array(*[c.cast("double") for c in (x, y, x + w, y + h)])
    made = F.array(box(i % 90, u % 70, 40 + i % 50, 30 + u % 40), box(i * 7 % 110, u * 3 % 80, 20 + i % 70, 25 + i % 60), box(i % 90 + i * 7 % 110 % 60, u % 70 + 5, 40 + i % 50, 25 + i % 60))
    df = table(spark, sf, "events").select("event_id", made.alias("boxes"), F.array(F.lit(0.9), F.lit(0.8), F.lit(0.85)).alias("scores"))
    return boxes.nms(df, "boxes", "scores", 0.5).select("event_id", F.concat_ws(",", F.transform("kept", lambda k: k.cast("string"))).alias("kept"))


@query("SELECT vec_id, CAST(0 AS INTEGER) + n AS position, round(list_sum(list_transform(range(16), lambda i: CAST(embedding[n * 16 + CAST(i AS INTEGER) + 1] AS DOUBLE))), 5) AS total FROM embeddings, (SELECT CAST(unnest(range(4)) AS INTEGER) AS n)")
def embedding_split(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.array(F.lit(4).cast("long"), F.lit(16).cast("long")).alias("shape"), "embedding").withColumnRenamed("embedding", "data")
    out = boxes.split_embeddings(df, "shape", "data")
    return out.select("vec_id", "position", rounded(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@query("SELECT event_id, user_id % 3 = 0 AS unknown FROM events")
def blur_predicate(spark, sf):
    ids = F.when(F.col("user_id") % 3 == 1, F.array(F.lit("x"))).when(F.col("user_id") % 3 == 2, F.array(F.lit("y"))).when(F.col("user_id") % 2 == 0, F.array().cast("array<string>"))
    return table(spark, sf, "events").select("event_id", boxes.is_unknown(ids).alias("unknown"))


# --- models and signals ------------------------------------------------------------------------


# A direct transform of the first channel: bins k and 16 - k are equal, and the greatest is in no bucket.
@query("""
WITH v AS (SELECT vec_id, list_concat(list_concat(embedding, embedding), embedding) AS s FROM embeddings),
x AS (SELECT vec_id, t, CAST(s[t * 12 + 1] AS DOUBLE) AS x FROM v, range(16) r(t)),
k AS (SELECT vec_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * t / 16)), 2) + pow(sum(x * sin(2 * pi() * k * t / 16)), 2)) AS m FROM x, range(9) g(k) GROUP BY vec_id, k),
b AS (SELECT vec_id, m, CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS w, max(m) OVER (PARTITION BY vec_id) AS top FROM k),
n AS (SELECT vec_id, sum(w) FILTER (WHERE m >= 0.05 * top) AS loud, sum(w) FILTER (WHERE m >= 0.01 * top) AS low_loud, sum(w) FILTER (WHERE m = top) AS on_top FROM b GROUP BY vec_id)
SELECT vec_id, 120 AS n, CAST(CASE WHEN loud <= 0.05 * 16 THEN low_loud ELSE loud END - on_top AS DOUBLE) AS first_histogram FROM n
""")
def fft_features(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.concat(*[F.col("embedding")] * 3).alias("s"))
    out = df.select("vec_id", signal.fft_features("s", 12).alias("f"))
    return out.select("vec_id", F.size("f").alias("n"), F.aggregate(F.slice("f", 1, 5), F.lit(0.0), lambda a, v: a + v).alias("first_histogram"))


@query("SELECT event_id, CAST(12 + event_id % 9 AS DOUBLE) AS width, CAST(10 + event_id % 7 AS DOUBLE) AS height FROM events")
def image_features(spark, sf):
    h, w = (10 + F.col("event_id") % 7).cast("int"), (12 + F.col("event_id") % 9).cast("int")
    pixels = F.encode(F.rpad(F.lit(""), h * w * 3, F.concat(F.col("event_id").cast("string"), F.lit("aZ~"))), "utf-8")
    # Many small images a task: dealt out, for a small table's file would be one task.
    df = table(spark, sf, "events").repartition(spark.sparkContext.defaultParallelism, "event_id").select("event_id", F.array(h, w, F.lit(3)).cast("array<bigint>").alias("shape"), pixels.alias("data"))
    return signal.with_image_features(df, "shape", "data").select("event_id", F.get("features", F.lit(0)).cast("double").alias("width"), F.get("features", F.lit(1)).cast("double").alias("height"))


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: CAST(embedding[CAST(i AS INTEGER) + 1] AS DOUBLE) * (i - 32) / 32.0)), 3) AS y FROM embeddings")
def onnx_infer(spark, sf):
    import numpy as np

    model = models.linear_onnx((np.arange(64.0) - 32).reshape(64, 1) / 32, np.zeros(1))
    registry = Registry()
    registry.add("model", "linear", model)
    tensor = lambda name: {"kind": "SplitParts", "shape_field": "shape", "buffer_field": name}
    operators = [{"kind": "udf_source", "name": "v"}, {"kind": "onnx_inference", "source": 0, "model_path": "linear", "args": [tensor("embedding")], "outputs": [tensor("y")]}]
    out = run(spark, operators, {"v": lambda s: table(s, sf, "embeddings")}, registry=registry)
    return out.select("vec_id", rounded(F.get("y", F.lit(0)).cast("double"), 3).alias("y"))


@query("SELECT event_id, event_id + user_id AS total, event_id * 2 AS twice FROM events")
def python_udf_inline(spark, sf):
    registry = Registry()
    registry.add("inline_python", "f", (lambda a, b: (int(a) + int(b), int(a) * 2), ["bigint", "bigint"]))
    call = {"kind": "inline_python_script", "source": 0, "scripts_dir_path": ".", "script_name": "f", "function_name": "f", "encode_fn": {"kind": "default", "fields": ["event_id", "user_id"]}, "decode_fn": {"kind": "default", "output_fields": ["total", "twice"]}}
    out = run(spark, [{"kind": "udf_source", "name": "e"}, call], {"e": lambda s: table(s, sf, "events").select("event_id", "user_id")}, registry=registry)
    return out.select("event_id", "total", "twice")


@query("SELECT event_id, 100 // user_id AS share FROM events WHERE user_id <> 0")
def python_udf_error_drop(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id")
    return models.inline_python(df, lambda u: 100 // int(u), ["user_id"], "share bigint").select("event_id", "share")


@query("SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS name, user_id + 1 AS next FROM events")
def python_udf_codecs(spark, sf):
    """An inline function and a worker behind encoders and decoders of their own."""
    registry = Registry()
    registry.add("python_encode", "packed", lambda user: ({"user": int(user)},))
    registry.add("inline_python", "named", (lambda packed: {"name": f"u{packed['user']}"}, ["string"]))
    registry.add("python_decode", "unpacked", lambda got: [got["name"]])
    registry.add("python_encode", "id_only", lambda row: int(row["name"][1:]))
    registry.add("python_worker", "plus_one", ("event_id bigint, name string, next bigint", lambda user: user + 1))
    registry.add("python_decode", "with_row", lambda row, value: {"event_id": row["event_id"], "name": row["name"], "next": value})
    registry.add("python_shutdown", "nothing", lambda: None)
    inline = {"kind": "inline_python_script", "source": 0, "scripts_dir_path": ".", "script_name": "named", "function_name": "named", "encode_fn": {"kind": "custom", "function_name": "packed", "fields": ["user_id"]}, "decode_fn": {"kind": "custom", "function_name": "unpacked", "output_fields": ["name"]}}
    worker = {"kind": "python_udf", "source": 1, "script_name": "plus_one", "script_path": "", "encode_fn": "id_only", "decode_fn": "with_row", "shutdown_fn": "nothing"}
    return run(spark, [{"kind": "udf_source", "name": "e"}, inline, worker], {"e": lambda s: table(s, sf, "events").select("event_id", "user_id")}, registry=registry)


def _double(frames):
    for frame in frames:
        yield frame.assign(value=frame["value"] * 2)


@query("SELECT event_id, round(value * 2, 6) AS value FROM events")
def python_udf_remote(spark, sf):
    registry = Registry()
    registry.add("python_worker", "double", ("event_id bigint, value double", _double))
    operators = [{"kind": "udf_source", "name": "e"}, {"kind": "python_udf", "source": 0, "script_name": "double", "script_path": "double", "encode_fn": "", "decode_fn": "", "shutdown_fn": ""}]
    out = run(spark, operators, {"e": lambda s: table(s, sf, "events").select("event_id", "value")}, registry=registry)
    return out.select("event_id", r6(F.col("value")).alias("value"))


# --- the flagship ------------------------------------------------------------------------------

_FLAGSHIP = (
    _ASSIGN.format(window=86_400_000, budget=300).replace("SELECT event_id, class, CAST(CASE", ", p AS (SELECT event_id, class, CAST(CASE", 1).replace("), r AS", "),\nr AS").rstrip()
    + """), s AS (SELECT e.event_id, user_id, p.pipeline, lag(p.pipeline, 1) OVER o AS a, lag(p.pipeline, 2) OVER o AS b FROM p JOIN events e USING (event_id) WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, s.user_id AS user_id, pipeline, c_name FROM s JOIN customer ON c_custkey = s.user_id WHERE pipeline = a AND pipeline = b"""
)


@query(_FLAGSHIP)
def flagship(spark, sf):
    """Classify, assign within each day's budget, take the pipelines' branches, merge, find streaks of
    three equal pipelines of a user, and look the user up."""
    df = events(spark, sf).select("event_id", "user_id", "us", F.floor(F.col("ms") / 86_400_000).alias("window"), (F.col("value") > 250).cast("int").alias("class"))
    routed = assign.assign_windows(df, "window", "class", ARRIVAL, BUCKETS, F.lit(300.0), "greedy").withColumnRenamed("pipeline", routing.ROUTE)
    merged = routing.tagged(routed, {k: {"pipeline": F.lit(k)} for k in (0, 1, 2)})
    streaks = aggregates.streaks(merged, "user_id", "pipeline", ARRIVAL, 3)
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return joins.inner_build_right(streaks, users, ["user_id"]).select("event_id", "user_id", "pipeline", "c_name")
