import json

import pytest
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.functions.expressions import Rules, compile_expression, returning
from sluice.plans.compiler import Compiler, Settings
from sluice.plans.ir import load
from sluice.plans.registry import Registry


def query(*operators):
    return json.dumps({"name": "q", "description": "", "sql_form": "", "extra": 1, "operators": [{"id": i, "unused_outputs": [], **o} for i, o in enumerate(operators)]})


SOURCE = {"kind": "udf_source", "name": "table1"}
INT = lambda v: {"kind": "literal", "type": "int", "value": v}
FIELD = lambda n: {"kind": "field", "name": n}


@pytest.mark.parametrize(
    ("operators", "message"),
    [
        ([{"kind": "sort", "source": 0}], "unknown operator kind"),
        ([SOURCE, {"kind": "project", "source": 0}], "lacks"),
        ([SOURCE, {"kind": "project", "source": 1, "fields": []}], "does not come before"),
        ([SOURCE, {"kind": "merge", "source": 0, "parent": 0}], "later merge spout"),
        ([SOURCE, {"kind": "channel_spout", "source": 0}], "must read a router"),
        ([SOURCE, {"kind": "channel_router", "source": 0, "route_expression": INT(1), "routes": [7]}], "later channel spouts"),
        ([SOURCE, {"kind": "merge_spout", "sources": [0]}], "must read merges"),
    ],
)
def test_bad_descriptors(operators, message):
    with pytest.raises(CompileError, match=message):
        load(query(*operators))


def test_ids_and_text():
    with pytest.raises(CompileError, match="without gaps"):
        load({"operators": [{"id": 1, **SOURCE}]})
    with pytest.raises(CompileError, match="not JSON"):
        load("{")
    with pytest.raises(CompileError, match="needs a list"):
        load({"operators": []})
    out_of_order = load({"operators": [{"id": 1, "kind": "project", "source": 0, "fields": ["a"]}, {"id": 0, **SOURCE}]})
    assert [o.kind for o in out_of_order.operators] == ["udf_source", "project"]


def test_registry():
    registry = Registry()
    registry.add("source", "a", lambda s: None)
    with pytest.raises(CompileError, match="already"):
        registry.add("filter", "a", None)
    with pytest.raises(CompileError, match="of kind source"):
        registry.find("filter", "a")
    with pytest.raises(CompileError, match="no function"):
        registry.find("filter", "b")
    with pytest.raises(CompileError, match="unknown kind"):
        registry.add("other", "c", None)


def evaluate(spark, d, rules=Rules(), registry=None):
    df = spark.createDataFrame([(7, 2, 7.5, -2.0, True, "a", None)], "i int, j int, x double, y double, b boolean, s string, n int")
    typed = compile_expression(d, df.schema, registry, rules)
    return df.select(typed.column.alias("v")).first()["v"]


def op(o, a, b):
    return {"kind": "binary", "op": o, "left": a, "right": b}


def test_arithmetic(spark):
    i, j, x, y = map(FIELD, "ijxy")
    assert evaluate(spark, op("/", i, j)) == 3
    assert evaluate(spark, op("/", {"kind": "unary", "op": "-", "expr": i}, j)) == -3
    assert evaluate(spark, op("%", {"kind": "unary", "op": "-", "expr": i}, j)) == -1
    assert evaluate(spark, op("/", x, y)) == -3.75
    zero = {"kind": "literal", "type": "float", "value": 0.0}
    assert evaluate(spark, op("/", x, zero)) == float("inf")
    assert evaluate(spark, op("/", y, zero)) == float("-inf")
    nan = evaluate(spark, op("/", zero, zero))
    assert nan != nan
    nan = evaluate(spark, op("%", x, zero))
    assert nan != nan
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        evaluate(spark, op("/", i, INT(0)))
    with pytest.raises(Exception, match="OVERFLOW"):
        evaluate(spark, op("*", op("*", i, INT(1 << 30)), INT(4)))


def test_logic_and_types(spark):
    b, true = FIELD("b"), {"kind": "literal", "type": "bool", "value": True}
    assert evaluate(spark, op("^", b, true)) is False
    assert evaluate(spark, op("&", b, true)) is True
    assert evaluate(spark, {"kind": "ternary", "cond": b, "left": FIELD("i"), "right": INT(1)}) == 7
    assert evaluate(spark, op("+", FIELD("n"), INT(1))) is None
    for bad in (op("+", FIELD("i"), FIELD("x")), op("&", FIELD("i"), FIELD("j")), op("+", FIELD("s"), FIELD("s")), {"kind": "unary", "op": "!", "expr": FIELD("i")}, FIELD("absent"), {"kind": "literal", "type": "int", "value": 1 << 31}, {"kind": "other"}, op("?", FIELD("i"), FIELD("j")), {"kind": "ternary", "cond": FIELD("i"), "left": b, "right": b}, {"kind": "ternary", "cond": b, "left": FIELD("i"), "right": FIELD("s")}):
        with pytest.raises(CompileError):
            evaluate(spark, bad)
    assert evaluate(spark, op("=", FIELD("s"), {"kind": "literal", "type": "string", "value": "a"})) is True
    with pytest.raises(CompileError):
        evaluate(spark, op("=", FIELD("s"), FIELD("s")), Rules(extended=False))
    with pytest.raises(Exception, match="null in an expression"):
        evaluate(spark, op("+", FIELD("n"), INT(1)), Rules(strict=True))
    assert evaluate(spark, op("+", FIELD("i"), INT(1)), Rules(strict=True)) == 8


@pytest.fixture
def registry(spark):
    r = Registry()
    r.add("source", "table1", lambda s: s.createDataFrame([(1, 2, 4), (2, 3, 4), (3, 4, 5), (0, 9, 4)], "field1 int, field2 int, field3 int"))
    r.add("source", "people", lambda s: s.createDataFrame([(1, "ann"), (2, "bob"), (None, "nil")], "patient_id int, name string"))
    r.add("source", "visits", lambda s: s.createDataFrame([(1, "mon", "x"), (1, "tue", "y"), (None, "wed", "z")], "patient_id int, last_accessed string, name string"))
    return r


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filter_and_derive(spark, registry):
    q = query(SOURCE, {"kind": "filter", "source": 0, "predicate": op("=", FIELD("field3"), INT(4))}, {"kind": "derive", "source": 1, "new_field_name": "d", "expression": op("+", FIELD("field1"), op("*", FIELD("field2"), INT(5)))})
    assert rows(Compiler(spark, registry).run(q)) == [(0, 9, 4, 45), (1, 2, 4, 11), (2, 3, 4, 17)]
    with pytest.raises(CompileError, match="operator 1 .filter."):
        Compiler(spark, registry).run(query(SOURCE, {"kind": "filter", "source": 0, "predicate": FIELD("field1")}))


def test_projection_keeps_internal_fields(spark, registry):
    registry.add("source", "t", lambda s: s.createDataFrame([(1, 2, 3)], "a int, __uuid int, time_created int"))
    out = Compiler(spark, registry).run(query({"kind": "udf_source", "name": "t"}, {"kind": "project", "source": 0, "fields": ["a", "gone"]}))
    assert out.columns == ["a", "__uuid"]


def test_joins(spark, registry):
    def join(kind, predicate, **settings):
        q = query({"kind": "udf_source", "name": "people"}, {"kind": "udf_source", "name": "visits"}, {"kind": "join", "left": 0, "right": 1, "predicate": predicate, "join_info": {"kind": kind, "fields": ["patient_id"]}})
        return rows(Compiler(spark, registry, Settings(**settings)).run(q))

    yes = {"kind": "literal", "type": "bool", "value": True}
    tue = op("=", FIELD("last_accessed"), {"kind": "literal", "type": "string", "value": "tue"})
    assert join("inner_build_right", yes) == [(1, "ann", "mon"), (1, "ann", "tue"), (None, "nil", "wed")]
    assert join("inner_build_right", tue) == join("inner_build_right", yes)
    assert join("inner_build_right", tue, inner_predicate=True) == [(1, "ann", "tue")]
    assert join("outer_build_right", tue) == [(1, "ann", "tue"), (2, "bob", None), (None, "nil", None)]
    with pytest.raises(CompileError, match="unknown join"):
        join("full", yes)
    theta = query({"kind": "udf_source", "name": "people"}, {"kind": "udf_source", "name": "table1"}, {"kind": "join", "left": 0, "right": 1, "predicate": op("<", FIELD("patient_id"), FIELD("field1")), "join_info": {"kind": "double_stream"}})
    assert len(Compiler(spark, registry).run(theta).collect()) == 3


def test_join_keys_are_typed(spark, registry):
    registry.add("source", "wide", lambda s: s.createDataFrame([(1,)], "patient_id bigint"))
    q = query({"kind": "udf_source", "name": "people"}, {"kind": "udf_source", "name": "wide"}, {"kind": "join", "left": 0, "right": 1, "predicate": INT(1), "join_info": {"kind": "inner_build_right", "fields": ["patient_id"]}})
    with pytest.raises(CompileError, match="is int on the left and bigint"):
        Compiler(spark, registry).run(q)


def test_running_sum_needs_an_order(spark, registry):
    q = query(SOURCE, {"kind": "group_by", "source": 0, "fields": ["field3"], "aggregate": {"kind": "builtin", "op": "sum", "field": "field1"}})
    with pytest.raises(CompileError, match="order of arrival"):
        Compiler(spark, registry).run(q)
    out = Compiler(spark, registry, Settings(order=["field2"])).run(q)
    assert out.columns == ["field3", "sum(field1)"] and rows(out) == [(4, 1), (4, 3), (4, 3), (5, 3)]
    final = Compiler(spark, registry, Settings(running=False)).run(q)
    assert rows(final) == [(4, 3), (5, 3)]


def routed(backup=None, route=None, **spout):
    return query(
        SOURCE,
        {"kind": "channel_router", "source": 0, "route_expression": route or FIELD("field1"), "routes": [2, 5], **({"backup_route": backup} if backup else {})},
        {"kind": "channel_spout", "source": 1, "timeout": 1, **spout},
        {"kind": "derive", "source": 2, "new_field_name": "b", "expression": {"kind": "literal", "type": "string", "value": "one"}},
        {"kind": "merge", "source": 3, "parent": 8},
        {"kind": "channel_spout", "source": 1, "timeout": 1},
        {"kind": "derive", "source": 5, "new_field_name": "b", "expression": {"kind": "literal", "type": "string", "value": "two"}},
        {"kind": "merge", "source": 6, "parent": 8},
        {"kind": "merge_spout", "sources": [4, 7], "timeout": 1},
    )


def test_router(spark, registry):
    assert rows(Compiler(spark, registry).run(routed())) == [(1, 2, 4, "one"), (2, 3, 4, "two")]
    values = {"kind": "forward_with_values", "merge_spout_position": 8, "values_to_set": [{"key": "b", "value": None}, {"key": "field2", "value": {"Integer": 0}}]}
    assert rows(Compiler(spark, registry).run(routed(values))) == [(0, 9, 4, None), (1, 2, 4, "one"), (2, 3, 4, "two")]
    assert rows(Compiler(spark, registry).run(routed(route={"kind": "literal", "type": "float", "value": 1.0}))) == []


def test_expired_rows_go_to_the_backup(spark, registry):
    registry.functions["source"]["table1"] = lambda s: s.createDataFrame([(1, 10, 100), (1, 95, 100), (2, 10, 100)], "field1 int, time_created int, now int")
    values = {"kind": "forward_with_values", "merge_spout_position": 8, "values_to_set": [{"key": "b", "value": None}]}
    settings = Settings(now="now")
    assert rows(Compiler(spark, registry, settings).run(routed(values, max_age_ns=20))) == [(1, 10, 100, None), (1, 95, 100, "one"), (2, 10, 100, "two")]
    assert rows(Compiler(spark, registry, settings).run(routed(max_age_ns=20))) == [(1, 95, 100, "one"), (2, 10, 100, "two")]


def test_custom_backup_is_a_branch(spark, registry):
    q = json.loads(routed({"kind": "custom", "max_capacity": 10, "spout_position": 9}))
    q["operators"].append({"id": 9, "kind": "channel_spout", "source": 1, "timeout": 1})
    assert rows(Compiler(spark, registry).run(q)) == [(0, 9, 4)]


def test_functions_by_kind(spark, registry):
    registry.add("filter", "big", lambda df: F.col("field2") > 3)
    registry.add("flat_map", "twice", lambda df: df.unionByName(df))
    registry.add("expression", "half", returning("double")(lambda c: c / 2))
    registry.add("routing", "all_one", lambda df: df.withColumn("__route", F.lit(1)))
    q = query(SOURCE, {"kind": "filter", "source": 0, "predicate": {"kind": "udf", "name": "big", "args": []}}, {"kind": "udf", "source": 1, "name": "twice"}, {"kind": "derive", "source": 2, "new_field_name": "h", "expression": op("+", {"kind": "udf", "name": "half", "args": [FIELD("field2")]}, {"kind": "literal", "type": "float", "value": 1})})
    assert rows(Compiler(spark, registry).run(q)) == [(0, 9, 4, 5.5), (0, 9, 4, 5.5), (3, 4, 5, 3.0), (3, 4, 5, 3.0)]


def test_vector_join_of_texts(spark, registry):
    from sluice.operators.models import hash_embedding

    registry.add("expression", "embed", returning("array<double>")(lambda c: hash_embedding(c, 512)))
    registry.add("source", "questions", lambda s: s.createDataFrame([(1, "red fox"), (2, "zzz")], "q int, question string"))
    registry.add("source", "passages", lambda s: s.createDataFrame([(10, "the red fox"), (11, "blue whale")], "id int, passage string"))
    join = {"kind": "chroma_join", "lookup_stream": 0, "index_stream": 2, "metric": "euclidean", "url": "", "collection": "", "distance_threshold": 1.0, "join_info": {"kind": "inner", "topk": 5, "keep_n_matches": 5}}
    q = query({"kind": "udf_source", "name": "questions"}, {"kind": "udf_source", "name": "passages"}, {"kind": "derive", "source": 1, "new_field_name": "knowledge_base_embedding", "expression": {"kind": "udf", "name": "embed", "args": [FIELD("passage")]}}, join)
    out = {r["q"]: (r["match_ids"], r["passages"]) for r in Compiler(spark, registry).run(q).collect()}
    assert out[1] == (["10"], ["the red fox"]) and out[2] == ([], [])
