"""Descriptors to DataFrames: one lazy frame for each operator, which Catalyst then plans as a whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import CompileError
from sluice.functions.expressions import Rules, compile_expression
from sluice.operators import aggregates, joins, models, relational, routing, vectors
from sluice.plans.ir import Operator, Query, load
from sluice.plans.registry import Registry


@dataclass
class Settings:
    """``order``: the order of arrival that order-sensitive operators follow.  ``now``: the time that
    ages are taken against, with ``created`` the column of creation times in nanoseconds."""

    order: list[str] = field(default_factory=list)
    now: str | None = None
    created: str = "time_created"
    #: Column of ticks, within which capacities of extra channels hold, and of event times, for evictions.
    tick: str | None = None
    event_time: str | None = None
    running: bool = True
    rules: Rules = Rules()
    #: Inner hash joins by key take no further predicate.
    inner_predicate: bool = False


class Compiler:
    def __init__(self, spark: SparkSession, registry: Registry, settings: Settings | None = None) -> None:
        self.spark, self.registry, self.settings = spark, registry, settings or Settings()

    def compile(self, query: str | dict | Query) -> dict[int, DataFrame]:
        """The frame of each operator; routers have their routed rows, ``__route`` included."""
        query = query if isinstance(query, Query) else load(query)
        frames: dict[int, DataFrame] = {}
        for op in query.operators:
            try:
                frames[op.id] = getattr(self, f"_{op.kind}")(op, frames, query)
            except CompileError as e:
                raise CompileError(f"operator {op.id} ({op.kind}): {e}") from None
        return frames

    def run(self, query: str | dict | Query) -> DataFrame:
        """The frame of the last operator."""
        query = query if isinstance(query, Query) else load(query)
        return self.compile(query)[query.last.id]

    def _expression(self, d: dict, df: DataFrame):
        return compile_expression(d, df.schema, self.registry, self.settings.rules)

    # --- operators -------------------------------------------------------------------------

    def _udf_source(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        return self.registry.find("source", op["name"])(self.spark)

    def _project(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        return relational.project(frames[op["source"]], op["fields"])

    def _filter(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        return relational.select_rows(frames[op["source"]], op["predicate"], self.registry, self.settings.rules)

    def _derive(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        return relational.derive(frames[op["source"]], op["new_field_name"], op["expression"], self.registry, self.settings.rules)

    def _union(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        return relational.union(frames[op["left"]], frames[op["right"]])

    def _predicate(self, d: dict, left: DataFrame, right: DataFrame):
        """A residual predicate over sides ``l`` and ``r``; fields of both sides mean the left one."""
        if d.get("kind") == "udf" and self.registry.has("join_filter", d["name"]):
            return self.registry.find("join_filter", d["name"])(left.alias("l"), right.alias("r"))
        columns = {c: F.col(f"r.`{c}`") for c in right.columns} | {c: F.col(f"l.`{c}`") for c in left.columns}
        schema = T.StructType([*left.schema.fields, *[f for f in right.schema.fields if f.name not in left.columns]])
        typed = compile_expression(d, schema, self.registry, self.settings.rules, columns)
        if typed.family != "bool":
            raise CompileError(f"a predicate must be boolean, not {typed.family}")
        return typed.column

    def _join(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        left, right, info = frames[op["left"]], frames[op["right"]], op["join_info"]
        kind = info.get("kind")
        if kind == "inner_build_right":
            on = self._predicate(op["predicate"], left, right) if self.settings.inner_predicate else None
            return joins.inner_build_right(left, right, info["fields"], on)
        if kind == "outer_build_right":
            return joins.outer_build_right(left, right, info["fields"], self._predicate(op["predicate"], left, right))
        if kind == "double_stream":
            return joins.double_stream(left, right, self._predicate(op["predicate"], left, right), within=self._eviction(info.get("eviction_policy")))
        raise CompileError(f"unknown join {kind!r}")

    def _eviction(self, policy: dict | None) -> tuple[str, float] | None:
        """What a named eviction policy leaves to be joined: a bound on the distance of event times."""
        if policy is None:
            return None
        if policy.get("kind") != "udf":
            raise CompileError("an eviction policy must be a named function")
        if self.settings.event_time is None:
            raise CompileError("an eviction policy needs a column of event times")
        return self.settings.event_time, self.registry.find("join_evict", policy["name"])

    def _group_by(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        df, aggregate = frames[op["source"]], op["aggregate"]
        for f in op["fields"]:
            if f not in df.columns:
                raise CompileError(f"no key {f!r}")
        kind = aggregate.get("kind")
        if kind == "builtin":
            if self.settings.running:
                return aggregates.running(df, op["fields"], aggregate["op"], aggregate["field"], self.settings.order)
            return aggregates.final(df, op["fields"], aggregate["op"], aggregate["field"])
        if kind == "udf":
            return self.registry.find("aggregate", aggregate["name"])(df, op["fields"], self.settings.order)
        raise CompileError(f"unknown aggregate {kind!r}")

    def _chroma_join(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        lookup, index, info = frames[op["lookup_stream"]], frames[op["index_stream"]], op["join_info"]
        vector = next((c for c in ("knowledge_base_embedding", "embedding") if c in index.columns), None)
        if vector is None:
            raise CompileError("the index stream has no embedding")
        normalise = True
        if "embedding" not in lookup.columns or lookup.schema["embedding"].dataType.simpleString() == "string":
            text = "embedding" if "embedding" in lookup.columns else "question"
            if text not in lookup.columns:
                raise CompileError("the lookup stream has neither an embedding nor a question")
            embed = self.registry.find("expression", "embed")
            lookup, normalise = lookup.withColumn("embedding", embed(F.col(text))), False
        id_col = next((c for c in ("id", "vec_id", "passage_id") if c in index.columns), index.columns[0])
        return vectors.vector_join(lookup, index, info.get("kind", "inner"), info.get("topk", 1), info.get("keep_n_matches", 1), op["distance_threshold"], op["metric"], id_col, vector, "passage" if "passage" in index.columns else None, "embedding", normalise)

    def _channel_router(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        df, expression = frames[op["source"]], op["route_expression"]
        if expression.get("kind") == "udf" and self.registry.has("routing", expression["name"]):
            return self.registry.find("routing", expression["name"])(df)
        typed = self._expression(expression, df)
        return routing.route(df, typed.column, typed.type)

    def _routes(self, op: Operator, query: Query) -> int:
        return len(op["routes"])

    def _aged(self, df: DataFrame, max_age) -> tuple[DataFrame, DataFrame | None]:
        s = self.settings
        if max_age is None or s.now is None:
            return df, None
        return routing.expire(df, s.created, F.col(s.now), int(max_age))

    def _channel_spout(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        router = query.operators[op["source"]]
        if op.id not in router["routes"]:
            backup = router.get("backup_route") or {}
            if backup.get("kind") == "custom" and backup.get("spout_position") == op.id:
                extra = routing.branch(frames[router.id], 0)
                room = backup.get("max_capacity")
                if room is None or self.settings.tick is None:
                    return extra
                return routing.within_capacity(extra, self.settings.tick, self.settings.order, int(room))
            raise CompileError(f"router {router.id} does not route here")
        return self._aged(routing.branch(frames[router.id], router["routes"].index(op.id) + 1), op.get("max_age_ns"))[0]

    def _merge(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        name = op.get("on_merge_fn")
        return routing.on_merge(frames[op["source"]], self.registry.find("merge_callback", name) if name else None)

    def _shed(self, spout: Operator, frames: dict, query: Query) -> list[DataFrame]:
        """Rows that routers forward to this spout past their branches, with set values."""
        out = []
        for router in query.operators:
            backup = router.get("backup_route") or {} if router.kind == "channel_router" else {}
            if backup.get("kind") != "forward_with_values" or backup.get("merge_spout_position") != spout.id:
                continue
            shed = [routing.branch(frames[router.id], 0)]
            for n, r in enumerate(router["routes"], 1):
                expired = self._aged(routing.branch(frames[router.id], n), query.operators[r].get("max_age_ns"))[1]
                if expired is not None:
                    shed.append(expired)
            values = {v["key"]: _constant(v.get("value")) for v in backup.get("values_to_set", [])}
            out += [routing.with_defaults(s, values) for s in shed]
        return out

    def _merge_spout(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        own = [frames[s] for s in op["sources"] if query.operators[s].kind == "merge"]
        df = routing.merge(*own)
        for shed in self._shed(op, frames, query):
            # Untyped nulls take the type that the branches give the field.
            shed = shed.withColumns({f.name: F.col(f"`{f.name}`").cast(df.schema[f.name].dataType) for f in shed.schema if f.dataType.simpleString() == "void" and f.name in df.columns})
            df = routing.merge(df, shed)
        return self._aged(df, op.get("max_age_ns"))[0]

    def _udf(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        return self.registry.find("flat_map", op["name"])(frames[op["source"]])

    def _codec(self, kind: str, name: str | None) -> Callable | None:
        return self.registry.find(kind, name) if name and self.registry.has(kind, name) else None

    def _python_udf(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        worker: tuple[str, Callable] = self.registry.find("python_worker", op["script_name"])
        codec = [self._codec(f"python_{k}", op.get(f"{k}_fn")) for k in ("encode", "decode", "shutdown")]
        return models.remote_python(frames[op["source"]], worker[1], worker[0], *codec)

    def _inline_python_script(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        encode, decode = op["encode_fn"], op["decode_fn"]
        outputs = decode["output_fields"]
        if self.registry.has("inline_python", op["function_name"]):
            function, kinds = self.registry.find("inline_python", op["function_name"])
        else:
            function, kinds = models.script_function(op.get("scripts_dir_path", "."), op["script_name"], op["function_name"]), None
        kinds = kinds or getattr(function, "types", None)
        if kinds is None or len(kinds) != len(outputs):
            raise CompileError(f"{op['function_name']!r} needs a type for each of {outputs}")
        codec = [self.registry.find(k, c["function_name"]) if c.get("kind") == "custom" else None for k, c in (("python_encode", encode), ("python_decode", decode))]
        called = models.coded(function, *codec) if any(codec) else function
        return models.inline_python(frames[op["source"]], called, encode["fields"], ", ".join(f"`{n}` {k}" for n, k in zip(outputs, kinds, strict=True)))

    def _onnx_inference(self, op: Operator, frames: dict, query: Query) -> DataFrame:
        path = op["model_path"]
        model = self.registry.find("model", path) if self.registry.has("model", path) else path
        return models.onnx_inference(frames[op["source"]], model, [a["buffer_field"] for a in op["args"]], [o["buffer_field"] for o in op["outputs"]])


def _constant(value):
    """A default value: null, a plain JSON value, or one tagged with its type."""
    if isinstance(value, dict) and len(value) == 1:
        value = next(iter(value.values()))
    return F.lit(value)
