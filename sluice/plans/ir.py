"""Query descriptors: a JSON list of operators, read into checked records.

Unknown keys are ignored.  Ids run from 0 without gaps; an operator reads only operators with smaller
ids; a merge sends to a merge spout with a larger one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from sluice.errors import CompileError

#: Keys that each kind needs (fixed values of the descriptor format).
REQUIRED = {
    "udf_source": ["name"],
    "project": ["source", "fields"],
    "filter": ["source", "predicate"],
    "derive": ["source", "new_field_name", "expression"],
    "join": ["left", "right", "predicate", "join_info"],
    "union": ["left", "right"],
    "group_by": ["source", "fields", "aggregate"],
    "chroma_join": ["index_stream", "lookup_stream", "metric", "distance_threshold", "join_info"],
    "channel_router": ["source", "routes", "route_expression"],
    "channel_spout": ["source"],
    "merge": ["source", "parent"],
    "merge_spout": ["sources"],
    "udf": ["source", "name"],
    "python_udf": ["source", "script_name"],
    "inline_python_script": ["source", "script_name", "function_name", "encode_fn", "decode_fn"],
    "onnx_inference": ["source", "model_path", "args", "outputs"],
}
#: Keys that name operators read from.
READS = {"join": ["left", "right"], "union": ["left", "right"], "chroma_join": ["index_stream", "lookup_stream"], "merge_spout": ["sources"], "udf_source": []}


@dataclass(frozen=True)
class Operator:
    id: int
    kind: str
    params: dict[str, Any] = field(hash=False)

    def __getitem__(self, key: str) -> Any:
        return self.params[key]

    def get(self, key: str, default: Any = None) -> Any:
        return self.params.get(key, default)

    @property
    def sources(self) -> list[int]:
        out: list[int] = []
        for key in READS.get(self.kind, ["source"]):
            value = self.params[key]
            out += value if isinstance(value, list) else [value]
        return out


@dataclass(frozen=True)
class Query:
    name: str
    description: str
    sql_form: str
    operators: tuple[Operator, ...]

    @property
    def last(self) -> Operator:
        return self.operators[-1]


def load(query: str | dict) -> Query:
    """A descriptor (JSON text or its dict) as a checked query."""
    try:
        raw = json.loads(query) if isinstance(query, str) else query
    except ValueError as e:
        raise CompileError(f"not JSON: {e}") from None
    if not isinstance(raw, dict) or not isinstance(raw.get("operators"), list) or not raw["operators"]:
        raise CompileError("a query needs a list of operators")
    operators = []
    for o in sorted(raw["operators"], key=lambda o: o.get("id", -1)):
        kind = o.get("kind")
        if kind not in REQUIRED:
            raise CompileError(f"unknown operator kind {kind!r}")
        missing = [k for k in REQUIRED[kind] if k not in o]
        if missing:
            raise CompileError(f"operator {o.get('id')} ({kind}) lacks {missing}")
        operators.append(Operator(o.get("id", -1), kind, o))
    _check(operators)
    return Query(str(raw.get("name", "")), str(raw.get("description", "")), str(raw.get("sql_form", "")), tuple(operators))


def _check(operators: list[Operator]) -> None:
    ids = [o.id for o in operators]
    if ids != list(range(len(ids))):
        raise CompileError(f"ids must run from 0 without gaps; found {ids}")
    for o in operators:
        for s in o.sources:
            if not isinstance(s, int) or not 0 <= s < o.id:
                raise CompileError(f"operator {o.id} ({o.kind}) reads {s}, which does not come before it")
        if o.kind == "merge":
            parent = o["parent"]
            if not o.id < parent < len(operators) or operators[parent].kind != "merge_spout":
                raise CompileError(f"merge {o.id} must send to a later merge spout, not to {parent}")
        if o.kind == "channel_router":
            for r in o["routes"]:
                if not o.id < r < len(operators) or operators[r].kind != "channel_spout":
                    raise CompileError(f"router {o.id} must route to later channel spouts, not to {r}")
        if o.kind == "channel_spout" and operators[o["source"]].kind != "channel_router":
            raise CompileError(f"channel spout {o.id} must read a router")
        if o.kind == "merge_spout":
            for s in o.sources:
                if operators[s].kind not in ("merge", "channel_router"):
                    raise CompileError(f"merge spout {o.id} must read merges, not {operators[s].kind}")
