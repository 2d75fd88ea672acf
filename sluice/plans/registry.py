"""Named functions that queries refer to, by kind.

Prefer native builders (functions of Columns), which Catalyst can move and fuse; Python functions are
wrapped only where nothing else is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from sluice.errors import CompileError

#: Kinds of functions and how each is called.
KINDS = {
    "source": "spark -> DataFrame",
    "filter": "DataFrame -> boolean Column",
    "join_filter": "(left DataFrame, right DataFrame) -> boolean Column",
    "join_evict": "a bound on the distance of event times",
    "expression": "(Columns...) -> Column",
    "merge_callback": "DataFrame -> DataFrame",
    "aggregate": "(DataFrame, keys, order) -> DataFrame",
    "routing": "DataFrame -> DataFrame with the route column",
    "flat_map": "DataFrame -> DataFrame",
    "python_worker": "(schema, function over pandas batches)",
    "inline_python": "(function of values, types of results)",
    "python_encode": "values (inline) or row (worker) -> arguments",
    "python_decode": "value (inline) or row and value (worker) -> fields",
    "python_shutdown": "() -> nothing, when a task's rows are through",
    "model": "path of a model or a function of arrays",
}


@dataclass
class Registry:
    functions: dict[str, dict[str, Any]] = field(default_factory=lambda: {k: {} for k in KINDS})

    def add(self, kind: str, name: str, function: Any) -> Any:
        if kind not in KINDS:
            raise CompileError(f"unknown kind of function {kind!r}")
        for other, names in self.functions.items():
            if name in names:
                raise CompileError(f"{name!r} is registered already, as {other}")
        self.functions[kind][name] = function
        return function

    def register(self, kind: str, name: str) -> Callable:
        return lambda f: self.add(kind, name, f)

    def find(self, kind: str, name: str) -> Any:
        if name in self.functions[kind]:
            return self.functions[kind][name]
        for other, names in self.functions.items():
            if name in names:
                raise CompileError(f"{name!r} is a function of kind {other}, not {kind}")
        raise CompileError(f"no function {name!r} of kind {kind}")

    def has(self, kind: str, name: str) -> bool:
        return name in self.functions[kind]

    def copy(self) -> Registry:
        return Registry({k: dict(v) for k, v in self.functions.items()})
