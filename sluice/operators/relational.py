"""Projection, selection, derivation, flat maps, unions, repeats and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import CompileError
from sluice.functions.expressions import Rules, compile_expression
from sluice.operators import ranges
from sluice.plans.registry import Registry

#: Fields that a projection keeps unasked (fixed values).
INTERNAL = ("__uuid", "__provenance", "__tuple_uuid__")


def project(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """The listed fields that exist, and the internal ones, in the order of the input."""
    keep = set(fields) | set(INTERNAL)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])


def select_rows(df: DataFrame, predicate: dict | Column, registry: Registry | None = None, rules: Rules = Rules()) -> DataFrame:
    if isinstance(predicate, Column):
        return df.filter(predicate)
    if predicate.get("kind") == "udf" and registry is not None and registry.has("filter", predicate["name"]):
        return df.filter(registry.find("filter", predicate["name"])(df))
    typed = compile_expression(predicate, df.schema, registry, rules)
    if typed.family != "bool":
        raise CompileError(f"a predicate must be boolean, not {typed.family}")
    return df.filter(typed.column)


def derive(df: DataFrame, name: str, expression: dict | Column, registry: Registry | None = None, rules: Rules = Rules()) -> DataFrame:
    """Add or overwrite a field."""
    if isinstance(expression, dict):
        expression = compile_expression(expression, df.schema, registry, rules).column
    return df.withColumn(name, expression)


def flat_map(df: DataFrame, rows: Column | Callable, schema: str | T.StructType | None = None, on_error: str = "skip", keep: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Each row to any number of rows.

    A Column holds an array of structs, or with ``name`` of the values of that field, and stays native;
    fields in ``keep`` come along once for each value.  A function takes a dict and gives dicts; it
    runs over Arrow batches, and a row on which it raises is skipped (``on_error="raise"``: it fails).
    """
    if isinstance(rows, Column):
        kept = [F.col(f"`{c}`") for c in keep or []]
        if name is not None:
            return df.select(*kept, F.explode(rows).alias(name))
        return df.select(*kept, F.explode(rows).alias("_out")).select(*kept, "_out.*")

    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out += list(rows(row))
                except Exception:
                    if on_error == "raise":
                        raise
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names)

    return df.mapInPandas(run, schema)


def union(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs; fields that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b.select(*a.columns))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(*a.columns))


def take(df: DataFrame, order: list[str], n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` in an order."""
    return df.orderBy(*order).offset(skip).limit(n)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, nth).filter(F.col(rank) <= k)


def repeat(df: DataFrame, cycles: int, cycle: str = "cycle", order: list[str] | None = None, total: int | None = None) -> DataFrame:
    """Each row once a cycle, at most ``total`` rows in order of cycle and ``order``.  Endless repetition exists in streams only."""
    if cycles < 0:
        raise CompileError("cycles must not be negative")
    out = df.withColumn(cycle, F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)) if cycles else F.array().cast("array<int>")))
    if total is None:
        return out
    if not order:
        raise CompileError("a total needs an order of arrival")
    return positions(out, [cycle, *order], "_position").filter(F.col("_position") < total).drop("_position")


def log_output(df: DataFrame, order: list[str], max_items: int | None = None, name: str = "output_number") -> DataFrame:
    """Output rows numbered from 1 in an order; it stops at ``max_items``."""
    numbered = positions(df, order, name).withColumn(name, F.col(name) + 1)
    return numbered if max_items is None else numbered.filter(F.col(name) <= max_items)


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Gapless places from 0 in a total order: rows are dealt to ranges of it, once, and only a range is sorted by a task."""
    return ranges.numbered(df, [], order, name)


def chunk_by_count(df: DataFrame, keys: list[str], order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Number chunks of ``size`` rows within keys, the last one possibly shorter."""
    return ranges.numbered(df, keys, order, name).withColumn(name, F.floor(F.col(name) / size).cast("long"))


def chunk_by_time(df: DataFrame, keys: list[str], time_ms: str, size: int, timeout_ms: int, name: str = "chunk") -> DataFrame:
    """Chunks that end at ``size`` rows, or ``timeout_ms`` after their first row.

    The end of a chunk depends on where it began, so arrivals are folded in order; each key's rows are
    read once, in Arrow batches.  Without keys all rows would be one task's, so keys are required; a
    whole stream is chunked by a column of time buckets, which end chunks.
    """
    if not keys:
        raise CompileError("chunks by time need keys, or a bucket of time as one")
    kind = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(frames):
        import numpy as np

        state = None
        for frame in frames:
            if not len(frame):
                continue
            times, out = frame[time_ms].to_numpy(), np.empty(len(frame), np.int64)
            groups = list(frame[keys].itertuples(index=False, name=None))
            for i, (t, g) in enumerate(zip(times, groups, strict=True)):
                if state is None or state[0] != g:
                    state = [g, 0, t, 0]
                elif state[3] >= size or t - state[2] >= timeout_ms:
                    state = [g, state[1] + 1, t, 0]
                state[3] += 1
                out[i] = state[1]
            yield frame.assign(**{name: out})

    return df.repartition(*keys).sortWithinPartitions(*keys, time_ms).mapInPandas(run, kind)
