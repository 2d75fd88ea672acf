"""Grouped aggregates, running and final, and the applications' windows.

Running forms follow an explicit order of arrival.  Final forms combine partial results before the
shuffle.  Null is a group of its own, and arrays may be keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.operators import ranges

BUILTIN = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def _builtin(op: str, field: str) -> Column:
    if op not in BUILTIN:
        raise CompileError(f"unknown aggregate {op!r}; there are {sorted(BUILTIN)}")
    return BUILTIN[op](F.col(f"`{field}`"))


def running(df: DataFrame, keys: list[str], op: str, field: str, order: list[str]) -> DataFrame:
    """One row for each input row: the keys and ``op(field)`` so far."""
    if not order:
        raise CompileError("a running aggregate needs an order of arrival")
    if op not in BUILTIN:
        raise CompileError(f"unknown aggregate {op!r}; there are {sorted(BUILTIN)}")
    value, parts = F.col(f"`{field}`"), ["sum", "count"] if op == "avg" else [op]
    made = ranges.running(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *order, field])]), keys, order, {f"_{p}": (p, value) for p in parts})
    result = F.col("_sum") / F.when(F.col("_count") > 0, F.col("_count")) if op == "avg" else F.col(f"_{op}")
    return made.select(*[F.col(f"`{k}`") for k in keys], result.alias(f"{op}({field})"))


def final(df: DataFrame, keys: list[str], op: str, field: str) -> DataFrame:
    return df.groupBy(*keys).agg(_builtin(op, field).alias(f"{op}({field})"))


def custom(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """Any function of a group's rows (a pandas frame): for what no built-in says."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def emit_when(df: DataFrame, keys: list[str], order: list[str], window_rows: int, should_emit: Callable[[Column], Column], decision_key: str) -> DataFrame:
    """Componentised windows with a row count as eviction: the last rows, whenever their keys say so.

    ``should_emit`` sees the array of decision keys in the window, oldest first.
    """
    columns = df.columns

    def held(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        last = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(window_rows - 1), 0)
        return df.withColumn("window", F.collect_list(F.struct(*columns)).over(last)).withColumn("_keys", F.collect_list(decision_key).over(last))

    return ranges.framed(df, keys, order, window_rows - 1, held).filter(should_emit(F.col("_keys"))).drop("_keys")


def componentized(df: DataFrame, keys: list[str], order: list[str], derive_decision_key: Callable, should_emit: Callable, derive_eviction_key: Callable, should_evict: Callable) -> DataFrame:
    """The general form: keys and decisions are Python functions of rows and lists of keys.

    Every arrival is appended; if ``should_emit(decision keys)`` the whole window is emitted, one row
    for each of its rows; then rows for which ``should_evict(eviction keys, place)`` leave.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("emission", T.LongType())])

    def fold(frame):
        import pandas as pd

        state, out, n = [], [], 0
        for row in frame.sort_values(order).to_dict("records"):
            state.append(row)
            if should_emit([derive_decision_key(r) for r in state]):
                out += [{**r, "emission": n} for r in state]
                n += 1
            evict = [derive_eviction_key(r) for r in state]
            state = [r for i, r in enumerate(state) if not should_evict(evict, i)]
        return pd.DataFrame(out, columns=schema.names)

    return df.groupBy(*keys).applyInPandas(fold, schema)


def streaks(df: DataFrame, key: str, label: str, order: list[str], length: int = 3) -> DataFrame:
    """Rows that end ``length`` equal labels in a row: key, label and ``streak_length``."""
    def marked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        own, same = Window.partitionBy(*keys).orderBy(*order), F.lit(True)
        for back in range(1, length):
            same = same & F.lag(label, back).over(own).eqNullSafe(F.col(label)) & (F.row_number().over(own) > back)
        return df.withColumn("_streak", same)

    return ranges.framed(df, [key], order, length - 1, marked).filter("_streak").select(key, label, F.lit(length).alias("streak_length"), *[c for c in order if c not in (key, label)])


def species_counts(df: DataFrame, class_col: str, time_ms: str, probability: str | None = None, expected: str | None = None, window_ms: int = 5000, max_items: int | None = 1000, tie: list[str] | None = None) -> DataFrame:
    """For each arrival, how many of its class came in the last ``window_ms``.

    ``count`` sums probabilities, or counts rows without them; ``expected_count`` is the greatest
    expected count in the window, if any is above 0.  With ``max_items`` only the newest that many
    rows of the window count.
    """
    weight = F.col(probability).cast("double") if probability else F.lit(1.0)
    top = F.col(expected) if expected and max_items is None else (F.col(expected) if expected else F.lit(None)).cast("int")
    rows = df.select(F.col(class_col).alias("class_id"), F.col(time_ms).alias("time_ms"), *(F.col(t) for t in tie or []), weight.alias("_weight"), top.alias("_expected"))
    totals = {"count": ("sum", F.col("_weight")), "_most": ("max", F.col("_expected"))}
    if max_items is None:
        # Rows of one time have one frame: a row for each time, met again by the rows.
        times = rows.groupBy("class_id", "time_ms").agg(F.sum("_weight").alias("_weight"), F.max("_expected").alias("_expected"))
        found = ranges.recent(times, ["class_id"], "time_ms", [], window_ms, totals)
        on = F.col("r.class_id").eqNullSafe(F.col("f.class_id")) & F.col("r.time_ms").eqNullSafe(F.col("f.time_ms"))
        met = rows.alias("r").join(found.alias("f"), on).select("r.class_id", "r.time_ms", *[F.col(f"r.`{t}`") for t in tie or []], "f.count", "f._most")
    else:
        met = _newest_counts(rows, tie or [], window_ms, max_items, totals if probability or expected else {})
    return met.select("class_id", "time_ms", *(tie or []), "count", F.when(F.col("_most") > 0, F.col("_most")).alias("expected_count"))


def _newest_counts(rows: DataFrame, tie: list[str], window_ms: int, max_items: int, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with totals over the newest ``max_items`` rows of the window; without any, rows are counted by their places.

    Both bounds end at the row itself, so the narrower frame holds: that in time where it begins within the newest rows.
    """
    placed = ranges.numbered(rows, ["class_id"], ["time_ms", *tie], "_place")
    timed = ranges.recent(placed, ["class_id"], "time_ms", ["_place"], window_ms, {**totals, "_start": ("min", F.col("_place"))})
    if not totals:
        n = F.least(F.col("_place") - F.col("_start") + 1, F.lit(max_items)).cast("double")
        return timed.withColumns({"count": n, "_most": F.lit(None).cast("int")})

    def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        last = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(max_items - 1), 0)
        capped = F.col("_place") - (max_items - 1) > F.col("_start")
        return df.withColumns({name: F.when(capped, ranges.TOTALS[op](c).over(last)).otherwise(F.col(name)) for name, (op, c) in totals.items()})

    return ranges.framed(timed, ["class_id"], ["_place"], max_items - 1, newest).withColumn("count", F.coalesce("count", F.lit(0.0)))


def complete_by_count(df: DataFrame, key: str, expected: str, *collected: Column) -> DataFrame:
    """Groups that have at least as many rows as the greatest ``expected`` among them (null: 0)."""
    grouped = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.max(F.coalesce(F.col(expected), F.lit(0))).alias("n_expected"), *collected)
    return grouped.filter("n_rows >= n_expected")
