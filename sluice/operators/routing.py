"""Routers and merges: the route is a column, a branch is a filter on it, a merge is a union.

Route 0 is the backup (by default it drops), negative routes are dropped, and routes past the last
branch are lost.  The rows of a branch are read from the routed rows again, so a costly input should be
cached by the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import CompileError
from sluice.operators import ranges

ROUTE = "__route"


def route(df: DataFrame, expression: Column, kind: T.DataType | None = None) -> DataFrame:
    """``df`` with its route; only integers route, anything else is lost."""
    if kind is not None and not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(ROUTE, F.lit(None).cast("int"))
    return df.withColumn(ROUTE, expression.cast("int"))


def branch(routed: DataFrame, number: int) -> DataFrame:
    """The rows of a pipe: 0 is the backup, 1 the first route."""
    return routed.filter(F.col(ROUTE) == number).drop(ROUTE)


def lost(routed: DataFrame, routes: int) -> DataFrame:
    return routed.filter(F.col(ROUTE).isNull() | (F.col(ROUTE) < 0) | (F.col(ROUTE) > routes)).drop(ROUTE)


def with_defaults(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Fields are set only where the branch does not have them."""
    return df.withColumns({k: v for k, v in values.items() if k not in df.columns})


def merge(*branches: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def tagged(routed: DataFrame, values: dict[int, dict[str, Column]]) -> DataFrame:
    """Branches that only set values, merged again: one pass over the routed rows, however many branches.

    ``values`` names the branches that are kept and what each sets; fields that a branch does not set
    keep their value, or are null if the rows lack them.
    """
    kept = routed.filter(F.col(ROUTE).isin(*values))
    made = {}
    for name in dict.fromkeys(n for own in values.values() for n in own):
        value = F.col(f"`{name}`") if name in routed.columns else F.lit(None)
        for k, own in values.items():
            if name in own:
                value = F.when(F.col(ROUTE) == k, own[name]).otherwise(value)
        made[name] = value
    return kept.withColumns(made).drop(ROUTE)


def expire(df: DataFrame, created: str, now: Column, max_age: int) -> tuple[DataFrame, DataFrame]:
    """(rows of at most that age, older ones, which go to the backup)."""
    old = now - F.col(created) > max_age
    return df.filter(~old), df.filter(old)


def overflow(df: DataFrame, pipe: str, tick: str, order: list[str], capacity: int) -> DataFrame:
    """Rows beyond a pipe's capacity within a tick get route 0."""
    nth = F.row_number().over(Window.partitionBy(pipe, tick).orderBy(*order))
    return df.withColumn(ROUTE, F.when(nth <= capacity, F.col(pipe)).otherwise(0))


def within_capacity(df: DataFrame, tick: str, order: list[str], capacity: int) -> DataFrame:
    """The rows of a channel that it has room for within a tick; later ones are lost."""
    if not order:
        raise CompileError("a channel's capacity needs an order of arrival")
    nth = F.row_number().over(Window.partitionBy(tick).orderBy(*order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= capacity).drop("_nth")


def dedup_feedback(df: DataFrame, id_col: str, pipeline: str) -> DataFrame:
    """One outcome for each routed id and pipeline."""
    return df.dropDuplicates([id_col, pipeline])


def reroute_zero(pipe: Column, option: str, draw: Column, routes: int) -> Column:
    """What becomes of dropped rows: ignore, first (pipe 1) or random."""
    if option == "ignore":
        return pipe
    if option == "first":
        return F.when(pipe == 0, 1).otherwise(pipe)
    if option == "random":
        return F.when(pipe == 0, (F.floor(draw * routes) + 1).cast("int")).otherwise(pipe)
    raise CompileError(f"unknown option {option!r}")


# --- strategies ------------------------------------------------------------------------------


def draw(id_col: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that the id and the seed decide, the same in any engine."""
    return F.pmod(id_col.cast("long") * 7919 + 104729 + seed * 15485863, F.lit(100003)) / F.lit(100003.0)


def static(k: int) -> Column:
    return F.lit(k)


def money_spent(df: DataFrame, keys: list[str], order: list[str], cost: str, name: str = "spent", further: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Money spent so far: amounts of up to 12 decimals are summed exactly, so that a budget spent to the cent
    is not overdrawn by the order of additions; other doubles (finer, from 1e15, not finite) are added as such.

    ``further`` running totals are taken in the same pass.
    """
    value = F.col(f"`{cost}`")
    exact = value.try_cast("decimal(27, 12)")
    fits = exact.cast("double") == value
    totals = {"_amounts": ("sum", F.when(fits, exact)), "_others": ("sum", F.when(fits, None).otherwise(value)), **(further or {})}
    amounts, others = F.col("_amounts").cast("double"), F.col("_others")
    return ranges.running(df, keys, order, totals).withColumn(name, F.coalesce(amounts + others, amounts, others)).drop("_amounts", "_others")


def money_guard(spent: Column, budget: Column, k: int) -> Column:
    """Pipe ``k`` while money is left."""
    return F.when(budget - spent < 0, 0).otherwise(k)


def too_old(age_ms: Column, deadline_ms: int, otherwise: Column) -> Column:
    return F.when(age_ms > deadline_ms, 0).otherwise(otherwise)


def weighted(draw_: Column, weights: list[Column]) -> Column:
    """A pipe from 1 with probability by weight; 0 if no weight is left."""
    total = reduce(lambda a, b: a + b, weights)
    out, so_far = F.when(total <= 0, 0), F.lit(0.0)
    for k, w in enumerate(weights, 1):
        so_far = so_far + w
        out = out.when(draw_ * total < so_far, k)
    return out.otherwise(len(weights))


def eddies(df: DataFrame, tick: str, id_col: str, order: list[str], draw_: Column, capacities: list[int], drained: int) -> DataFrame:
    """Queue-weighted routing: the freer a pipe, the likelier.

    A pipe's length within a tick is what was assigned before in that tick less ``drained`` for each
    earlier row.  As a row's route feeds the next weights, rows are folded in order: ticks are dealt to
    tasks and sorted there, ids and draws go through Arrow batches, and only the pipes' lengths are held.
    Routes meet their rows by ``id_col``, which must tell rows apart; null ids are lost.
    """
    slim = df.select(F.col(tick).alias("_tick"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(id_col).alias("_id"), draw_.cast("double").alias("_draw"))
    dealt = slim.repartition("_tick").sortWithinPartitions("_tick", *[f"_o{i}" for i in range(len(order))]).select(F.xxhash64("_tick").alias("_t"), "_id", "_draw")

    def run(frames):
        import pandas as pd

        tick_now, length = None, [0.0] * len(capacities)
        for frame in frames:
            out = []
            for t, u in zip(frame["_t"], frame["_draw"], strict=True):
                if t != tick_now:
                    tick_now, length = t, [0.0] * len(capacities)
                length = [max(v - drained, 0.0) for v in length]
                free = [max(1.0 - v / c, 0.0) for v, c in zip(length, capacities, strict=True)]
                pipe, so_far, total = 0, 0.0, sum(free)
                if total > 0:
                    pipe = len(free)
                    for k, w in enumerate(free, 1):
                        so_far += w
                        if u * total < so_far:
                            pipe = k
                            break
                    length[pipe - 1] += 1
                out.append(pipe)
            yield pd.DataFrame({"_id": frame["_id"], ROUTE: out})

    routes = dealt.mapInPandas(run, f"_id {dict(df.dtypes)[id_col]}, {ROUTE} int")
    return df.join(routes.withColumnRenamed("_id", id_col), id_col).select(*df.columns, ROUTE)


def random_order(draw_: Column, accepts: list[Column]) -> Column:
    """The first pipe that accepts, in an order that the draw picks; 0 if none does."""
    n = len(accepts)
    out = F.lit(0)
    for back in range(n - 1, -1, -1):
        turn = F.pmod(F.floor(draw_ * n) + back, F.lit(n))
        for k in range(n):
            out = F.when((turn == k) & accepts[k], k + 1).otherwise(out)
    return out


def half_and_half(draw_: Column, free_first: Column, free_second: Column) -> Column:
    """One of two pipes at even odds, the other one if it is full, 0 if both are."""
    first = draw_ < 0.5
    return F.when(first & free_first, 1).when(~first & free_second, 2).when(free_first, 1).when(free_second, 2).otherwise(0)


def cost_share_weights(recent_costs: list[Column], floor: float = 0.00045) -> list[Column]:
    """Weight of each pipe: 1 less its share of recent costs, each with a floor."""
    costs = [c + floor for c in recent_costs]
    total = reduce(lambda a, b: a + b, costs)
    return [1 - c / total for c in costs]


def static_with_overflow(df: DataFrame, k: int, age_ms: Column, deadline_ms: int, tick: str, order: list[str], capacity: int) -> DataFrame:
    """Pipe ``k`` for rows in time, as far as it has room in their tick; too old rows and the others drop."""
    aged = df.withColumn("_pipe", too_old(age_ms, deadline_ms, F.lit(k)))
    return overflow(aged, "_pipe", tick, order, capacity).drop("_pipe")


def noop_counter(df: DataFrame, name: str = "rows"):
    """The same rows, and an observation that holds their count after an action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def blocking_noop(df: DataFrame, seconds: float) -> DataFrame:
    """The same rows, each held back for a fixed time."""

    def run(batches):
        import time

        for batch in batches:
            time.sleep(seconds * batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def on_merge(df: DataFrame, callback: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return callback(df) if callback else df
