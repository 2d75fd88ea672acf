"""A router's history as windows over its outcome log, and the forecast made from it.

The log has one row for each routed item; times are milliseconds or nanoseconds as named.  All figures
look at the last ``n`` rows in an order of scheduling, so no frame grows with the log.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.operators import ranges

#: Least interval between arrivals in a rate, in nanoseconds.
LEAST_INTERVAL_NS = 1000


def last(keys: list[str], order: list[str], n: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


def over_last(df: DataFrame, keys: list[str], order: list[str], n: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``df`` with columns over the last ``n`` rows of their key; a key of very many rows is dealt to ranges."""
    return ranges.framed(df, keys, order, n - 1, lambda df, keys, order: df.withColumns(columns(last(keys, order, n))))


def past_counts(df: DataFrame, keys: list[str], order: list[str], class_col: str, classes: list[int], n: int) -> DataFrame:
    """How many of each class are among the last ``n``."""
    return over_last(df, keys, order, n, lambda w: {f"class_{c}": F.count(F.when(F.col(class_col) == c, 1)).over(w) for c in classes})


def coarse_interval(time: str, w: WindowSpec, least: int = LEAST_INTERVAL_NS) -> Column:
    """(last - first) / (n - 1), at least 1 µs; null for a single row."""
    n = F.count(time).over(w)
    return F.when(n > 1, F.greatest((F.max(time).over(w) - F.min(time).over(w)) / F.when(n > 1, n - 1), F.lit(float(least))))


def _differences(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, made: Callable[[WindowSpec], Column], name: str) -> DataFrame:
    """``made`` of an aggregate over the consecutive differences among the last ``n`` rows."""

    def plain(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        own = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_d", F.col(value) - F.lag(value).over(own)).withColumn(name, made(last(keys, order, n - 1))).drop("_d")

    return ranges.framed(df, keys, order, n - 1, plain)


def fine_interval(df: DataFrame, keys: list[str], order: list[str], time: str, n: int, name: str, least: int = LEAST_INTERVAL_NS) -> DataFrame:
    """The mean of consecutive gaps among the last ``n`` rows."""

    def made(w: WindowSpec) -> Column:
        mean = F.avg("_d").over(w)
        return F.when(mean.isNotNull(), F.greatest(mean, F.lit(float(least))))

    return _differences(df, keys, order, time, n, made, name)


def mean_of(value: str, w: WindowSpec) -> Column:
    return F.avg(value).over(w)


def mean_increase(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str) -> DataFrame:
    """The mean of consecutive differences among the last ``n`` rows; 0 without any."""
    return _differences(df, keys, order, value, n, lambda w: F.coalesce(F.avg("_d").over(w), F.lit(0.0)), name)


def weighted_increase(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str) -> DataFrame:
    """As :func:`mean_increase`, the newest difference weighing most: sum(i d_i) / sum(i)."""

    def made(w: WindowSpec) -> Column:
        held = F.collect_list("_d").over(w)
        total = F.aggregate(F.transform(held, lambda d, i: d * (i + 1)), F.lit(0.0), lambda a, v: a + v)
        m = F.size(held)
        return F.when(m > 0, total / F.when(m > 0, m * (m + 1) / 2)).otherwise(0.0)

    return _differences(df, keys, order, value, n, made, name)


def pending(routed: DataFrame, merged: DataFrame, id_col: str, keys: list[str], now: Column, created: str) -> DataFrame:
    """Routed items without an outcome: how many, and their mean and greatest age."""
    open_ = routed.join(merged.select(id_col), id_col, "left_anti")
    age = now - F.col(created)
    return open_.groupBy(*keys).agg(F.count("*").alias("pending"), F.avg(age).alias("mean_age"), F.max(age).alias("max_age"))


def pending_marked(routed: DataFrame, done: Column, keys: list[str], now: Column, created: str) -> DataFrame:
    """As :func:`pending`, where the rows themselves say whether they have an outcome: no join."""
    age = now - F.col(created)
    return routed.filter(~done).groupBy(*keys).agg(F.count("*").alias("pending"), F.avg(age).alias("mean_age"), F.max(age).alias("max_age"))


def stale_cleanup(routed: DataFrame, id_col: str, created: str, now: Column, limit: int, include: bool = True) -> tuple[DataFrame, DataFrame]:
    """(still pending, purged as pipeline 0 with the limit as elapsed time); without ``include`` none are kept as past."""
    old = now - F.col(created) > limit
    purged = routed.filter(old).withColumn("pipeline", F.lit(0)).withColumn("elapsed", F.lit(limit).cast("long"))
    return routed.filter(~old), purged if include else purged.limit(0)


def match_feedback(routed: DataFrame, merged: DataFrame, id_col: str, sent: str, done: str) -> DataFrame:
    """Outcomes met with what was routed: (id, pipeline) and the elapsed time."""
    return routed.join(merged.select(id_col, "pipeline", done), [id_col, "pipeline"]).withColumn("elapsed", F.col(done) - F.col(sent))


# --- forecast --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lookahead:
    """How far to look: a number of items, a time, or a time with a cap."""

    count: int | None = None
    time_ms: float | None = None


def window_size(lookahead: Lookahead, interval_us: float | None, history: int) -> int:
    """Items in the window; 0: known items only."""
    if lookahead.count is None and lookahead.time_ms is None:
        raise CompileError("a lookahead needs a count or a time")
    if lookahead.time_ms is None:
        return lookahead.count
    if history < 2 or interval_us is None or interval_us < 100:
        return 0
    by_time = int(lookahead.time_ms * 1000 / interval_us)
    return by_time if lookahead.count is None else min(by_time, lookahead.count)


def window_sizes(interval_us: Column, history: Column, lookahead: Lookahead) -> tuple[Column, Column]:
    """As :func:`window_size` for a column of intervals: (items in the window, items without the cap)."""
    if lookahead.time_ms is None:
        if lookahead.count is None:
            raise CompileError("a lookahead needs a count or a time")
        return F.lit(lookahead.count), F.lit(lookahead.count)
    known = (history >= 2) & interval_us.isNotNull() & (interval_us >= 100)
    by_time = F.when(known, F.floor(F.lit(lookahead.time_ms * 1000) / F.when(known, interval_us))).otherwise(0).cast("int")
    return by_time if lookahead.count is None else F.least(F.lit(lookahead.count), by_time), by_time


def kept_ratio(returned: Column, unclipped: Column) -> Column:
    """As :func:`ratio_kept` for columns."""
    return F.when(unclipped > 0, F.least(F.lit(1.0), returned / F.when(unclipped > 0, unclipped))).otherwise(1.0)


def ratio_kept(returned: int, unclipped: int) -> float:
    """The share of a window that its cap kept; it scales the budget."""
    return min(1.0, returned / unclipped) if unclipped > 0 else 1.0


def forecast(known: list[int], past: dict[int, int], lookahead: Lookahead, interval_us: float | None, history: int) -> tuple[list[int], float]:
    """Classes of the window's items, known ones first, and the ratio kept.

    Future items follow the shares of past classes as expected counts, the largest remainders up.
    """
    size = window_size(lookahead, interval_us, history)
    unclipped = window_size(Lookahead(None, lookahead.time_ms), interval_us, history) if lookahead.time_ms is not None else size
    more = max(0, size - len(known))
    total = sum(past.values())
    out = list(known)
    if more and total:
        exact = {c: more * n / total for c, n in past.items()}
        given = {c: math.floor(v) for c, v in exact.items()}
        rest = sorted(exact, key=lambda c: (given[c] - exact[c], c))[: more - sum(given.values())]
        for c in sorted(past):
            out += [c] * (given[c] + (c in rest))
    return out, ratio_kept(len(out), max(unclipped, len(known)))


def perfect_forecast(bins: list[int], start: int, n: int, stride: int = 1) -> list[int]:
    """A slice of known future bins, around its end."""
    return [bins[(start + i * stride) % len(bins)] for i in range(n)] if bins else []
