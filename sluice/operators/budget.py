"""Budgets: how much time or money a scheduling window may spend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.operators import ranges, routing

#: Tuning options with their defaults (fixed values).
DEFAULTS = {
    "reroute_zero": "ignore",
    "large_excess": "linear",
    "budget_version": 2,
    "penalty": "pd_mean",
    "scheduling_batch": 16,
    "culling_ratio": 1.05,
    "gain_p": 1.05,
    "gain_d": 1.0,
    "leniency_cap": 1.05,
    "ema_alpha": 0.1,
}


@dataclass(frozen=True)
class Options:
    values: dict

    def __getattr__(self, name: str):
        if name in DEFAULTS:
            return self.values.get(name, DEFAULTS[name])
        raise AttributeError(name)


def options(**values) -> Options:
    unknown = set(values) - set(DEFAULTS)
    if unknown:
        raise CompileError(f"unknown options {sorted(unknown)}")
    return Options(values)


def v1(items: Column, per_item: Column, lookahead: Column, deadline: Column, overage: Column | None = None) -> Column:
    """Items × price × lookahead / deadline, less the share by which items were late."""
    full = items * per_item * lookahead / deadline
    return full if overage is None else full * F.greatest(F.lit(0.0), 1 - overage)


def v2(lookahead: Column, penalty: Column, deadline: Column, large_excess: str = "linear") -> Column:
    """Less the more latency grows: excess is the growth as a share of the deadline."""
    e = penalty / deadline
    middle = {"linear": lookahead * (1 - e), "sqrt": lookahead * (1 - F.sqrt(F.greatest(e, F.lit(0.0)))), "none": lookahead}
    if large_excess not in middle:
        raise CompileError(f"unknown setting {large_excess!r}")
    return F.when(e <= 0, lookahead).when(e <= 0.1, lookahead * (1 - e)).when(e <= 1, middle[large_excess]).otherwise(0.0)


def v3(lookahead: Column, age: Column, penalty: Column, deadline: Column, cap: float = DEFAULTS["leniency_cap"]) -> Column:
    """Proportional to the time left, times 1 less the growth's share, between 0 and a cap."""
    kept = F.least(F.greatest(1 - penalty / deadline, F.lit(0.0)), F.lit(cap))
    return F.greatest(lookahead * (1 - age / deadline) * kept, F.lit(0.0))


def penalty(strategy: str, linear_mean: Column, linear_max: Column, prop_mean: Column) -> Column:
    found = {"linear_mean": linear_mean, "linear_max": linear_max, "prop_mean": prop_mean, "none": F.lit(0.0), "legacy": F.lit(0.0)}
    if strategy not in found:
        raise CompileError(f"unknown penalty {strategy!r}")
    return found[strategy]


def for_window(opts: Options, lookahead: Column, deadline: Column, growth: Column | None = None, age: Column | None = None, items: Column | None = None, per_item: Column | None = None, overage: Column | None = None, controlled: Column | None = None) -> Column:
    """The budget of a window by the options' version and settings.

    1 takes items and their price, 2 the growth of latency, 3 also the mean pending age.  The penalty
    ``pd_mean`` with version 2 or 3 takes a budget that :func:`pd_control` has made, if one is given;
    other penalties than ``none`` take the growth.
    """
    if opts.budget_version == 1:
        if items is None or per_item is None:
            raise CompileError("budget version 1 needs items and their price")
        return v1(items, per_item, lookahead, deadline, overage)
    if opts.penalty == "pd_mean" and controlled is not None:
        return controlled
    grown = F.lit(0.0) if opts.penalty in ("none", "legacy") or growth is None else growth
    if opts.budget_version == 2:
        return v2(lookahead, grown, deadline, opts.large_excess)
    if opts.budget_version == 3:
        if age is None:
            raise CompileError("budget version 3 needs the mean pending age")
        return v3(lookahead, age, grown, deadline, opts.leniency_cap)
    raise CompileError(f"unknown budget version {opts.budget_version!r}")


def pd_control(df: DataFrame, keys: list[str], order: list[str], age: str, lookahead: str, deadline: str, opts: Options = Options({}), name: str = "budget", frame: int = 200) -> DataFrame:
    """Proportional to the mean pending age, and to an exponential mean of its growth.

    P: L (1 - gp age / D).  D: times min(cap, 1 - gd ema / D).  The exponential mean folds the last
    ``frame`` differences; with alpha 0.1 earlier ones weigh less than 1e-9.
    """
    a = opts.ema_alpha

    def held(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        own = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_d", F.col(age) - F.lag(age).over(own)).withColumn("_held", F.collect_list("_d").over(own.rowsBetween(-(frame - 1), 0)))

    rows = ranges.framed(df, keys, order, frame, held)
    ema = F.aggregate("_held", F.lit(0.0), lambda s, d: s * (1 - a) + d * a)
    p = F.col(lookahead) * (1 - opts.gain_p * F.col(age) / F.col(deadline))
    d = F.least(F.lit(opts.leniency_cap), 1 - opts.gain_d * ema / F.col(deadline))
    return rows.withColumn(name, F.greatest(p * d, F.lit(0.0))).drop("_d", "_held")


def money(df: DataFrame, keys: list[str], order: list[str], window: str, cost: str, per_window: float, name: str = "money_left") -> DataFrame:
    """Money left after each call: a grant at the start of each window, less all costs so far."""
    spent = routing.money_spent(df, keys, order, cost, "_spent", {"_first": ("min", F.col(window))})
    return spent.withColumn(name, (F.col(window) - F.col("_first") + 1) * per_window - F.col("_spent")).drop("_first", "_spent")


def sub_batches(df: DataFrame, keys: list[str], order: list[str], size: int = DEFAULTS["scheduling_batch"], name: str = "batch") -> DataFrame:
    return ranges.numbered(df, keys, order, name).withColumn(name, F.floor(F.col(name) / size).cast("long"))
