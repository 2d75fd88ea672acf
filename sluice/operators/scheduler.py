"""The lookahead scheduler: from a window's known items to their pipelines.

A window's classes are extended by a forecast of what comes next; the budget is scaled by the share of
the window that its cap kept; buckets may be adjusted; and the assignment is made over known and
forecast items together, of which the known ones take their part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.operators import assign, ranges
from sluice.operators.classify import Bucket
from sluice.operators.history import Lookahead, forecast

#: Items from which greedy works on counts per label, and items that the optimal strategy looks at where
#: only a time is given (fixed values).
GROUP_ABOVE, OPTIMAL_CAP = 100, 10


def capped(lookahead: Lookahead, strategy: str) -> Lookahead:
    """The optimal strategy never looks ahead by time alone: its cost grows too fast with the items."""
    if strategy == "optimal" and lookahead.count is None:
        return Lookahead(OPTIMAL_CAP, lookahead.time_ms)
    return lookahead


def schedule(known: Sequence[int], buckets: Sequence[Bucket], past: dict[int, int], lookahead: Lookahead, interval_us: float | None, history: int, budget: float, strategy: str = "greedy", adjust: Callable[[list[Bucket]], list[Bucket]] | None = None) -> list[int]:
    """A pipeline for each known item, in order.

    ``past`` counts classes of the last ``history`` rows, which came ``interval_us`` apart.  ``adjust``
    may give other buckets for the window's items.  Up to GROUP_ABOVE items greedy works on single items;
    beyond, on counts per label, and known items take the dearer pipelines of their bucket first.
    """
    if strategy not in ("greedy", "optimal"):
        raise CompileError(f"unknown strategy {strategy!r}")
    classes, kept = forecast(list(known), past, capped(lookahead, strategy), interval_us, history)
    bins = [buckets[c] for c in classes]
    if adjust is not None:
        bins = adjust(bins)
    budget *= min(kept, 1.0)
    if strategy == "greedy" and len(bins) <= GROUP_ABOVE:
        return assign.per_item_greedy(bins, budget)[0][: len(known)]
    place, groups = assign.group_buckets(bins)
    items = [place.count(g) for g in range(len(groups))]
    solve = assign.greedy if strategy == "greedy" else assign.optimal_or_start
    done = solve(groups, items, budget)
    pools = [sorted((p for p, n in own.items() for _ in range(n))) for own in done.counts]
    return [pools[place[i]].pop() for i in range(len(known))]


def lookahead_windows(df: DataFrame, router: list[str], window: str, class_col: str, order: list[str], time_us: str, buckets: Sequence[Bucket], budget: Column, lookahead: Lookahead, history_rows: int = 100, strategy: str = "greedy", adjust: Callable[[list[Bucket]], list[Bucket]] | None = None) -> DataFrame:
    """``df`` with ``pipeline``: every window of a router scheduled with a forecast from the rows before it.

    The history of a window is the last ``history_rows`` rows of its router before its first row.  Rows
    whose class is null or has no bucket take no part and get pipeline 0.  A window comes to the solver
    as counts per class; of windows that may be assigned item by item also as its first GROUP_ABOVE
    classes in order.  Nothing that is gathered grows with a window.
    """
    held = list(buckets)
    n = len(held)
    known = F.col(class_col).cast("int")
    rows = df.withColumn("_c", F.when(known.between(0, n - 1), known))
    def looked_back(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-history_rows, -1)
        past = F.struct(*[F.count(F.when(F.col("_c") == c, 1)).over(before).alias(f"c{c}") for c in range(n)], F.count(F.lit(1)).over(before).alias("n"), F.min(time_us).over(before).alias("first"), F.max(time_us).over(before).alias("last"))
        return df.withColumn("_past", past)

    rows = ranges.framed(rows, router, order, history_rows, looked_back)
    rows = ranges.numbered(rows, [*router, window], order, "_in")
    rows = ranges.numbered(rows, [*router, window, "_c"], order, "_nth")
    early = F.when((F.col("_in") < GROUP_ABOVE) & F.col("_c").isNotNull(), F.struct("_in", "_c"))
    counts = [F.count(F.when(F.col("_c") == c, 1)).alias(f"_n{c}") for c in range(n)]
    first = F.max(F.when(F.col("_in") == 0, F.col("_past"))).alias("_past")
    per_window = rows.groupBy(*router, window).agg(*counts, first, F.max(budget).cast("double").alias("_budget"), F.array_sort(F.collect_list(early)).alias("_early"))
    names = [*router, window]
    kinds = dict(df.dtypes)

    def solved(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                items = [int(row[f"_n{c}"]) for c in range(n)]
                total = sum(items)
                if total <= GROUP_ABOVE:
                    classes = [e["_c"] for e in row["_early"]]
                else:
                    classes = [c for c, k in enumerate(items) for _ in range(k)]
                p = row["_past"]
                gap = (p["last"] - p["first"]) / (p["n"] - 1) if p["n"] > 1 else None
                money = row["_budget"]
                routes = schedule(classes, held, {c: p[f"c{c}"] for c in range(n)}, lookahead, gap, p["n"], 0.0 if money != money else money, strategy, adjust)
                key, seen = [row[k] for k in names], [0] * n
                for c, k in zip(classes, routes, strict=True):
                    if out and out[-1][: len(names) + 2] == [*key, c, k] and out[-1][-1] == seen[c]:
                        out[-1][-1] += 1
                    else:
                        out.append([*key, c, k, seen[c], seen[c] + 1])
                    seen[c] += 1
            yield pd.DataFrame(out, columns=[*[f"_w{i}" for i in range(len(names))], "_class", "_p", "_from", "_to"])

    spans = per_window.mapInPandas(solved, ", ".join([*(f"_w{i} {kinds[k]}" for i, k in enumerate(names)), "_class int, _p int, _from long, _to long"]))
    on = (F.col("_c") == F.col("_class")) & (F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_to"))
    for i, k in enumerate(names):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_w{i}"))
    return rows.join(spans, on, "left").withColumn("pipeline", F.coalesce("_p", F.lit(0))).select(*[F.col(f"`{c}`") for c in df.columns], "pipeline")
