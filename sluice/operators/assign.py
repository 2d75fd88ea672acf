"""Assignment under a budget: which pipeline each item of a window takes.

The work is on counts per bucket, so its cost follows the buckets and pipelines of a window, not its
rows.  Every item starts at its bucket's first pipeline; swaps move items to dearer, better ones.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators import ranges
from sluice.operators.classify import Bucket


@dataclass(frozen=True)
class Swap:
    bucket: int
    start: int
    end: int
    score: float
    cost: float
    reward: float


def group_buckets(buckets: Sequence[Bucket]) -> tuple[list[int], list[Bucket]]:
    """Buckets of one label become their mean; those without a label stay single.  First seen first."""
    place: dict = {}
    members: list[list[Bucket]] = []
    indices = []
    for b in buckets:
        at = place.get(b.id) if b.id is not None else None
        if at is None:
            at = len(members)
            members.append([])
            if b.id is not None:
                place[b.id] = at
        members[at].append(b)
        indices.append(at)
    mean = lambda rows: [math.fsum(v) / len(rows) for v in zip(*rows, strict=True)]
    return indices, [Bucket(mean([m.rewards for m in g]), mean([m.costs for m in g]), g[0].id, g[0].valid) for g in members]


def score(reward: float, cost: float) -> float:
    return reward if cost == 0 else reward / abs(cost)


def _climb(bucket: Bucket) -> list[tuple[int, int]]:
    """Neighbouring useful positions: a dearer start is left out for its cheaper successor, a worse end is skipped."""
    out, at = [], 0
    for p in range(1, len(bucket.valid)):
        if bucket.costs[at] > bucket.costs[p]:
            at = p
        elif bucket.rewards[at] <= bucket.rewards[p]:
            out.append((at, p))
            at = p
    return out


def swaps(buckets: Sequence[Bucket]) -> list[Swap]:
    """All swaps, lowest gain in score first; undefined gains first of all."""
    out = []
    for n, b in enumerate(buckets):
        for i, j in _climb(b):
            gain = score(b.rewards[j], b.costs[j]) - score(b.rewards[i], b.costs[i])
            out.append(Swap(n, b.valid[i], b.valid[j], gain, b.costs[j] - b.costs[i], b.rewards[j] - b.rewards[i]))
    return sorted(out, key=lambda s: (not math.isnan(s.score), 0 if math.isnan(s.score) else s.score))


@dataclass
class Assignment:
    """``counts[bucket][pipeline]`` items, with their reward and cost."""

    counts: list[dict[int, int]]
    reward: float
    cost: float
    swaps: int = 0


def _start(buckets: Sequence[Bucket], items: Sequence[int]) -> Assignment:
    counts = [{b.valid[0]: n} if n else {} for b, n in zip(buckets, items, strict=True)]
    return Assignment(counts, sum(b.rewards[0] * n for b, n in zip(buckets, items, strict=True)), sum(b.costs[0] * n for b, n in zip(buckets, items, strict=True)))


def greedy(buckets: Sequence[Bucket], items: Sequence[int], budget: float) -> Assignment:
    """Apply the best affordable swap again and again, from the top after each.

    Where a swap's items and the budget allow several at once they are moved together; as only its own
    end gains items, nothing above it can become possible in between unless it starts there.
    """
    state, left = _start(buckets, items), budget
    ranked = [s for s in reversed(swaps(buckets)) if not math.isnan(s.score)]
    again = True
    while again and left > 0:
        again = False
        for at, s in enumerate(ranked):
            have = state.counts[s.bucket].get(s.start, 0)
            if not have or s.cost > left:
                continue
            many = have if s.cost <= 0 else min(have, int(left / s.cost + 1e-9))
            if any(t.bucket == s.bucket and t.start == s.end for t in ranked[:at]):
                many = 1
            many = max(many, 1)
            own = state.counts[s.bucket]
            own[s.start] -= many
            own[s.end] = own.get(s.end, 0) + many
            left -= many * s.cost
            state.cost += many * s.cost
            state.reward += many * s.reward
            state.swaps += many
            again = True
            break
    return state


#: Items up to which the optimum goes item by item; beyond, it goes by counts.
BY_ITEM = 64
#: Pairs of states that a merge looks at together.
_PAIRS = 4_000_000


@dataclass(eq=False)
class _States:
    """What a number of items can cost and earn, without what is dominated: ascending in both.  Each state knows
    the states of its two parts, or the pipeline of a single item."""

    cost: np.ndarray
    reward: np.ndarray
    parts: tuple[_States, _States] | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    pipelines: np.ndarray | None = None

    def step(self) -> float:
        """The common distance of costs if gains never grow along them, else 0."""
        if len(self.cost) < 2:
            return math.inf
        gaps, gains = np.diff(self.cost), np.diff(self.reward)
        even = np.allclose(gaps, gaps[0], rtol=1e-9, atol=0) and (np.diff(gains) <= 1e-12 * np.abs(gains[:-1])).all()
        return float(gaps[0]) if even else 0.0

    def counted(self, at: int, into: dict[int, int]) -> None:
        """Add the pipelines of a state to ``into``."""
        todo = [(self, at)]
        while todo:
            own, i = todo.pop()
            if own.parts is None:
                p = int(own.pipelines[i])
                into[p] = into.get(p, 0) + 1
            else:
                todo += [(own.parts[0], int(own.left[i])), (own.parts[1], int(own.right[i]))]


def _undominated(cost: np.ndarray, reward: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The states that earn more than every cheaper one; of equal ones the last."""
    order = np.lexsort((-np.arange(len(cost)), -reward, cost))
    cost, reward, more = cost[order], reward[order], tuple(m[order] for m in more)
    best = np.maximum.accumulate(np.append(-np.inf, reward[:-1])) if len(reward) else reward
    keep = reward > best
    return cost[keep], reward[keep], *(m[keep] for m in more)


def _merged(a: _States, b: _States, most: float) -> _States:
    """States of both parts together, up to a cost."""
    steps = (a.step(), b.step())
    if min(steps) > 0 and (math.inf in steps or math.isclose(*steps, rel_tol=1e-9)):
        # Both sides' gains fall with even costs: the best of each total takes gains in order.
        gains, of_a = np.r_[np.diff(a.reward), np.diff(b.reward)], np.r_[np.ones(len(a.cost) - 1, int), np.zeros(len(b.cost) - 1, int)]
        order = np.argsort(-gains, kind="stable")
        left = np.append(0, of_a[order].cumsum())
        right = np.arange(len(left)) - left
        cost, reward = a.cost[left] + b.cost[right], a.reward[left] + b.reward[right]
        keep = cost <= most
        return _States(cost[keep], reward[keep], (a, b), left[keep], right[keep])
    found: tuple[np.ndarray, ...] = (np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    many = max(1, _PAIRS // max(1, len(b.cost)))
    for at in range(0, len(a.cost), many):
        cost, reward = a.cost[at : at + many, None] + b.cost[None, :], a.reward[at : at + many, None] + b.reward[None, :]
        i, j = np.nonzero(cost <= most)
        found = _undominated(*(np.concatenate(c) for c in zip(found, (cost[i, j], reward[i, j], i + at, j), strict=True)))
    return _States(found[0], found[1], (a, b), found[2], found[3])


def _times(one: _States, n: int, most: float) -> _States:
    """States of ``n`` equal items, by doubling."""
    out, power = None, one
    while n:
        if n & 1:
            out = power if out is None else _merged(out, power, most)
        n >>= 1
        if n:
            power = _merged(power, power, most)
    return out


def _optimal_by_counts(buckets: Sequence[Bucket], items: Sequence[int], budget: float, epsilon: float) -> Assignment:
    most, held = budget + epsilon, []
    for b, n in zip(buckets, items, strict=True):
        if n:
            cost, reward, pipelines = _undominated(np.array(b.costs, float), np.array(b.rewards, float), np.array(b.valid))
            fits = cost <= most
            if not fits.any():
                return _start(buckets, items)
            cost, reward, pipelines = cost[fits], reward[fits], pipelines[fits]
            held.append(_times(_States(cost, reward, pipelines=pipelines), n, most))
    total = held[0]
    for own in held[1:]:
        total = _merged(total, own, most)
    if not len(total.cost):
        return _start(buckets, items)
    # Unroll the merges of buckets, which are the outermost ones, the last bucket first.
    at, places = len(total.cost) - 1, []
    reward, cost = float(total.reward[at]), float(total.cost[at])
    for _ in held[1:]:
        places.append(int(total.right[at]))
        total, at = total.parts[0], int(total.left[at])
    places.append(at)
    counts: list[dict[int, int]] = [{} for _ in buckets]
    own = [k for k, n in enumerate(items) if n]
    for k, states, place in zip(own, held, reversed(places), strict=True):
        states.counted(place, counts[k])
    return Assignment(counts, reward, cost)


def optimal(buckets: Sequence[Bucket], items: Sequence[int], budget: float, epsilon: float = 1e-9) -> Assignment:
    """The greatest reward within the budget, exactly, by what items can cost and earn.

    States that cost no less and earn no more than another are dropped.  Up to BY_ITEM items are added one
    by one, and of equal rewards later pipelines win; more are merged by counts, equal items by doubling.  If
    nothing fits, all items stay at their first pipelines.
    """
    if sum(items) > BY_ITEM:
        return _optimal_by_counts(buckets, items, budget, epsilon)
    frontier: list[tuple[float, float, tuple]] = [(0.0, 0.0, ())]
    for n, (b, count) in enumerate(zip(buckets, items, strict=True)):
        for _ in range(count):
            grown = [(c + b.costs[p], r + b.rewards[p], (how, n, b.valid[p])) for c, r, how in frontier for p in range(len(b.valid)) if c + b.costs[p] <= budget + epsilon]
            grown.sort(key=lambda s: (s[0], -s[1], -(s[2][2])))
            frontier, best = [], -math.inf
            for s in grown:
                if s[1] > best:
                    frontier.append(s)
                    best = s[1]
            if not frontier:
                return _start(buckets, items)
    cost, reward, how = frontier[-1]
    counts: list[dict[int, int]] = [{} for _ in buckets]
    while how:
        how, n, p = how
        counts[n][p] = counts[n].get(p, 0) + 1
    return Assignment(counts, reward, cost)


def optimal_or_start(buckets: Sequence[Bucket], items: Sequence[int], budget: float) -> Assignment:
    """As :func:`optimal`; below the price of every real pipeline all items stay where they start."""
    real = [c for b in buckets for p, c in zip(b.valid, b.costs, strict=True) if p != b.valid[0]]
    return _start(buckets, items) if not real or budget < min(real) else optimal(buckets, items, budget)


def within(assignment: Assignment, buckets: Sequence[Bucket], items: Sequence[int], budget: float) -> Assignment:
    """The assignment, or the start if it costs more than the budget."""
    return assignment if assignment.cost <= budget + 1e-9 else _start(buckets, items)


def distribute(assignment: Assignment, classes: Iterable[int], seed: int = 0) -> list[int]:
    """A pipeline for each item, drawn without replacement from its bucket's counts."""
    rng = random.Random(seed)
    pools = []
    for own in assignment.counts:
        pool = [p for p, n in sorted(own.items()) for _ in range(n)]
        rng.shuffle(pool)
        pools.append(pool)
    return [pools[c].pop() for c in classes]


def item_swaps(bins: Sequence[Bucket]) -> list[Swap]:
    """Swaps of single items: pipelines by reward, without those dearer than one after them, in neighbouring steps."""
    out = []
    for n, b in enumerate(bins):
        steps: list[int] = []
        for p in sorted(range(len(b.valid)), key=lambda p: b.rewards[p]):
            while steps and b.costs[steps[-1]] > b.costs[p]:
                steps.pop()
            steps.append(p)
        for i, j in zip(steps, steps[1:], strict=False):
            gain = score(b.rewards[j], b.costs[j]) - score(b.rewards[i], b.costs[i])
            out.append(Swap(n, b.valid[i], b.valid[j], gain, b.costs[j] - b.costs[i], b.rewards[j] - b.rewards[i]))
    return sorted(out, key=lambda s: (not math.isnan(s.score), 0 if math.isnan(s.score) else s.score))


def per_item_greedy(bins: Sequence[Bucket], budget: float) -> tuple[list[int], float, float]:
    """Greedy over single items: (pipeline of each, reward, cost).

    Of swaps with equal gains that of the last item comes first.
    """
    at, left = [b.valid[0] for b in bins], budget
    ranked = [s for s in reversed(item_swaps(bins)) if not math.isnan(s.score)]
    again = True
    while again and left > 0:
        again = False
        for s in ranked:
            if s.cost <= left and at[s.bucket] == s.start:
                at[s.bucket] = s.end
                left -= s.cost
                again = True
                break
    chosen = [(b, b.valid.index(p)) for b, p in zip(bins, at, strict=True)]
    return at, sum(b.rewards[p] for b, p in chosen), sum(b.costs[p] for b, p in chosen)


# --- as DataFrames ---------------------------------------------------------------------------


def group_means(rows: DataFrame, label: str, rewards: str, costs: str) -> DataFrame:
    """Mean rewards and costs for each label and pipeline position."""
    each = rows.select(label, F.posexplode(F.arrays_zip(F.col(rewards).alias("r"), F.col(costs).alias("c"))).alias("pipeline", "_b"))
    return each.groupBy(label, "pipeline").agg(F.avg("_b.r").alias("reward"), F.avg("_b.c").alias("cost"))


def swap_table(buckets: DataFrame, label: str, pipeline: str, reward: str, cost: str) -> DataFrame:
    """The swaps of each label's pipelines, taken in order: a dearer start gives way to its cheaper
    successor, and a worse end is passed over until a better one comes.

    A label has few pipelines, so each is one array that a fold walks along.
    """
    gain = lambda r, c: F.when(c == 0, r).otherwise(r / F.abs(F.when(c != 0, c)))
    one = F.struct(F.col(pipeline).alias("p"), F.col(reward).cast("double").alias("r"), F.col(cost).cast("double").alias("c"))
    rows = buckets.groupBy(label).agg(F.array_sort(F.collect_list(one)).alias("_b"))
    kind = dict(buckets.dtypes)[pipeline]
    step = f"struct<p:{kind},r:double,c:double>"
    start = F.struct(F.get("_b", F.lit(0)).cast(step).alias("at"), F.array().cast(f"array<struct<a:{step},b:{step}>>").alias("out"))

    def walk(state: Column, b: Column) -> Column:
        a = state["at"]
        cheaper, better = a["c"] > b["c"], a["r"] <= b["r"]
        return F.struct(F.when(cheaper | better, b.cast(step)).otherwise(a).alias("at"), F.when(~cheaper & better, F.concat(state["out"], F.array(F.struct(a.alias("a"), b.cast(step).alias("b"))))).otherwise(state["out"]).alias("out"))

    out = rows.select(label, F.explode(F.aggregate(F.slice("_b", 2, 1 << 30), start, walk, lambda s: s["out"])).alias("_s"))
    a, b = F.col("_s.a"), F.col("_s.b")
    return out.select(label, a["p"].alias("start_pipeline"), b["p"].alias("end_pipeline"), (gain(b["r"], b["c"]) - gain(a["r"], a["c"])).alias("score_diff"), (b["c"] - a["c"]).alias("swap_cost"), (b["r"] - a["r"]).alias("reward_diff"))


def _ranked(df: DataFrame, window: str, class_col: str, order: list[str], classes: int) -> DataFrame:
    """Rows with ``_c``, their class if there is such a bucket, and their rank ``_nth`` within it."""
    known = F.col(class_col).cast("int")
    df = df.withColumn("_c", F.when(known.between(0, classes - 1), known))
    return ranges.numbered(df, [window, "_c"], order, "_nth")


def _given(ranked: DataFrame, window: str, spans: DataFrame) -> DataFrame:
    """Rows with the pipeline of the span that holds their rank; those without a span are dropped to pipeline 0."""
    on = F.col(window).eqNullSafe(F.col("_w")) & (F.col("_c") == F.col("_class")) & (F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_to"))
    out = ranked.join(spans.withColumnRenamed("pipeline", "_p"), on, "left").withColumn("pipeline", F.coalesce("_p", F.lit(0)))
    return out.drop("_w", "_class", "_from", "_to", "_nth", "_c", "_p")


def assign_windows(df: DataFrame, window: str, class_col: str, order: list[str], buckets: Sequence[Bucket], budget: Column, strategy: str = "greedy") -> DataFrame:
    """``df`` with ``pipeline``: each window's items assigned within the window's budget.

    Only counts per window and class are gathered; the assignment of a window is made from them, and
    rows take their pipeline by rank within their class, dearer pipelines to earlier rows.  Rows whose
    class is null or has no bucket take no part and get pipeline 0; null windows are one window.
    """
    held = list(buckets)
    solve = {"greedy": greedy, "optimal": optimal_or_start}[strategy]
    ranked = _ranked(df, window, class_col, order, len(held))
    counts = ranked.filter("_c is not null").groupBy(window, "_c").agg(F.count("*").alias("_n"), F.max(budget).alias("_budget"))
    kind = dict(df.dtypes)[window]

    def solved(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for key, own, money in zip(frame[window], frame["_counts"], frame["_b"], strict=True):
                items = [0] * len(held)
                for c in own:
                    items[c["class"]] = c["n"]
                done = solve(held, items, 0.0 if money != money else money)
                for c, given in enumerate(done.counts):
                    first = 0
                    for p, n in sorted(given.items(), reverse=True):
                        if n:
                            out.append((key, c, p, first, first + n))
                            first += n
            yield pd.DataFrame(out, columns=["_w", "_class", "pipeline", "_from", "_to"])

    per_window = counts.groupBy(window).agg(F.collect_list(F.struct(F.col("_c").alias("class"), F.col("_n").cast("int").alias("n"))).alias("_counts"), F.max("_budget").cast("double").alias("_b"))
    spans = per_window.mapInPandas(solved, f"_w {kind}, _class int, pipeline int, _from long, _to long")
    return _given(ranked, window, spans)
