"""Streams that keep rows of their own: chunks with a timeout, joins with an eviction, completion by count, and a
router's pending items.

The first three are stateful processors, which need the RocksDB state store (:func:`state_store`); their state is
per key, so keys spread them over tasks, and each says what bounds it.  Pending items are a native outer join of
two streams, whose watermarks bound its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.errors import CompileError

_STORE = "spark.sql.streaming.stateStore"
_PROVIDER = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Settings of a store whose number of rows nobody asks for: no lookup before each write, a micro-batch leaves its
#: changes and not the whole store, and a join of streams keeps one store for a partition instead of four.
LEAN_STORE = {
    **_PROVIDER,
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def state_store(spark: SparkSession, lean: bool = False) -> None:
    """Queries started after this keep their state in RocksDB; ``lean``: by LEAN_STORE, so progress has no count of state rows."""
    for name, value in (LEAN_STORE if lean else _PROVIDER).items():
        spark.conf.set(name, value)


def _kinds(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def _rows(frames, names: list[str], order: list[str]):
    """A key's new rows in order; columns come by place."""
    import pandas as pd

    return pd.concat([f.set_axis(names, axis=1) for f in frames]).sort_values(order, kind="stable")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _plain(frame, kinds: list[str] | None = None) -> list[tuple]:
    """Rows as tuples that a state takes: nulls are None, numbers are Python's (pandas makes doubles of whole ones beside nulls)."""
    whole = [k in _WHOLE for k in kinds or [""] * frame.shape[1]]
    return [tuple(None if v is None or v != v else int(v) if w else v for v, w in zip(row, whole, strict=True)) for row in frame.astype(object).itertuples(index=False, name=None)]


#: What stands in the other side's cells, so that a side's whole numbers stay whole in pandas.
_FILLERS = {**dict.fromkeys((*_WHOLE, "double", "float"), 0), "string": "", "boolean": False}


class _Chunks(StatefulProcessor):
    """State: the rows of the open chunk, fewer than ``size``, and its number."""

    def __init__(self, keys: list[str], columns: list[str], kinds: str, order: list[str], size: int, timeout_ms: int) -> None:
        self.keys, self.columns, self.kinds, self.order, self.size, self.timeout_ms = keys, columns, kinds, order, size, timeout_ms
        self.types = [k.rpartition("` ")[2] for k in kinds.split(", `")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.kinds)
        self.number = handle.getValueState("number", "number bigint")

    def _emitted(self, rows: list[tuple], number: int):
        import pandas as pd

        return pd.DataFrame([(*r, number) for r in rows], columns=[*self.columns, "chunk"])

    def _stop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        number, began = (self.number.get()[0] if self.number.exists() else 0), bool(held)
        held += _plain(_rows(rows, self.columns, self.order), self.types)
        full = len(held) // self.size
        for k in range(full):
            yield self._emitted(held[k * self.size : (k + 1) * self.size], number + k)
        left = held[full * self.size :]
        if full:
            self._stop_timers()
            began = False
        if left:
            self.held.put(left)
            if not began:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.timeout_ms)
        elif self.held.exists():
            self.held.clear()
        self.number.update((number + full,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        number = self.number.get()[0] if self.number.exists() else 0
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        if held:
            self.held.clear()
            self.number.update((number + 1,))
            yield self._emitted(held, number)

    def close(self) -> None:
        pass


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int, timeout_ms: int) -> DataFrame:
    """Rows with the number of their ``chunk`` within its key: a chunk is given out when it has ``size`` rows, or when
    ``timeout_ms`` have passed since its first; none is ever empty.  The last, partial one waits for its timeout."""
    if size < 1 or not keys:
        raise CompileError("chunks need keys and a size of at least 1")
    columns = df.columns
    made = _Chunks(keys, columns, _kinds(df, columns), order, size, timeout_ms)
    return df.groupBy(*keys).transformWithStateInPandas(made, f"{_kinds(df, columns)}, chunk bigint", "Append", "ProcessingTime")


class _Joined(StatefulProcessor):
    """State: the rows of both sides that the eviction has not let go."""

    def __init__(self, names: list[str], sides: tuple[list[str], list[str]], kinds: tuple[dict, dict], out: list[str], order: str, predicate: Callable, evict: Callable) -> None:
        self.names, self.sides, self.kinds, self.out, self.order, self.predicate, self.evict = names, sides, kinds, out, order, predicate, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = [handle.getListState(f"side{s}", ", ".join(f"`{c}` {self.kinds[s][c]}" for c in self.sides[s])) for s in (0, 1)]

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        frame = _rows(rows, self.names, ["_at", "_side"])
        new = [frame[frame["_side"] == s][[f"_{s}_{c}" for c in self.sides[s]]].set_axis(self.sides[s], axis=1) for s in (0, 1)]
        old = [pd.DataFrame([tuple(r) for r in st.get()] if st.exists() else [], columns=c) for st, c in zip(self.stored, self.sides, strict=True)]
        old = [o[list(keep)] if len(o) else o for o, keep in zip(old, self.evict(*old), strict=True)]
        # Each row meets what the other side has stored, then the new rows of both sides meet.
        for a, b in ((old[0], new[1]), (new[0], old[1]), (new[0], new[1])):
            for at in range(0, len(a), 1024):
                pairs = a.iloc[at : at + 1024].merge(b, how="cross", suffixes=("", "_r"))
                if len(pairs):
                    left = pairs[self.sides[0]]
                    right = pairs[[f"{c}_r" if c in self.sides[0] else c for c in self.sides[1]]].set_axis(self.sides[1], axis=1)
                    kept = pairs[list(self.predicate(left, right))]
                    if len(kept):
                        yield kept[self.out]
        both = [pd.concat([o, n]) if len(o) else n for o, n in zip(old, new, strict=True)]
        for s, now in enumerate(both):
            kept = _plain(now, [self.kinds[s][c] for c in self.sides[s]])
            if kept:
                self.stored[s].put(kept)
            elif self.stored[s].exists():
                self.stored[s].clear()

    def close(self) -> None:
        pass


def double_stream(left: DataFrame, right: DataFrame, fields: list[str], order: str, predicate: Callable, evict: Callable) -> DataFrame:
    """A join of two streams on equal ``fields`` (null keys meet), any ``predicate`` and any eviction.

    ``predicate(left, right)`` gets frames of pairs and gives a mask; ``evict(left, right)`` gets what is stored
    of a key before each micro-batch and gives two masks of what stays, which alone bounds the state.  The
    left row wins names.
    """
    sides = (left.columns, right.columns)
    for side, columns in (("left", sides[0]), ("right", sides[1])):
        if order not in columns or any(f not in columns for f in fields):
            raise CompileError(f"the {side} side needs {[*fields, order]}")
    out = [*sides[0], *[c for c in sides[1] if c not in sides[0]]]
    kinds = (dict(left.dtypes), dict(right.dtypes))
    keys = [f"_k{i}" for i in range(len(fields))]

    def tagged(df: DataFrame, side: int) -> DataFrame:
        own = [F.col(f"`{f}`").alias(k) for f, k in zip(fields, keys, strict=True)]
        cells = [(F.col(f"`{c}`") if s == side else F.lit(_FILLERS.get(kinds[s][c])).cast(kinds[s][c])).alias(f"_{s}_{c}") for s in (0, 1) for c in sides[s]]
        return df.select(*own, F.lit(side).alias("_side"), F.col(f"`{order}`").cast("double").alias("_at"), *cells)

    both = tagged(left, 0).unionByName(tagged(right, 1))
    joined = _Joined(both.columns, sides, kinds, out, order, predicate, evict)
    schema = ", ".join(f"`{c}` {kinds[0].get(c) or kinds[1][c]}" for c in out)
    return both.groupBy(*keys).transformWithStateInPandas(joined, schema, "Append", "None")


class _Completed(StatefulProcessor):
    """State of a bucket of groups: the count, greatest expectation, sum and beginning of each that is not complete."""

    def __init__(self, key: str, kind: str, timeout_ms: int | None) -> None:
        self.key, self.kind, self.timeout_ms = key, kind, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("groups", f"k array<{self.kind}>, n array<bigint>, expected array<bigint>, total array<double>, began array<bigint>")

    def _held(self) -> dict:
        held = self.state.get()
        return {_same(k): tuple(r) for k, *r in zip(*held, strict=True)} if held else {}

    def _hold(self, groups: dict, held: bool) -> None:
        if groups:
            self.state.update(([*groups], *map(list, zip(*groups.values(), strict=True))))
        elif held:
            self.state.clear()

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        groups, out, now = self._held(), [], timer_values.getCurrentProcessingTimeInMs()
        before, fresh = len(groups), False
        # No frame is made of a group: keys are many and their rows few.  A null is None or not a number.
        for frame in rows:
            cells = [frame.iloc[:, c].tolist() for c in range(1, 5)]
            for k, none, expected, value in zip(*cells, strict=True):
                k = None if none else _same(k)
                n, most, total, began = groups.get(k) or (0, 0, 0.0, now)
                n, most = n + 1, max(most, int(expected) if expected is not None and expected == expected else 0)
                total += value if value is not None and value == value else 0.0
                if n >= most:
                    out.append((k, n, most, total))
                    groups.pop(k, None)
                else:
                    groups[k] = (n, most, total, began)
                    fresh = fresh or n == 1
        self._hold(groups, before > 0)
        if self.timeout_ms is not None:
            if fresh:
                self.handle.registerTimer(now + self.timeout_ms)
            if before and not groups:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if out:
            # Whole numbers beside a null stay objects, so that none passes through a double.
            made = pd.DataFrame(out, columns=[self.key, "n_rows", "n_expected", "total"])
            keys = [r[0] for r in out]
            yield made.assign(**{self.key: pd.Series(keys, dtype=object)}) if None in keys else made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held, past = self._held(), timerValues.getCurrentProcessingTimeInMs() - self.timeout_ms
        self._hold({k: g for k, g in held.items() if g[-1] > past}, bool(held))
        return iter(())

    def close(self) -> None:
        pass


_NAN = float("nan")


def _same(k):
    """A key as Spark compares it: one NaN, one zero."""
    return k if not isinstance(k, float) else _NAN if k != k else k + 0.0


def complete_by_count(df: DataFrame, key: str, expected: str, value: str, timeout_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """A row ``key, n_rows, n_expected, total`` when a group has as many rows as the greatest ``expected`` so far
    (null: 0), and its state is gone.  A group that has not completed ``timeout_ms`` after its first row is dropped;
    without a timeout it is waited for, and the state is what is incomplete.

    A call of the processor costs about as much as a thousand rows, so groups are dealt to ``buckets`` by their keys, and
    a bucket's incomplete groups are one state; a checkpoint holds for one number of buckets.
    """
    kind = dict(df.dtypes)[key]
    if "<" in kind:
        raise CompileError(f"a key of groups must be plain, not {kind}")
    own = F.col(f"`{key}`")
    own = own + F.lit(0).cast(kind) if kind in ("double", "float") else own  # one zero
    cell = F.coalesce(own, F.lit(_FILLERS[kind]).cast(kind)) if kind in _FILLERS else own
    bucket = F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int")
    rows = df.select(bucket.alias("_bucket"), cell.alias("_key"), own.isNull().alias("_none"), F.col(f"`{expected}`").cast("long").alias("_expected"), F.col(f"`{value}`").cast("double").alias("_value"))
    schema = f"{_kinds(df, [key])}, n_rows bigint, n_expected bigint, total double"
    return rows.groupBy("_bucket").transformWithStateInPandas(_Completed(key, kind, timeout_ms), schema, "Append", "None" if timeout_ms is None else "ProcessingTime")


def outcomes(routed: DataFrame, feedback: DataFrame, id_col: str, created: str, sent: str, done: str, limit: str, include_purged: bool = True) -> DataFrame:
    """What became of routed items, as rows of a router's past: ``pipeline`` and ``elapsed_ms``.

    Feedback that is merged within ``limit`` of an item's creation meets it (elapsed: since it was sent); an item
    without any by then is purged as pipeline 0 with the limit as elapsed time, or left out.  Feedback without
    an item, or later than the limit, has no row.  Both frames need watermarks on ``created`` and ``done`` where
    they stream; state is what is pending within the limit.
    """
    names = [c for c in routed.columns if c not in ("pipeline", "elapsed_ms")]
    met = F.col(f"f.{done}")
    on = (F.col(f"r.`{id_col}`") == F.col(f"f.`{id_col}`")) & (met >= F.col(f"r.{created}")) & (met <= F.col(f"r.{created}") + F.expr(f"interval {limit}"))
    both = routed.alias("r").join(feedback.select(id_col, "pipeline", done).alias("f"), on, "left" if include_purged else "inner")
    whole = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {limit}")) / 1000
    elapsed = (F.unix_micros(met) - F.unix_micros(F.col(f"r.{sent}"))) / 1000
    return both.select(*[F.col(f"r.`{c}`") for c in names], F.coalesce(F.col("f.pipeline"), F.lit(0)).alias("pipeline"), F.coalesce(elapsed, whole).alias("elapsed_ms"))
