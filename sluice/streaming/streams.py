"""Structured Streaming forms: windows, joins, late rows, feedback, and stateful routing.

Stateless operators (projection, filter, derivation, expression routing, merges) take a streaming
frame as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from sluice.errors import CompileError
from sluice.operators.history import Lookahead


def files(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """A stream of Parquet files; the rate limit bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def with_event_time(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Time as a timestamp (from one without a zone, read as UTC), with a watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def windowed(df: DataFrame, keys: list[str], time: str, length: str, slide: str | None, *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(time, length, slide) if slide else F.window(time, length), *keys).agg(*aggregates)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before: str, after: str) -> DataFrame:
    """A stream-stream join within a range of event time, which bounds the state; the left row wins names.

    Both sides need watermarks; without the range the state would never shrink.
    """
    if not before or not after:
        raise CompileError("a join of streams needs a range of time")
    lt, rt = F.col(f"l.{left_time}"), F.col(f"r.{right_time}")
    on = rt.between(lt - F.expr(f"interval {before}"), lt + F.expr(f"interval {after}"))
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    names = [F.col(f"l.`{c}`") for c in left.columns] + [F.col(f"r.`{c}`") for c in right.columns if c not in left.columns]
    return left.alias("l").join(right.alias("r"), on, "inner").select(*names)


def dedup_feedback(df: DataFrame, id_col: str, pipeline: str) -> DataFrame:
    return df.dropDuplicatesWithinWatermark([id_col, pipeline])


def split_late(batch: DataFrame, created: str, max_age: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) of a micro-batch, against its own newest row."""
    newest = batch.agg(F.max(created).alias("_now"))
    aged = batch.crossJoin(F.broadcast(newest)).withColumn("_late", F.col(created) < F.col("_now") - F.expr(f"interval {max_age}")).drop("_now")
    return aged.filter(~F.col("_late")).drop("_late"), aged.filter("_late").drop("_late")


def to_sinks(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], available_now: bool = True):
    """Start a query whose micro-batches go to ``write(batch, epoch)``; a batch that is run again has the same epoch."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class ProgressLog(StreamingQueryListener):
    """An event log of streams: a row for each micro-batch and each end of a query, appended to a table of files.

    Spark commits each append, so a failed one leaves no rows behind.  Logs are read with :meth:`rows`.
    """

    SCHEMA = "query string, event string, batch bigint, at string, input_rows bigint, state_rows bigint, took_ms bigint, error string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _add(self, *row) -> None:
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = sum(p.durationMs.get(k, 0) for k in ("triggerExecution",))
        self._add(str(p.id), "progress", p.batchId, p.timestamp, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators), took, None)

    def onQueryTerminated(self, event) -> None:
        self._add(str(event.id), "ended", None, None, None, None, None, event.exception)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def _frame(rows, names: list[str], order: str):
    """A group's rows in order of arrival.  Columns come by place: names that Python reserves are lost on the way."""
    import pandas as pd

    return pd.concat([r.set_axis(names, axis=1) for r in rows]).sort_values(order)


class RunningAggregate(StatefulProcessor):
    """The running built-in aggregate of a group: a row for each arrival, in order within a micro-batch."""

    def __init__(self, op: str, field: str, keys: list[str], order: str, name: str) -> None:
        if op not in ("sum", "count", "min", "max", "avg"):
            raise CompileError(f"unknown aggregate {op!r}")
        self.op, self.field, self.keys, self.order, self.name = op, field, keys, order, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("so_far", "n bigint, total double, low double, high double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        frame = _frame(rows, [*self.keys, self.order, self.field], self.order)
        n, total, low, high = self.state.get() if self.state.exists() else (0, 0.0, None, None)
        out = []
        for v in frame[self.field]:
            if v is not None and v == v:
                v = float(v)
                n, total = n + 1, total + v
                low, high = v if low is None else min(low, v), v if high is None else max(high, v)
            out.append({"sum": total if n else None, "count": float(n), "min": low, "max": high, "avg": total / n if n else None}[self.op])
        self.state.update((n, total, low, high))
        yield pd.DataFrame({**dict(zip(self.keys, [[k] * len(out) for k in key], strict=True)), self.order: frame[self.order].to_numpy(), self.name: out})

    def close(self) -> None:
        pass


def running(df: DataFrame, keys: list[str], op: str, field: str, order: str, name: str = "value") -> DataFrame:
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", f"{name} double"])
    return df.select(*keys, order, field).groupBy(*keys).transformWithStateInPandas(RunningAggregate(op, field, keys, order, name), schema, "Append", "None")


class Streaks(StatefulProcessor):
    """Emits a row whenever the last ``length`` labels of a key are equal."""

    def __init__(self, key: str, label: str, order: str, length: int) -> None:
        self.key, self.label, self.order, self.length = key, label, order, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "label string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        frame = _frame(rows, [self.key, self.label, self.order], self.order)
        held = [r[0] for r in self.last.get()] if self.last.exists() else []
        out = []
        for label, at in zip(frame[self.label], frame[self.order], strict=True):
            held = [*held, label][-self.length :]
            if len(held) == self.length and len(set(held)) == 1:
                out.append((key[0], label, self.length, at))
        self.last.put([(h,) for h in held])
        yield pd.DataFrame(out, columns=[self.key, self.label, "streak_length", self.order])

    def close(self) -> None:
        pass


def streaks(df: DataFrame, key: str, label: str, order: str, length: int = 3) -> DataFrame:
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {label} {kinds[label]}, streak_length int, {order} {kinds[order]}"
    return df.select(key, label, order).groupBy(key).transformWithStateInPandas(Streaks(key, label, order, length), schema, "Append", "None")


class BudgetRouter(StatefulProcessor):
    """Adaptive routing of a stream: a router's micro-batch is one scheduling window.

    State: the classes of recent rows, from which the window's further items are forecast, and money or
    time spent.  Rows whose class is null or has no bucket get route 0 and cost nothing.
    """

    def __init__(self, buckets: list, class_col: str, order: str, id_col: str, key: str, per_item: float, history: int = 100, lookahead: Lookahead | None = None, strategy: str = "greedy") -> None:
        if lookahead is not None and lookahead.time_ms is not None:
            raise CompileError("a stream looks ahead by a count of items")
        self.buckets, self.class_col, self.order, self.id_col, self.key, self.per_item, self.history = buckets, class_col, order, id_col, key, per_item, history
        self.lookahead, self.strategy = lookahead, strategy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "items bigint, cost double")
        self.recent = handle.getListState("recent", "class int")

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        from sluice.operators.scheduler import schedule

        frame = _frame(rows, [self.key, self.order, self.id_col, self.class_col], self.order)
        items, cost = self.spent.get() if self.spent.exists() else (0, 0.0)
        held = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        given = [int(c) if c is not None and c == c and 0 <= c < len(self.buckets) else None for c in frame[self.class_col]]
        classes = [c for c in given if c is not None]
        budget = max((items + len(classes)) * self.per_item - cost, 0.0)
        look = Lookahead(max(self.lookahead.count if self.lookahead else 0, len(classes)))
        past = {c: held.count(c) for c in range(len(self.buckets))}
        routes = schedule(classes, self.buckets, past, look, None, len(held), budget, self.strategy)
        cost += sum(b.costs[b.valid.index(p)] for b, p in zip((self.buckets[c] for c in classes), routes, strict=True))
        self.spent.update((items + len(classes), cost))
        self.recent.put([(c,) for c in [*held, *classes][-self.history :]])
        left = iter(routes)
        yield pd.DataFrame({self.key: [key[0]] * len(given), self.id_col: frame[self.id_col].to_numpy(), self.class_col: pd.array(given, "Int32"), "__route": [0 if c is None else next(left) for c in given]})

    def close(self) -> None:
        pass


def budget_route(df: DataFrame, router_key: str, buckets: list, class_col: str, order: str, id_col: str, per_item: float, lookahead: Lookahead | None = None, strategy: str = "greedy") -> DataFrame:
    kinds = dict(df.dtypes)
    schema = f"{router_key} {kinds[router_key]}, {id_col} {kinds[id_col]}, {class_col} int, __route int"
    router = BudgetRouter(buckets, class_col, order, id_col, router_key, per_item, lookahead=lookahead, strategy=strategy)
    return df.select(router_key, order, id_col, class_col).groupBy(router_key).transformWithStateInPandas(router, schema, "Append", "None")
