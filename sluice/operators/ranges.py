"""Ordered work on keys of any size: positions, running totals and frames over the last rows.

A window puts all rows of a key into one task.  That is the best plan while keys are many and small, and it is
what these functions do then.  Where some key has more than HOT_ROWS rows, rows are dealt to ranges of (keys,
order) of about RANGE_ROWS instead, sorted and numbered in one pass, and written once; a key may then span any
number of ranges, and a range is the work of one task.  What crosses a range's border is small:

* a running total needs the totals of its key in the ranges before, one row for each border that a key spans;
* a frame of the last n rows needs the n - 1 rows before the range, which are copied to it (a halo);
* a position needs the counts of the ranges before.

Totals over a stretch of time (:func:`recent`) go by blocks of time as long as the stretch, so no row is met once for
each frame that holds it.

Streams keep the plain window's plan.  Rows that are equal in keys and order are numbered in any order, but in
one order: it is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.tables import written

#: Rows of a range, and rows of one key up to which a plain window takes it.
RANGE_ROWS, HOT_ROWS = 1_000_000, 4_000_000
#: Ranges whose borders are broadcast; beyond, they are joined with a shuffle.
BROADCAST_RANGES = 100_000
#: Bits of a number within its range.
_BITS = 33


def has_hot_key(df: DataFrame, keys: list[str], most: int | None = None) -> bool:
    """Whether some key has more than HOT_ROWS rows, or ``most``; keys are counted only if the whole input has."""
    most = HOT_ROWS if most is None else most
    if df.isStreaming or df.count() <= most:
        return False
    return not df.groupBy(*_cols(keys)).count().filter(F.col("count") > most).isEmpty()


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def deal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` written in ranges of (keys, order), with ``_id``, ascending through all of them, and ``_range``.

    Ids of a range are without gaps, and so are a key's within it.
    """
    if not order:
        raise CompileError("an order of arrival is needed")
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    by = _cols([*keys, *order])
    dealt = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return written(dealt, "ranges").withColumn("_range", F.shiftright("_id", _BITS).cast("int"))


def _beside(rows: DataFrame, borders: DataFrame) -> DataFrame:
    """Rows with what is known of their range, at most one row for each."""
    small = borders.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    return rows.join(F.broadcast(borders) if small else borders, "_range", "left")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Places from 0 within keys, in order; without keys, through all rows."""
    if keys and not has_hot_key(df, keys):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))).cast("long") - 1)
    dealt = deal(df, keys, order)
    n = dealt.groupBy(*_cols(keys), "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    earlier = Window.partitionBy(*_cols(keys)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Without keys this window has one row for each range.
    before = n.withColumn("_before", F.sum("_n").over(earlier)).filter("_before is not null").select("_range", "_last", "_before")
    placed = _beside(dealt, before)
    within = F.col("_id") - F.shiftleft(F.col("_range").cast("long"), _BITS)
    if keys:
        within = F.row_number().over(Window.partitionBy("_range", *_cols(keys)).orderBy("_id")).cast("long") - 1
    carried = F.when(F.col("_id") <= F.col("_last"), F.col("_before"))
    return placed.withColumn(name, within + F.coalesce(carried, F.lit(0).cast("long"))).drop("_id", "_range", "_last", "_before")


TOTALS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _together(op: str, before: Column, own: Column) -> Column:
    if op in ("sum", "count"):
        return F.coalesce(before + own, own, before)
    return F.least(before, own) if op == "min" else F.greatest(before, own)


def running(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]], hot: bool | None = None) -> DataFrame:
    """``df`` with a running total for each name: (sum, count, min or max, of a column), from its key's first row on.

    ``hot`` says whether some key is, where that is known.
    """
    for op, _ in totals.values():
        if op not in TOTALS:
            raise CompileError(f"unknown total {op!r}")
    if not (has_hot_key(df, keys) if hot is None else hot):
        so_far = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: TOTALS[op](c).over(so_far) for name, (op, c) in totals.items()})
    dealt = deal(df, keys, order)
    of_range = dealt.groupBy(*_cols(keys), "_range").agg(F.max("_id").alias("_last"), *[TOTALS[op](c).alias(f"_t{i}") for i, (op, c) in enumerate(totals.values())])
    earlier = Window.partitionBy(*_cols(keys)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A key's rows before a range end where the range begins, so of a range only its first key has any.
    carried = {f"_b{i}": (F.sum if op in ("sum", "count") else TOTALS[op])(f"_t{i}").over(earlier) for i, (op, _) in enumerate(totals.values())}
    borders = of_range.withColumns({"_before": F.count("*").over(earlier), **carried}).filter("_before > 0").select("_range", "_last", *carried)
    within = Window.partitionBy("_range", *_cols(keys)).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _beside(dealt, borders).withColumns({f"_o{i}": TOTALS[op](c).over(within) for i, (op, c) in enumerate(totals.values())})
    inside = F.col("_id") <= F.col("_last")
    made = {name: _together(op, F.when(inside, F.col(f"_b{i}")), F.col(f"_o{i}")) for i, (name, (op, _)) in enumerate(totals.items())}
    return rows.withColumns(made).select(*_cols(df.columns), *_cols([n for n in totals if n not in df.columns]))


def framed(df: DataFrame, keys: list[str], order: list[str], before: int, plain: Callable[[DataFrame, list[str], list[str]], DataFrame]) -> DataFrame:
    """``plain(df, keys, order)``, whose rows look at no more than ``before`` rows of their key before them.

    ``plain`` must keep all columns and all rows; it is called with further keys where a key is hot.
    """
    if before < 1 or not has_hot_key(df, keys):
        return plain(df, keys, order)
    dealt = deal(df, keys, order)
    parts = dealt.groupBy(*_cols(keys), "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    in_key = Window.partitionBy(*_cols(keys)).orderBy("_range")
    parts = parts.withColumn("_through", F.sum("_n").over(in_key.rowsBetween(Window.unboundedPreceding, 0)))
    # Each further range of the key holds a row at least, so none beyond the next ``before`` can need rows of this one.
    later = F.collect_list(F.struct(F.col("_range").alias("to"), (F.col("_through") - F.col("_n")).alias("start"))).over(in_key.rowsBetween(1, before))
    parts = parts.withColumn("_next", F.transform(later, lambda r: F.struct(r["to"].alias("to"), (before - (r["start"] - F.col("_through"))).alias("rows"))))
    borders = parts.withColumn("_next", F.filter("_next", lambda r: r["rows"] > 0)).filter(F.size("_next") > 0).select("_range", "_first", "_last", "_next")
    tails = _beside(dealt, borders).filter((F.col("_id") >= F.col("_first")) & (F.col("_id") <= F.col("_last")))
    needed = F.filter("_next", lambda r: F.col("_id") > F.col("_last") - r["rows"])
    halo = tails.withColumn("_to", F.explode(needed)).withColumn("_range", F.col("_to.to")).select(*dealt.columns)
    both = dealt.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    return plain(both, [*keys, "_range"], order).filter("_own").drop("_own", "_id", "_range")


def recent(df: DataFrame, keys: list[str], at: str, places: list[str], length: float, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with a total for each name over its key's rows from ``at - length`` on, up to the row itself.

    (``at``, ``places``), numbers, tell a key's rows apart and give their order.  Time is cut to blocks a little longer
    than ``length``: what a row looks back on is its own block's rows up to it, and the end of the block before from
    the first row that is near enough.  Both are running totals, one of them from the end, and that first row is
    looked up by a third; nothing is subtracted.  A null time meets null times only.
    """
    order = [at, *places]
    back = [f"_back{i}" for i in range(len(order))]
    blocked = df.withColumns({"_block": F.floor(F.col(f"`{at}`") / (length + 1)), **{b: -F.col(f"`{c}`") for b, c in zip(back, order, strict=True)}})
    by = [*keys, "_block"]
    # Three windows over the rows: a task takes fewer of them.
    hot = has_hot_key(blocked, by, min(HOT_ROWS, RANGE_ROWS))
    made = running(blocked, by, order, {f"_own{i}": t for i, t in enumerate(totals.values())}, hot)
    made = running(made, by, back, {f"_rest{i}": t for i, t in enumerate(totals.values())}, hot)
    # Each row once as itself, and once as what the next block's rows may begin with; at equal times the latter comes first.
    found = F.struct(*_cols(order), *[F.col(f"_rest{i}") for i in range(len(totals))])
    asks = F.struct(F.col("_block").alias("block"), (F.lit(length) - F.col(f"`{at}`")).alias("key"), F.lit(1).alias("asks"), F.lit(None).cast(made.select(found.alias("f")).schema["f"].dataType).alias("found"))
    tells = F.struct((F.col("_block") + 1).alias("block"), F.col("_back0").alias("key"), F.lit(0).alias("asks"), found.alias("found"))
    both = made.withColumn("_as", F.explode(F.when(F.col(f"`{at}`").isNull(), F.array(asks)).otherwise(F.array(asks, tells)))).withColumns({"_block": F.col("_as.block"), "_key": F.col("_as.key"), "_asks": F.col("_as.asks"), "_found": F.col("_as.found")})
    both = running(both.drop("_as", *back, *[f"_rest{i}" for i in range(len(totals))]), by, ["_key", "_asks"], {"_first": ("min", F.col("_found"))}, hot)
    out = {name: _together(op, F.col(f"_first._rest{i}"), F.col(f"_own{i}")) for i, (name, (op, _)) in enumerate(totals.items())}
    return both.filter("_asks = 1").withColumns(out).select(*_cols(df.columns), *_cols([n for n in totals if n not in df.columns]))
