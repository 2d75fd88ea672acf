"""Joins.  Keys are null-safe and typed: null meets null, and an integer never meets a double.

No side is forced to be broadcast: Catalyst and AQE know the sizes and do it below their threshold, and
AQE splits skewed keys of the shuffled form.  Both go by what is read; where few rows of a key make very many
pairs, ``block_pairs`` deals the pairs to tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.errors import CompileError
from sluice.tables import written

#: Pairs of a block, and blocks up to which each has a partition of its own.
BLOCK_PAIRS, MOST_PARTITIONS = 2_000_000, 20_000
#: Left rows of a block, where its right rows are many.  They come again for each right row, and a short round of rows is
#: small in a compressed file.
ROUND_ROWS = 256


def _keys(left: DataFrame, right: DataFrame, fields: list[str]) -> Column:
    for f in fields:
        for side, df in (("left", left), ("right", right)):
            if f not in df.columns:
                raise CompileError(f"no key {f!r} on the {side} side")
        a, b = left.schema[f].dataType, right.schema[f].dataType
        if a != b:
            raise CompileError(f"key {f!r} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    return reduce(lambda x, y: x & y, [F.col(f"l.`{f}`").eqNullSafe(F.col(f"r.`{f}`")) for f in fields])


def _both(left: DataFrame, right: DataFrame) -> list[Column]:
    """Fields of both sides; of equal names the left side's."""
    return [F.col(f"l.`{c}`") for c in left.columns] + [F.col(f"r.`{c}`") for c in right.columns if c not in left.columns]


def inner_build_right(left: DataFrame, right: DataFrame, fields: list[str], predicate: Column | None = None, block_pairs: int | None = None) -> DataFrame:
    """Rows with equal keys; the left row wins equal names.  ``predicate`` sees sides ``l`` and ``r``.

    With ``block_pairs``, rows of both sides are counted first, and a key of more pairs is dealt to blocks of about so
    many, or of more where there would be more than ``MOST_PARTITIONS`` blocks.
    """
    on = _keys(left, right, fields)
    out = _both(left, right)
    join = lambda a, b, on: a.alias("l").join(b.alias("r"), on if predicate is None else on & predicate, "inner").select(*out)
    if block_pairs is None:
        return join(left, right, on)
    n = [df.groupBy(*[F.col(f"`{f}`") for f in fields]).agg(F.count("*").cast("double").alias("_n")) for df in (left, right)]
    pairs = F.col("l._n") * F.col("r._n")
    many = n[0].alias("l").join(n[1].alias("r"), on).filter(pairs > block_pairs)
    # One row for each key of many pairs.
    many = written(many.select(*[F.col(f"l.`{f}`") for f in fields], F.col("l._n").alias("_nl"), F.col("r._n").alias("_nr")), "many-pairs")
    all_pairs = many.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0]
    if not all_pairs:
        return join(left, right, on)
    # Slices of both sides: a row is written once for each slice of the other side, and with no more blocks than
    # partitions these copies grow with the rows, not with the pairs.
    size = F.lit(max(float(block_pairs), all_pairs / MOST_PARTITIONS))
    of_right = F.least(F.col("_nr"), size / F.least(F.col("_nl"), F.sqrt(size), F.lit(float(ROUND_ROWS))))
    many = many.withColumns({"_rights": F.ceil(F.col("_nr") / of_right), "_lefts": F.ceil(F.col("_nl") / F.least(F.col("_nl"), size / of_right))})
    before = Window.orderBy(*[F.col(f"`{f}`") for f in fields]).rowsBetween(Window.unboundedPreceding, 0)
    many = many.withColumn("_base", F.sum(F.col("_lefts") * F.col("_rights")).over(before) - F.col("_lefts") * F.col("_rights")).drop("_nl", "_nr")
    total = many.agg(F.sum(F.col("_lefts") * F.col("_rights"))).first()[0]
    beside = lambda df: df.alias("l").join(many.alias("r"), _keys(df, many, fields), "left").select(*[F.col(f"l.`{c}`") for c in df.columns], "r._base", "r._lefts", "r._rights")
    a, b = beside(left), beside(right)

    def dealt(df: DataFrame, own: DataFrame, slices: str, blocks: Callable[[Column], Column]) -> DataFrame:
        nth = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in own.dtypes if "map<" not in kind]), F.col(slices))
        return df.filter("_base is not null").withColumn("_block", F.explode(blocks(nth))).repartition(min(total, MOST_PARTITIONS), "_block")

    # A block is one slice of each side of one key, so it alone is compared.
    base, rights = F.col("_base"), F.col("_rights")
    a_blocks = dealt(a, left, "_lefts", lambda i: F.sequence(base + i * rights, base + (i + 1) * rights - 1))
    b_blocks = dealt(b, right, "_rights", lambda i: F.sequence(base + i, base + i + (F.col("_lefts") - 1) * rights, rights))
    met_on = F.col("l._block") == F.col("r._block")
    # Merged with the right side first: each of its rows meets the left slice, whatever the sizes make of a plain join.
    met = b_blocks.alias("r").join(a_blocks.alias("l").hint("merge"), met_on if predicate is None else met_on & predicate).select(*out)
    return met.unionByName(join(a.filter("_base is null"), b.filter("_base is null"), on))


def outer_build_right(left: DataFrame, right: DataFrame, fields: list[str], predicate: Column | None = None) -> DataFrame:
    """All left rows; without a partner that meets keys and predicate the right side's fields are null."""
    on = _keys(left, right, fields)
    if predicate is not None:
        on = on & predicate
    return left.alias("l").join(right.alias("r"), on, "left").select(*_both(left, right))


def double_stream(left: DataFrame, right: DataFrame, predicate: Column | Callable[[DataFrame, DataFrame], Column], fields: list[str] | None = None, within: tuple[str, float] | None = None) -> DataFrame:
    """A theta join of two streams, complete: every pair that meets the predicate, the left row winning.

    Give the equality part as ``fields``, so pairs are looked for within keys only.  ``within`` names a time
    of both sides and how far apart two rows may be before one has left: rows are then looked for in bins
    of time.
    """
    on = predicate(left.alias("l"), right.alias("r")) if callable(predicate) else predicate
    if fields:
        on = _keys(left, right, fields) & on
    if within is None:
        return left.alias("l").join(right.alias("r"), on, "inner").select(*_both(left, right))
    time, bound = within
    a, b = _binned(left, right, time, time, bound, bound, None)
    near = F.col(f"r.`{time}`").between(F.col(f"l.`{time}`") - bound, F.col(f"l.`{time}`") + bound)
    on = on & (F.col("l._bin") == F.col("r._bin")) & near
    return a.alias("l").join(b.alias("r"), on, "inner").select(*_both(left, right))


def _binned(left: DataFrame, right: DataFrame, left_time: str, right_time: str, before: float, after: float, bin_size: float | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_bin``: a left row once in each bin that its range of time touches."""
    size = bin_size or max(before + after, 1)
    times = F.col(f"`{left_time}`")
    bins = F.sequence(F.floor((times - before) / size), F.floor((times + after) / size))
    return left.withColumn("_bin", F.explode(bins)), right.withColumn("_bin", F.floor(F.col(f"`{right_time}`") / size))


def range_join(left: DataFrame, right: DataFrame, fields: list[str], left_time: str, right_time: str, before: float, after: float, bin_size: float | None = None) -> DataFrame:
    """Pairs with equal keys and ``left - before <= right <= left + after``.

    Both sides are dealt to bins of time; a left row goes to each bin that its range touches, so the
    equality join on (keys, bin) spreads a hot key over its bins.
    """
    a, b = _binned(left, right, left_time, right_time, before, after, bin_size)
    near = F.col(f"r.`{right_time}`").between(F.col(f"l.`{left_time}`") - before, F.col(f"l.`{left_time}`") + after)
    on = _keys(left, right, fields) & (F.col("l._bin") == F.col("r._bin")) & near
    return a.alias("l").join(b.alias("r"), on, "inner").select(*_both(left, right))
