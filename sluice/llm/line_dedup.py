"""Line dedup: windows of three consecutive lines that repeat anywhere lose their later occurrences.

Only DataFrame operations are used.  A window is two hashes of its lines; its first occurrence is the one
first in order of (id, text hash, copy, place).  The positions that later occurrences cover are merged
and their lines dropped; a line so dropped always stands at an earlier place that is kept.  Windows of
blank lines only do not count.  Texts themselves are moved once, to meet their covered positions.

Defined results: a null text stays null and an empty one empty; texts of fewer than three lines have no
window and stay whole; null ids come first in order; rows equal in every column are copies of each other
and all but one lose what repeats; an empty table gives no rows; further columns come back untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import need, written

LINES = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_row, text, n_lines, n_removed``: the row's own columns, its text without later occurrences."""
    need(docs, id_col, text_col)
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(*plain).alias("_hash"),
        F.hash(*plain).alias("_more"),
    )
    text = F.col(f"_row.`{text_col}`")
    lines = F.split(text, "\n")
    # Rows equal in all columns share their key, 96 bits of hashes.
    # A line is known by two unlike hashes, 96 bits, so that no two lines of a large corpus are mistaken.
    hashed = rows.select("_id", "_hash", "_more", F.transform(lines, lambda s: F.struct(F.xxhash64(F.trim(s)).alias("h"), F.hash(F.trim(s)).alias("k"))).alias("_l"), F.transform(lines, lambda s: F.trim(s) == "").alias("_blank"))
    hashed = hashed.filter(F.size("_l") >= LINES)
    place = F.sequence(F.lit(0), F.size("_l") - LINES)
    of = lambda name, i: [F.get("_l", i + n)[name] for n in range(LINES)]
    blank = lambda i: F.get("_blank", i) & F.get("_blank", i + 1) & F.get("_blank", i + 2)
    window = F.transform(place, lambda i: F.struct(i.alias("at"), F.when(~blank(i), F.xxhash64(*of("h", i))).alias("w"), F.xxhash64(*of("k", i)).alias("c")))
    windows = hashed.select("_id", "_hash", "_more", F.explode(window).alias("_w")).select("_id", "_hash", "_more", F.col("_w.at").alias("_at"), F.col("_w.w").alias("_window"), F.col("_w.c").alias("_check")).filter("_window is not null")
    same = ["_window", "_check"]
    first = windows.groupBy(*same).agg(F.min(F.struct("_id", "_hash", "_at")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # Written before the join: between two plain shuffles a very common window may be split over tasks.
    met = windows.join(written(first, "windows"), same)
    later = ~(F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_hash") == F.col("_first._hash")) & (F.col("_at") == F.col("_first._at")))
    # A first copy loses what is later in it; further copies of the same row lose all that repeats.
    marks = met.groupBy("_hash", "_more").agg(F.collect_set(F.when(later, F.col("_at"))).alias("_later"), F.collect_set("_at").alias("_all"))
    nth = F.row_number().over(Window.partitionBy("_hash", "_more").orderBy(F.lit(1)))
    # Both hashes deal both sides, so that the window finds its rows where they are: texts move once.
    joined = rows.join(marks, ["_hash", "_more"], "left").withColumn("_copy", nth)
    covered = F.flatten(F.transform(F.when(F.col("_copy") == 1, F.col("_later")).otherwise(F.col("_all")), lambda i: F.array(i, i + 1, i + 2)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    out = joined.withColumn("_kept", F.when(F.size(covered) > 0, kept))
    short = F.transform("_kept", lambda i: F.get(lines, i))
    return out.select("_row", F.when(F.col("_kept").isNull(), text).otherwise(F.array_join(short, "\n")).alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("n_removed"))
