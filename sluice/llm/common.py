"""What the training-data operators share: the shared folder, written tables and sizes."""

from __future__ import annotations

import getpass
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of small, fixed-width records up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file:///tmp/checkpoints/sluice-{getpass.getuser()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written within each open :func:`tidied` block of this thread of work, innermost last.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and ids made in it are fixed."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _OPEN.get():
        _OPEN.get()[-1].append(out)
    return out


@contextmanager
def tidied() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the tables written inside, at the end, but those that the given function is told to keep."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    own: list[DataFrame] = []
    before = _OPEN.set((*_OPEN.get(), own))
    try:
        yield keep
    finally:
        _OPEN.reset(before)
        for df in own:
            if not any(df is k for k in kept):
                drop_written(df)
            elif _OPEN.get():
                _OPEN.get()[-1].append(df)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written`, once nothing reads it any more."""
    delete(df.sparkSession, df.written_to)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows.  It counts only as far as needed."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its checked size allows it, else as it is (the join then shuffles)."""
    return F.broadcast(df) if is_small(df, rows) else df


def need(df: DataFrame, *columns: str) -> None:
    """Check an operator's columns, and keep Arrow batches of whole texts small.

    Batches are bounded by bytes: the session's bound is lowered to BATCH_BYTES if it is higher, which
    changes memory and no result.  A single longer text is a batch of its own.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
