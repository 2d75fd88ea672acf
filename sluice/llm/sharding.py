"""Sharding by jump consistent hashing: a stable key and the shard count decide, without a ring table.

One more shard takes rows only into itself.  Places inside a shard are gapless: rows are counted in
hashed buckets of the shard, the buckets' counts give offsets, and only a bucket is ever sorted.

Defined results: a null text has no bytes; null keys share one shard; repeated rows each get a place
of their own; equal places are broken by id, checksum and size; an empty table gives no rows;
further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import need, written

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
_LCG = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0 to ``shards - 1`` of unsigned 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * _LCG + np.uint64(1)
        step = (shard[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead[live] = step.astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def _place(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)
            cols = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(jump_hash(key, shards), pa.int32()), pa.array(jump_hash(key, shards + 1), pa.int32())], names=[*b.schema.names, "shard", "grown_shard"])

    return run


def shard(docs: DataFrame, shards: int = 40, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``buckets``: into how many parts each shard's rows are dealt for numbering; a part is sorted by
    one task, so at 100 TB take rows / (shards * 10 million).  ``key_col``: the stable key, else the id.
    """
    need(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(key_col or id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key"))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    placed = rows.mapInArrow(_place(shards), f"{kinds}, shard int, grown_shard int").withColumn("_part", F.pmod(F.xxhash64(F.lit(7), "doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    placed = written(placed.drop("_key"), "shards")
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size"))
    # At most shards * buckets rows, whatever the input.
    return placed.withColumn("_nth", nth).join(F.broadcast(before), ["shard", "_part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_nth") - 1).cast("long").alias("slot"), "grown_shard")
