"""Best-fit packing planned over a length histogram.

Texts become token ids plus an end id; longer ones are cut into full pieces.  Pieces are written once
with the task that made them and their rank among that task's pieces of equal length.  The plan is
best-fit decreasing over counts, not documents: bins with equal room are one group, and a length fills
as many bins of a group as it can at once, so planning costs what the lengths cost, not the rows.
Pieces then take planned slots by their rank within their length: a task's first rank comes from the
other tasks' counts.

Defined results: a null or empty text is one piece, the end id; repeated rows are packed each; a null
doc_id stays null; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import maybe_broadcast, need, written
from sluice.llm.tokenizing import encoder

END_ID = 1
PIECES = "doc_id {id}, piece int, start long, length int, ids binary, _task int, _nth long"
_ROWS = 2000


def _cut(path: str, capacity: int, end_id: int):
    full, end = capacity * 4, np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                row, piece, start, length, ids, nth = [], [], [], [], [], []
                for i, blob in enumerate(encoder(path).blobs(part.column("_text").to_pylist())):
                    blob += end
                    for k, s in enumerate(range(0, len(blob), full)):
                        cut = blob[s : s + full]
                        n = len(cut) // 4
                        row.append(i), piece.append(k), start.append(s // 4), length.append(n), ids.append(cut), nth.append(seen[n])
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())], names=["doc_id", "piece", "start", "length", "ids", "_task", "_nth"])

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Gives steps ``(length, first rank, ranks, first sequence, ranks a sequence, offset)``: the ranks
    from ``first rank`` of a length fill sequences from ``first sequence``, so many in each, from
    ``offset``.  Groups are runs of sequences with equal room and equal fill.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, sequences)
    rooms: list[int] = []
    steps, made = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            heapq.heappush(room[left], (first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                first, n = heapq.heappop(room[space])
                if not room[space]:
                    del room[space]
                    rooms.pop(at)
            else:
                each = capacity // length
                space, first, n = capacity, made, -(-left // each)
                made += n
            each = space // length
            whole = min(n, left // each)
            offset = capacity - space
            if whole:
                steps.append((length, rank, whole * each, first, each, offset))
                put(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n:
                if 0 < left < each:
                    steps.append((length, rank, left, first + whole, left, offset))
                    put(space - left * length, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                put(space, first + whole, n - whole)
    return steps


def _slots(steps: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(steps), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_length = {int(k): (int(a), int(b)) for k, a, b in zip(*(lambda u, i, c: (u, i, i + c))(*np.unique(table[:, 0], return_index=True, return_counts=True)), strict=True)}
        for b in batches:
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("_rank").to_numpy()
            step = np.empty(len(rank), np.int64)
            for k in np.unique(length):
                lo, hi = at_length[int(k)]
                mine = length == k
                step[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], side="right") - 1
            s = table[step]
            into = rank - s[:, 1]
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s[:, 3] + into // s[:, 4]), pa.array(s[:, 5] + into % s[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids, sequence_id, offset``; ids: little-endian unsigned 32-bit."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = dict(texts.dtypes)["doc_id"]
    pieces = written(texts.mapInArrow(_cut(tokenizer_path, capacity, end_id), PIECES.format(id=kind)), "pieces")
    counts = written(pieces.groupBy("_task", "length").agg(F.count("*").alias("_n")), "lengths")
    # One row a length, so at most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    steps = plan(histogram, capacity)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task")) - F.col("_n")
    ranked = pieces.join(maybe_broadcast(counts.select("_task", "length", before.alias("_before"))), ["_task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("_before") + F.col("_nth")).alias("_rank"))
    if not steps:
        return ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", F.col("_rank").alias("sequence_id"), F.col("_rank").alias("offset"))
    told = spark.sparkContext.broadcast(steps)
    slots = lambda batches: _slots(told.value)(batches)
    out = ranked.mapInArrow(slots, f"doc_id {kind}, piece int, start long, length int, ids binary, sequence_id long, offset long")
    return out.withColumn("length", F.col("length").cast("long"))
