"""Exact top-k search by integer inner product, over a bit-sliced index.

Components are quantised to whole numbers.  The index keeps, for a block of rows, a bitmap of the rows for each
bit of each component (above the block's least value of it), and is written to the shared folder.  A query's
weights become signed powers of two, at most one for two bits, so that its scores are a sum of shifted slices;
a negative power adds the slice's complement and a constant.  Slices of equal weight are added as bitmaps, three
into two at a time, until one slice is left for each bit of the score.  The best rows are then chosen from the
most significant slice downward; rows of a block stand in order of their ids, so the rows that tie at the
boundary are resolved exactly by taking the first of them.  Scores are read from the slices of the sum.

Queries meet the index in tasks of one group of queries and one range of blocks each, of bounded sizes; a task
hands on the k best of its range for each query, and these are ranked.  No score is ever rounded, so an
overflow of 64 bits is an error.

Defined results: a null vector and one with a null or non-finite component take no part; a vector without
components scores 0 with others like it; vectors of different lengths never meet; repeated rows are candidates
of each other, a row is none of its own; a null id asks nothing and ranks last among equal scores; fewer
candidates than k are all returned; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.batches import ragged, runs
from sluice.llm.common import need, written

#: Quantisation steps of a unit.
SCALE = 64
#: Rows of a block, blocks that a task goes through, and queries of a task.
BLOCK_ROWS, RANGE_BLOCKS, GROUP_QUERIES = 1 << 16, 16, 4096
#: Queries below which a group is not made smaller to occupy more cores, and tasks of a stage at most.
LEAST_QUERIES, MOST_TASKS = 16, 50_000

_INDEX = "_block int, _dim int, _named int, _ids array<long>, _rids array<long>, _low array<long>, _width array<int>, _slices binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """Rows ``vec_id, _q`` of the vectors that take part, ``_q`` being the floors of the scaled components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.coalesce(v.isNotNull() & plain, F.lit(False)))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("_q"))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, the first bit lowest."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    return np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view("<u8")


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _widths(span: np.ndarray) -> np.ndarray:
    """Bits that whole numbers up to ``span`` take."""
    return np.array([int(s).bit_length() for s in span], np.int32)


def _fits(x: np.ndarray) -> np.ndarray:
    if x.size and max(int(x.max()), -int(x.min())) >= 1 << 40:
        raise OverflowError("components this large do not keep scores within 64 bits")
    return x


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the index for each block of rows, which come sorted by block, length and id."""
    for g in runs(batches, ["_block", "_dim"]):
        dim, ids = g.column("_dim")[0].as_py(), g.column("vec_id").combine_chunks()
        x = _fits(ragged(g.column("_q"))[0].reshape(len(g), dim))
        low = x.min(0) if dim else np.zeros(0, np.int64)
        x = x - low
        width = _widths(x.max(0) if dim else low)
        bits = [(x[:, j] >> b) & 1 for j in range(dim) for b in range(width[j])]
        slices = _packed(np.array(bits, bool).reshape(len(bits), len(g)))
        row = [g.column("_block")[0].as_py(), dim, len(ids) - ids.null_count, ids.fill_null(0).to_numpy(), g.column("_rid").to_numpy(), low, width, slices.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])


def powers(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``weights`` as signed powers of two, no two of them next to each other: component, power, sign."""
    left, found, power = weights.astype(np.int64), [], 0
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        own = np.flatnonzero(digit)
        found.append((own, np.full(len(own), power), digit[own]))
        left, power = (left - digit) >> 1, power + 1
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def add_slices(slices: np.ndarray, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sum of ``slices[which] << weight`` for every row, as slices from the least significant on."""
    order = np.argsort(weight, kind="stable")
    which, ends = which[order], np.searchsorted(weight[order], np.arange((weight.max() if len(weight) else 0) + 2))
    out, carried, bit = [], [], 0
    while bit < len(ends) - 1 or carried:
        parts, carried = carried, []
        if bit < len(ends) - 1 and ends[bit + 1] > ends[bit]:
            parts = [*parts, slices[which[ends[bit] : ends[bit + 1]]]]
        now = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((1, slices.shape[1]), np.uint64)
        while len(now) > 1:
            n = len(now) // 3
            if n:
                a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
                either = a ^ b
                carried.append((a & b) | (either & c))
                now = np.concatenate([either ^ c, now[3 * n :]]) if len(now) > 3 * n else either ^ c
            else:
                carried.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
        out.append(now[0])
        bit += 1
    return np.array(out)


def best_rows(total: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest sums among ``candidates``; of rows that tie at the end, the first."""
    if int(np.bitwise_count(candidates).sum()) <= k:
        return _places(candidates)
    sure, tied = np.zeros_like(candidates), candidates
    for part in total[::-1]:
        more = sure | (tied & part)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            tied = tied & part
        else:
            sure, tied = more, tied & ~part
            if n == k:
                return _places(sure)
    sure = _places(sure)
    return np.concatenate([sure, _places(tied)[: k - len(sure)]])


def _search(k: int):
    """The best of a range of blocks for a group of queries."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        asked = []
        if len(index):
            values, offsets = ragged(queries.column("_q"))
            for q in range(len(queries)):
                w = _fits(values[offsets[q] : offsets[q + 1]])
                asked.append((q, w, *powers(w)))
        rid = queries.column("_rid").to_numpy()
        for b in range(len(index)):
            block = {c: index.column(c)[b].values.to_numpy() for c in ("_ids", "_rids", "_low", "_width")}
            dim, named, n = index.column("_dim")[b].as_py(), index.column("_named")[b].as_py(), len(block["_rids"])
            low, width = block["_low"], block["_width"].astype(np.int64)
            slices = np.frombuffer(index.column("_slices")[b].as_buffer(), "<u8").reshape(int(width.sum()), -(-n // 64))
            start, all_rows = np.cumsum(width) - width, _packed(np.ones(n, bool))
            both = np.concatenate([slices, ~slices])
            order = np.argsort(block["_rids"])
            at = np.searchsorted(block["_rids"][order], rid)
            own = np.where((at < n) & (block["_rids"][order][np.minimum(at, n - 1)] == rid), order[np.minimum(at, n - 1)], -1)
            widest = int(max(np.abs(low).max(initial=0), (np.abs(low) + (1 << width)).max(initial=0)))
            for q, w, component, power, sign in asked:
                if len(w) != dim:
                    continue
                if 4 * dim * (int(np.abs(w).max(initial=0)) + 1) * (widest + 1) >= 1 << 62:
                    raise OverflowError("an inner product may leave 64 bits")
                size, minus = width[component], sign < 0
                nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                which = np.repeat(start[component] + minus * len(slices), size) + nth
                total = add_slices(both, which, np.repeat(power, size) + nth)
                candidates = all_rows
                if own[q] >= 0:
                    candidates = all_rows.copy()
                    candidates[own[q] >> 6] &= ~np.uint64(1 << (int(own[q]) & 63))
                place = best_rows(total, candidates, k)
                bits = (total[:, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
                constant = int(w @ low) - int(((1 << power[minus]) * ((1 << size[minus]) - 1)).sum())
                score = (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(0) + constant
                found.append((np.full(len(place), q), score, block["_ids"][place], place >= named))
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in ("_rid", "query_id", "vec_id", "score")})
        q, score, ids, unnamed = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((ids, unnamed, -score, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
        names = queries.column("vec_id").combine_chunks().take(pa.array(q[order]))
        return pa.table({"_rid": rid[q[order]], "query_id": names, "vec_id": pa.array(ids[order], mask=unnamed[order]), "score": score[order]})

    return run


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """The written index of ``_rid, vec_id, _q`` in about ``blocks`` blocks."""
    placed = rows.withColumns({"_block": F.pmod(F.xxhash64("_rid"), F.lit(blocks)).cast("int"), "_dim": F.size("_q")})
    placed = placed.repartition("_block").sortWithinPartitions("_block", "_dim", F.asc_nulls_last("vec_id"))
    return written(placed.mapInArrow(_slice, _INDEX), "bit-slices")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each id divisible by ``every``."""
    need(vectors, id_col, vector_col)
    # Written, so that a row's number is the same in every task.
    rows = written(quantised(vectors, id_col, vector_col, scale).withColumn("_rid", F.monotonically_increasing_id()), "quantised")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    index = build_index(rows, blocks)
    ranges, cores = -(-blocks // RANGE_BLOCKS), vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_asked // GROUP_QUERIES), min(-(-n_asked // LEAST_QUERIES), -(-8 * cores // ranges)))
    tasks = min(groups * ranges, MOST_TASKS)
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("_g", F.pmod(F.xxhash64(F.lit(3), "_rid"), F.lit(groups)).cast("int")).withColumn("_r", each(ranges)).repartition(tasks, "_g", "_r")
    right = index.withColumn("_r", F.pmod("_block", F.lit(ranges)).cast("int")).withColumn("_g", each(groups)).repartition(tasks, "_g", "_r")
    best = left.groupBy("_g", "_r").cogroup(right.groupBy("_g", "_r")).applyInArrow(_search(k), "_rid long, query_id long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
