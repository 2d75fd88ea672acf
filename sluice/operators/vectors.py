"""Nearest-neighbour joins: exact, in double precision, with matrices over Arrow batches.

Both sides are dealt to blocks of bounded size, and each pair of blocks is compared by a task of its own;
a lookup vector keeps its best ``k`` of each block of the index, and these are merged.  Neither side goes
through the driver.  Equal lookup vectors are searched for once, and rows meet their result by the vector
itself, so nothing depends on row numbers that a repeated task might give anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.errors import CompileError

#: Index rows of a block, and distances that a task holds at once.
BLOCK_ROWS, TILE = 50_000, 1 << 20


def _matrix(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows of the vectors of ``dim`` finite components (None: of any length, the rows left out)."""
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(size >= 0 if dim is None else size == dim)
    picked = column.take(pa.array(own)).flatten().cast(pa.float64())
    good = np.isfinite(picked.fill_null(float("nan")).to_numpy(zero_copy_only=False))
    ends = np.cumsum(size[own])
    bad = np.append(0, np.cumsum(~good))
    valid = bad[ends] == bad[ends - size[own]]
    if dim is None:
        return own[valid], np.zeros((valid.sum(), 0))
    x = picked.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dim)
    return own[valid], x[valid]


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(np.maximum(((q[:, None, :] - x[None, :, :]) ** 2).sum(2), 0)) if q.size * len(x) <= 1 << 22 else np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0))
    if metric == "cosine":
        return 1 - (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
    raise CompileError(f"unknown metric {metric!r}")


def nearest(lookup: DataFrame, index: DataFrame, k: int, id_col: str, vector_col: str, lookup_vector: str, metric: str = "euclidean", normalise: bool = True, unit_index: float | None = None, block_rows: int = BLOCK_ROWS, carry: str | None = None) -> DataFrame:
    """``lookup`` with ``_near``: its ``k`` nearest as structs (distance, id, carried), nearest first, ties to the lower id.

    ``normalise`` scales lookup vectors to length 1.  ``unit_index`` leaves out index rows whose length
    differs from 1 by more.  ``carry`` names a column of the index that comes along.  Null lookup vectors,
    those with null or non-finite components, and those of a length that no index vector has, have a null
    ``_near``; without any index rows it is empty.  Index rows with a null or non-finite vector are left out.
    """
    kind = index.schema[id_col].dataType.simpleString()
    carried = F.col(f"`{carry}`") if carry else F.lit(None).cast("string")
    held = index.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{vector_col}`").alias("v"), carried.alias("c")).filter(F.col("v").isNotNull())
    kept = held.schema["c"].dataType.simpleString()
    asked = lookup.select(F.col(f"`{lookup_vector}`").alias("_q")).filter(F.col("_q").isNotNull()).distinct()
    blocks, parts = (max(1, -(-df.count() // block_rows)) for df in (held, asked))
    dealt = held.withColumns({"_b": F.pmod(F.xxhash64("i"), F.lit(blocks)), "_l": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})
    told = asked.withColumns({"_l": F.pmod(F.xxhash64("_q"), F.lit(parts)), "_b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    near = f"array<struct<distance:double,id:{kind},carried:{kept}>>"
    search = block_search(k, metric, normalise, unit_index, [to_arrow_type(held.schema[c].dataType) for c in ("i", "c")], to_arrow_type(asked.schema["_q"].dataType))
    found = dealt.groupBy("_b", "_l").cogroup(told.groupBy("_b", "_l")).applyInArrow(search, f"_q {asked.schema['_q'].dataType.simpleString()}, _n {near}")
    if blocks > 1:
        found = found.groupBy("_q").agg(F.array_sort(F.flatten(F.collect_list("_n"))).alias("_n"))
    return lookup.join(found, lookup[lookup_vector] == found["_q"], "left").withColumn("_near", F.slice("_n", 1, k)).drop("_q", "_n")


def block_search(k: int, metric: str, normalise: bool, unit_index: float | None, kinds: list[pa.DataType], asked: pa.DataType):
    """The ``k`` nearest rows of a block of the index for the vectors of a block of lookups."""
    near_type = pa.list_(pa.struct([("distance", pa.float64()), ("id", kinds[0]), ("carried", kinds[1])]))

    def run(index: pa.Table, lookup: pa.Table) -> pa.Table:
        ids, carried, given = index.column("i").to_pylist(), index.column("c").to_pylist(), lookup.column("_q").combine_chunks()
        vectors = index.column("v").combine_chunks()
        sizes = set(pc.unique(pc.list_value_length(vectors)).to_pylist()) - {None}
        out, near = [], []
        for dim in sizes or {None}:
            own, x = _matrix(vectors, dim)
            # A null id comes last among equal distances.
            order = np.array(sorted(range(len(own)), key=lambda i: (False, ids[own[i]]) if ids[own[i]] is not None else (True,)), np.int64)
            own, x = own[order], x[order]
            if unit_index is not None and len(x):
                keep = np.flatnonzero(np.abs(1 - np.linalg.norm(x, axis=1)) <= unit_index)
                x, own = x[keep], own[keep]
            rows, asked_x = _matrix(given, dim)
            step = max(1, min(256, TILE // max(1, len(x))))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                out.append(part)
                if not len(x):
                    near += [[] for _ in part]
                    continue
                q = asked_x[at : at + step]
                if normalise:
                    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                for d in distances(q, x, metric):
                    best = np.argpartition(d, k - 1)[:k] if k < len(d) else np.arange(len(d))
                    # Ties at the last place go to the lower id, as rows are in order of id.
                    best = np.flatnonzero(d <= d[best].max())
                    best = best[np.lexsort((best, d[best]))][:k]
                    near.append([{"distance": float(d[b]), "id": ids[own[b]], "carried": carried[own[b]]} for b in best])
        taken = given.take(pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
        return pa.table([taken.cast(asked), pa.array(near, near_type)], names=["_q", "_n"])

    return run


def vector_join(lookup: DataFrame, index: DataFrame, join_kind: str = "inner", topk: int = 5, keep_n_matches: int = 5, distance_threshold: float = float("inf"), metric: str = "euclidean", id_col: str = "id", vector_col: str = "embedding", passage_col: str | None = None, lookup_vector: str = "embedding", normalise: bool = True) -> DataFrame:
    """One row for each lookup row, with ``match_ids``, ``match_distances`` and ``passages`` as lists.

    Matches stay while they are nearer than the threshold (strictly) and at most ``keep_n_matches``.
    ``inner`` keeps rows without a match, with empty lists; ``outer_right`` looks for one match and
    gives nulls without one.  Null or invalid vectors give nulls.
    """
    topk, keep_n_matches = matches_asked(join_kind, topk, keep_n_matches)
    found = nearest(lookup, index, topk, id_col, vector_col, lookup_vector, metric, normalise, carry=passage_col)
    return match_lists(found, join_kind, keep_n_matches, distance_threshold, passage_col is not None)


def matches_asked(join_kind: str, topk: int, keep_n_matches: int) -> tuple[int, int]:
    if join_kind not in ("inner", "outer_right"):
        raise CompileError(f"unknown vector join {join_kind!r}")
    return (1, 1) if join_kind == "outer_right" else (topk, keep_n_matches)


def match_lists(found: DataFrame, join_kind: str, keep_n_matches: int, distance_threshold: float, passages: bool) -> DataFrame:
    """The lists of a vector join from ``_near``."""
    kept = F.slice(F.filter("_near", lambda m: m["distance"] < F.lit(float(distance_threshold))), 1, keep_n_matches)
    kept = F.when(F.size(kept) > 0, kept) if join_kind == "outer_right" else kept
    out = found.withColumn("_kept", kept)
    made = {"match_ids": F.transform("_kept", lambda m: m["id"].cast("string")), "match_distances": F.transform("_kept", lambda m: m["distance"])}
    if passages:
        made["passages"] = F.transform("_kept", lambda m: m["carried"])
    return out.withColumns(made).drop("_near", "_kept")


#: Thresholds of the in-memory lookups by size of the model (fixed values).
LOOKUP_THRESHOLDS = {"tiny": 0.95, "small": 1.01, "large": 0.98, "huge": 0.79}


def top1_lookup(lookup: DataFrame, index: DataFrame, threshold: float, id_col: str, vector_col: str, lookup_vector: str) -> DataFrame:
    """The nearest index row of unit length: ``match_ids`` and ``closest_distances``, or empty lists beyond the threshold."""
    found = nearest(lookup, index, 1, id_col, vector_col, lookup_vector, "euclidean", True, 0.05)
    best = F.get("_near", F.lit(0))
    hit = best.isNotNull() & (best["distance"] <= threshold)
    return found.withColumns({
        "match_ids": F.when(hit, F.array(best["id"].cast("string"))).otherwise(F.array().cast("array<string>")),
        "closest_distances": F.when(hit, F.array(best["distance"])).otherwise(F.array().cast("array<double>")),
    }).drop("_near")
