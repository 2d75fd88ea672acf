"""Centroid clustering of whole-number vectors, exactly, with Hamerly's bounds.

Each vector carries its cluster, an upper bound of the distance to that cluster's centroid and a lower bound of
the distance to any other.  When centroids have moved, the upper bound grows by its own centroid's drift and the
lower one shrinks by the largest drift of another; where the upper bound stays below the lower one, or below
half the way to the nearest other centroid, the cluster cannot have changed.  For what is left the distance to
the own centroid is taken first, and vectors that stay ambiguous get a full scan in whole numbers.  Bounds are
rounded outward and compared strictly, so a tie is always scanned, and the smaller number wins it.

The bounds are written to the shared folder after each round, with the vectors; a round reads only the last.
Sums of clusters change by the vectors that moved, added up in whole numbers; what comes to the driver is one
row for each cluster and component.

Defined results: vectors of another length and those with a null or non-finite component are left out, null
vectors too; a null id has no hash and begins no cluster before others; equal hashes (repeated ids) go by the
vector; fewer vectors than clusters make as many clusters; repeated rows count each; an empty table gives no
rows; further columns are not read; components that might let a distance leave 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.batches import ragged
from sluice.llm.common import drop_written, need, tidied, written
from sluice.llm.topk import SCALE, quantised

CLUSTERS, ROUNDS, DIM, SEED = 16, 3, 64, 1
#: Outward rounding of a bound; far above what a few double operations lose.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
#: Largest component whose distances are exact as sums of doubles, and as sums of 64-bit numbers.
_EXACT, _LONG = 1 << 20, 1 << 28
#: Squared distance of a cluster that does not exist.
_FAR = 1e300

_STATE = "vec_id long, _q array<long>, cluster int, _was int, _upper double, _lower double, distance long"


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each centroid."""
    largest = max((max(int(a.max()), -int(a.min())) for a in (x, centroids) if a.size), default=0)
    if largest >= _LONG:
        raise OverflowError("components this large do not keep distances within 64 bits")
    if largest < _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _own(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(1)


class Round:
    """What a round knows: its centroids, and how far each of them has moved since the last."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, k = centroids, len(centroids)
        self.first = before is None
        gaps = np.sqrt(squared_distances(centroids, centroids)) * _DOWN
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(1) / 2 * _DOWN
        self.drift = np.zeros(k) if before is None else np.sqrt(_own(centroids, before, np.arange(k))) * _UP
        others = np.where(np.eye(k, dtype=bool), 0, self.drift[None, :])
        self.drift_of_others = others.max(1)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bring clusters and bounds up to date in place; the rows that were scanned in full."""
        open_rows = np.arange(len(x))
        if not self.first:
            upper += self.drift[cluster]
            upper *= _UP
            lower -= self.drift_of_others[cluster]
            lower -= np.abs(lower) * (1 - _DOWN)
            bound = np.maximum(lower, self.half[cluster])
            open_rows = np.flatnonzero(~(upper < bound))
            upper[open_rows] = np.sqrt(_own(x[open_rows], self.centroids, cluster[open_rows])) * _UP
            open_rows = open_rows[~(upper[open_rows] < bound[open_rows])]
        if len(open_rows):
            d = squared_distances(x[open_rows], self.centroids)
            best = d.argmin(1)
            least = d[np.arange(len(d)), best]
            rest = d.astype(np.float64)
            rest[np.arange(len(d)), best] = _FAR
            cluster[open_rows], upper[open_rows], lower[open_rows] = best, np.sqrt(least) * _UP, np.sqrt(rest.min(1)) * _DOWN
        return open_rows


def _vectors(column: pa.Array) -> np.ndarray:
    values, offsets = ragged(column)
    return values.reshape(len(offsets) - 1, -1) if len(offsets) > 1 else values.reshape(0, DIM)


def _step(now: Round):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column("_q"))
            was, upper, lower = (np.array(b.column(c).to_numpy(zero_copy_only=False)) for c in ("cluster", "_upper", "_lower"))
            cluster = was.copy()
            now.assign(x, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("_q"), pa.array(cluster), pa.array(was), pa.array(upper), pa.array(lower), pa.array(_own(x, now.centroids, cluster))], names=[c.split()[0] for c in _STATE.split(", ")])

    return run


def _moved(k: int):
    """Change of each cluster's count and sums, for the vectors that came or went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("_q"))
            n, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
            for name, sign in (("cluster", 1), ("_was", -1)):
                cluster = b.column(name).to_numpy()
                known = cluster >= 0
                np.add.at(n, cluster[known], sign)
                np.add.at(sums, cluster[known], sign * x[known])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of the vectors kept."""
    need(vectors, id_col, vector_col)
    with tidied() as keep:
        kept = written(quantised(vectors, id_col, vector_col, scale).filter(F.size("_q") == dim), "kept")
        by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        first = kept.orderBy(F.asc_nulls_last(by_hash), "_q").limit(clusters).collect()
        none, whole = F.lit(None).cast("string"), lambda v: F.lit(v).cast("long")
        if not first:
            return keep(kept).select("vec_id", F.lit(0).alias("cluster"), *[whole(0).alias(c) for c in ("distance", "cluster_inertia", "inertia")], none.alias("centroid_sha256"))
        now, before = np.array([r["_q"] for r in first], np.int64), None
        k = len(now)
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]
        state = kept.withColumns({"cluster": F.lit(-1), "_upper": F.lit(0.0), "_lower": F.lit(0.0)})
        for nth in range(rounds + 1):
            last, state = state, written(state.mapInArrow(_step(Round(now, before)), _STATE), "bounds")
            if nth:
                drop_written(last)
            if nth == rounds:
                break
            moved = state.filter("cluster <> _was").select("_q", "cluster", "_was").mapInArrow(_moved(k), "cluster long, n long, sums array<long>")
            moved = moved.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
            # One row for each cluster and component.
            for r in moved.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("part")).collect():
                sums[r["cluster"]][r["at"]] += r["part"]
                if r["at"] == 0:
                    counts[r["cluster"]] += r["n"]
            before, now = now, np.array([[s // n for s in own] if n else old for own, n, old in zip(sums, counts, now.tolist(), strict=True)], np.int64)
        inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
        digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
        of = lambda values: F.get(F.array(*values), F.col("cluster"))
        return keep(state).select("vec_id", "cluster", "distance", of([whole(inertia.get(c, 0)) for c in range(k)]).alias("cluster_inertia"), whole(sum(inertia.values())).alias("inertia"), of([F.lit(d) for d in digest]).alias("centroid_sha256"))
