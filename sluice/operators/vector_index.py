"""An inverted-file index for nearest-neighbour joins: rows filed by cell, probes that prune cells, exact ranking.

Cells are fitted on a bounded sample (SAMPLE_ROWS vectors, Lloyd's rounds on the driver); every row of the index
is filed in its nearest cell, and the table is written partitioned by cell, so a search reads the cells it needs.
A hot cell is several blocks of rows, compared by as many tasks.

A search looks into the cells nearest to each lookup vector (``probes``) and ranks what it finds by exact
distances.  How many cells that takes is measured when the index is built: TUNE_ROWS vectors of the sample look
for their neighbours in the sample, and as many cells are probed as held TARGET of these.  Vectors without any
clusters take many cells, clustered ones a few; :func:`recall` and :func:`compared` tell what a search found and
what it cost.  With ``exact`` a search goes on: a cell's radius and a lookup's distance to its centre bound how
near a row of that cell can be, and every cell that might hold a nearer row than the k-th found is searched too.

Index rows with a null or non-finite vector, or one of another length than the sample's first, are not filed; lookup
vectors of that kind have no matches (a null list).  An index without rows gives empty lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.errors import CompileError
from sluice.operators.vectors import block_search, match_lists, matches_asked
from sluice.tables import shared_dir, written

#: Vectors that cells are fitted on, at most; sample vectors for a cell, at least; rounds of the fit.
SAMPLE_ROWS, SAMPLE_PER_CELL, FIT_ROUNDS = 20_000, 8, 8
#: Sample vectors that tune the number of probes, neighbours that each looks for, and the share to be found.
TUNE_ROWS, TUNE_NEIGHBOURS, TARGET = 256, 10, 0.95
#: Index rows and lookups of a task.
BLOCK_ROWS, BLOCK_LOOKUPS = 50_000, 50_000


@dataclass(frozen=True)
class VectorIndex:
    """Where the filed rows are, and the cells: centres, radii (greatest distance of a row), counts, and how many to probe."""

    path: str
    metric: str
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    probes: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def _finite(name: str, size: int | None = None):
    v = F.col(name)
    plain = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(plain & (F.size(v) == size if size is not None else F.size(v) > 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as cells see them: of length 1 for cosine."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T, 0))


def fit_cells(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centres of at most ``cells`` cells, by Lloyd's rounds; a cell that empties takes the row furthest from its centre."""
    rng = np.random.RandomState(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:cells]].copy()
    for _ in range(FIT_ROUNDS):
        d = _to_centres(sample, centres)
        own, far = d.argmin(1), d.min(1)
        for c in range(len(centres)):
            mine = own == c
            if mine.any():
                centres[c] = sample[mine].mean(0)
            else:
                centres[c] = sample[far.argmax()]
                far[far.argmax()] = 0
    return centres


def tune(sample: np.ndarray, centres: np.ndarray, target: float = TARGET) -> int:
    """The number of nearest cells that hold ``target`` of the neighbours that sample vectors have in the sample."""
    asked = sample[:TUNE_ROWS]
    own = _to_centres(sample, centres).argmin(1)
    # The rank of each cell among the centres nearest to a vector.
    rank = _to_centres(asked, centres).argsort(1, kind="stable").argsort(1, kind="stable")
    d = _to_centres(asked, sample)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(TUNE_NEIGHBOURS, max(1, len(sample) - 1))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def _file(centres: np.ndarray, metric: str):
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _to_centres(_placed(_matrix(b.column("v"), dim), metric), centres)
            cell = d.argmin(1).astype(np.int32) if len(d) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d[np.arange(len(d)), cell]), pa.array(cell)], names=[*b.schema.names, "_far", "cell"])

    return run


def build(index: DataFrame, id_col: str = "id", vector_col: str = "embedding", carry: str | None = None, cells: int | None = None, metric: str = "euclidean", path: str | None = None, seed: int = 0) -> VectorIndex:
    """File every row of ``index``; about the root of its size as cells, as far as the sample can tell them apart."""
    if metric not in ("euclidean", "cosine"):
        raise CompileError(f"unknown metric {metric!r}")
    spark = index.sparkSession
    rows = index.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), (F.col(f"`{carry}`") if carry else F.lit(None).cast("string")).alias("c"))
    rows = rows.filter(_finite("v"))
    n = rows.count()
    # A bit more than the bound is drawn, so that the limit, which takes any rows, has little to cut.
    sample = rows.sample(min(1.0, 1.1 * SAMPLE_ROWS / n), seed=seed).select("v").limit(SAMPLE_ROWS).toArrow() if n else None
    if sample is None or not sample.num_rows:
        sample = rows.select("v").limit(SAMPLE_ROWS).toArrow()
    path = path or f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    if not sample.num_rows:
        return VectorIndex(path, metric, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))
    dim = len(sample.column("v")[0])
    own = [len(v) == dim for v in sample.column("v")]
    x = _placed(_matrix(sample.filter(pa.array(own)).column("v"), dim), metric)
    centres = fit_cells(x, max(1, min(cells or int(n**0.5), max(1, len(x) // SAMPLE_PER_CELL))), seed)
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    filed = rows.filter(F.size("v") == dim).mapInArrow(_file(centres, metric), f"{kinds}, _far double, cell int")
    # Ranges of (cell, hash): a cell is few files, and a hot one is written by several tasks.
    parts = max(1, -(-n // BLOCK_ROWS))
    filed.withColumn("_salt", F.xxhash64("i")).repartitionByRange(parts, "cell", "_salt").drop("_salt").write.partitionBy("cell").parquet(path)
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    # One row for each cell.
    for r in spark.read.parquet(path).groupBy("cell").agg(F.max("_far").alias("r"), F.count("*").alias("n")).collect():
        radii[r["cell"]], counts[r["cell"]] = r["r"], r["n"]
    return VectorIndex(path, metric, centres, radii, counts, tune(x, centres))


def _probe(index: VectorIndex, probes: int, normalise: bool, bounded: bool):
    """The cells that a lookup is searched in: the nearest ones, or (``bounded``) those left that may hold a nearer row."""
    dim, full = index.centres.shape[1], index.counts > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 1024) for at in range(0, b.num_rows, 1024)):
                q = _matrix(part.column("_q"), dim)
                d = _to_centres(_placed(q, "cosine") if normalise or index.metric == "cosine" else q, index.centres)
                d[:, ~full] = np.inf
                order = d.argsort(1, kind="stable")
                near = np.zeros(d.shape, bool)
                near[np.arange(len(d))[:, None], order[:, :probes]] = True
                near &= full[None, :]
                if bounded:
                    reach = part.column("_reach").to_numpy(zero_copy_only=False)
                    # A little is added for rounding; a cell too many costs time only.
                    near = ~near & full[None, :] & (d - index.radii[None, :] <= reach[:, None] * (1 + 1e-9) + 1e-9)
                ends = np.append(0, near.sum(1).cumsum()).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(near.nonzero()[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("_q"), cells], names=["_q", "_cells"])

    return run


def _searched(index: VectorIndex, asked: DataFrame, k: int, near: str, normalise: bool) -> DataFrame:
    """The ``k`` nearest of each lookup in its ``_cells``: rows ``_q, _n``, one for each block looked into."""
    spark = asked.sparkSession
    told = asked.withColumn("cell", F.explode("_cells")).drop("_cells")
    # At most a row for each cell: how many blocks its rows and its lookups make.
    wanted = told.groupBy("cell").agg(F.count("*").alias("n")).collect()
    sizes = spark.createDataFrame([(r["cell"], max(1, -(-int(index.counts[r["cell"]]) // BLOCK_ROWS)), max(1, -(-r["n"] // BLOCK_LOOKUPS))) for r in wanted], "cell int, _blocks int, _parts int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = index.rows(spark).drop("_far").join(F.broadcast(sizes), "cell").withColumn("_b", F.pmod(F.xxhash64("i"), F.col("_blocks")).cast("int")).withColumn("_l", each("_parts"))
    told = told.join(F.broadcast(sizes), "cell").withColumn("_l", F.pmod(F.xxhash64("_q"), F.col("_parts")).cast("int")).withColumn("_b", each("_blocks"))
    keys = ["cell", "_b", "_l"]
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("i", "c")]
    search = block_search(k, index.metric, normalise, None, kinds, to_arrow_type(asked.schema["_q"].dataType))
    return rows.select(*keys, "i", "v", "c").groupBy(*keys).cogroup(told.select(*keys, "_q").groupBy(*keys)).applyInArrow(search, f"_q array<double>, _n {near}")


def search(lookup: DataFrame, index: VectorIndex, k: int, lookup_vector: str = "embedding", probes: int | None = None, exact: bool = False, normalise: bool = True) -> DataFrame:
    """``lookup`` with ``_near``: its ``k`` nearest as structs (distance, id, carried), nearest first, ties to the lower id.

    ``normalise`` scales lookup vectors to length 1.  With ``exact`` these are the ``k`` nearest of all rows.
    """
    spark = lookup.sparkSession
    vector = F.col(f"`{lookup_vector}`").cast("array<double>")
    if not len(index.centres):
        return lookup.withColumn("_near", F.when(vector.isNotNull(), F.array().cast("array<struct<distance:double,id:string,carried:string>>")))
    schema = index.rows(spark).schema
    near = f"array<struct<distance:double,id:{schema['i'].dataType.simpleString()},carried:{schema['c'].dataType.simpleString()}>>"
    asked = lookup.select(vector.alias("_q")).filter(_finite("_q", index.centres.shape[1])).distinct()
    best = lambda df: df.groupBy("_q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_n"))), 1, k).alias("_n"))
    cells = asked.mapInArrow(_probe(index, probes or index.probes, normalise, False), "_q array<double>, _cells array<int>")
    found = best(_searched(index, cells, k, near, normalise))
    if exact:
        found = written(found, "found")
        last = F.get("_n", F.lit(k - 1))["distance"]
        # Cells know distances; of a cosine distance c the distance of unit vectors is the root of 2 c.
        reach = F.coalesce(F.sqrt(F.greatest(2 * last, F.lit(0.0))) if index.metric == "cosine" else last, F.lit(float("inf")))
        more = found.select("_q", reach.alias("_reach")).mapInArrow(_probe(index, probes or index.probes, normalise, True), "_q array<double>, _cells array<int>")
        found = best(found.unionByName(_searched(index, more.filter(F.size("_cells") > 0), k, near, normalise)))
    return lookup.withColumn("_asked", vector).join(found.withColumnRenamed("_q", "_asked"), "_asked", "left").withColumnRenamed("_n", "_near").drop("_asked")


def vector_join(lookup: DataFrame, index: VectorIndex, join_kind: str = "inner", topk: int = 5, keep_n_matches: int = 5, distance_threshold: float = float("inf"), lookup_vector: str = "embedding", probes: int | None = None, exact: bool = False, normalise: bool = True, passages: bool = False) -> DataFrame:
    """As :func:`sluice.operators.vectors.vector_join`, by an index instead of a table."""
    topk, keep_n_matches = matches_asked(join_kind, topk, keep_n_matches)
    return match_lists(search(lookup, index, topk, lookup_vector, probes, exact, normalise), join_kind, keep_n_matches, distance_threshold, passages)


def compared(lookup: DataFrame, index: VectorIndex, lookup_vector: str = "embedding", probes: int | None = None, normalise: bool = True) -> int:
    """Distances that a search without ``exact`` takes."""
    asked = lookup.select(F.col(f"`{lookup_vector}`").cast("array<double>").alias("_q")).filter(_finite("_q", index.centres.shape[1])).distinct()
    cells = asked.mapInArrow(_probe(index, probes or index.probes, normalise, False), "_q array<double>, _cells array<int>").select(F.explode("_cells").alias("cell"))
    return sum(r["count"] * int(index.counts[r["cell"]]) for r in cells.groupBy("cell").count().collect())


def recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> float:
    """The share of the true neighbours that was found, of two results of the same lookups."""
    ids = lambda df, name: df.select(*keys, F.transform("_near", lambda m: m["id"]).alias(name))
    both = ids(found, "_f").join(ids(truth, "_t"), keys)
    r = both.agg(F.sum(F.size(F.array_intersect("_f", "_t"))).alias("hit"), F.sum(F.size("_t")).alias("all")).first()
    return r["hit"] / r["all"] if r["all"] else 1.0
