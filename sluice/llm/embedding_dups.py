"""Near duplicates of vectors by cosine, with a forest of random-projection trees.

Each tree cuts at the median of a random direction, with a spill: vectors whose projection lies in
the band around the cut go to both sides.  The band is as wide as SPREADS standard deviations of what
a random direction makes of the difference of a pair at COSINE, whatever the node, so dense groups lose
no more than others; a node that hardly shrinks by such a cut stays a leaf, which is compared whole.
There are as many trees as bring the calculated loss below LOSS at the table's size.  Trees begin on a
bounded sample; every leaf that turns out too large is then cut further by a task of its own, on a sample of
that leaf, for as many rounds as there is something to cut.  All nodes of a tree's level share their random
directions, so a forest is a few numbers a node.  Every vector is dealt to the leaves of all trees, and
pairs are compared within leaves only, in double precision.

A pair that shares several leaves counts in the first of them, so link counts need no list of pairs:
a leaf gives a count for each vector and a spanning forest of its links.  Leaves of more rows than a
block (vectors too close to each other to be cut apart without losing links) are compared block by
block, each pair of blocks by a task of its own.  Equal vectors are one representative throughout.

Defined results: a null vector, a zero vector and one with a null or non-finite component (or of no
length) link with nothing; vectors of different lengths never link; a null id ranks above all others;
repeated rows are copies of each other; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.batches import ragged, runs
from sluice.llm.common import drop_written, maybe_broadcast, need, written
from sluice.llm.components import components

COSINE = 0.95
#: Width of the band that goes to both sides, in standard deviations of a linking pair's distance along it.
SPREADS = 2.0
#: Share of a node's vectors that a side of a cut may have, and directions tried for one.
SIDE, DIRECTIONS = 0.65, 4
#: Probability of missing a pair at a cosine of exactly COSINE, at most.
LOSS = 1e-4
#: Vectors that the first fit looks at, and those of each large leaf in every further round (about).
FIT_ROWS, LEAF_SAMPLE = 20_000, 2048
#: Rows that a leaf should have, and rows of a block.
LEAF_ROWS, BLOCK_ROWS = 1024, 2048
#: Sample vectors below which a node is not cut.
LEAST_SAMPLE = 24
#: Rows of a block that are compared with the others at a time.
_STRIP = 512


def trees_for(rows: float) -> int:
    """Trees that together part a pair with a probability of at most LOSS.

    A cut parts a pair whose distance along it, normal with deviation d, exceeds the band's SPREADS * d,
    if the cut lies between: E max(|N| - SPREADS, 0) * d times the density there, and the density is the
    band's share (at most 2 * SIDE - 1) over its width.
    """
    if rows <= LEAF_ROWS:
        return 1
    beyond = math.sqrt(2 / math.pi) * math.exp(-(SPREADS**2) / 2) - SPREADS * math.erfc(SPREADS / math.sqrt(2))
    loss = beyond / SPREADS * (2 * SIDE - 1) * math.log(rows / LEAF_ROWS) / -math.log(SIDE)
    return max(1, math.ceil(math.log(LOSS) / math.log(min(loss, 0.5))))


@lru_cache(maxsize=4096)
def _direction(dim: int, number: int) -> np.ndarray:
    """A random direction, which its number decides."""
    v = np.random.RandomState((11_000_033 + number) % (1 << 32)).standard_normal(dim)
    return v / np.linalg.norm(v)


@dataclass
class Forest:
    """Nodes are numbered over all trees; a node is cut (number of the direction, low, high, children) or a leaf."""

    dim: int
    roots: list[int] = field(default_factory=list)
    cuts: dict[int, tuple[int, float, float, int, int]] = field(default_factory=dict)
    #: Tree and depth of each node.
    place: list[tuple[int, int]] = field(default_factory=list)

    @property
    def band(self) -> float:
        return math.sqrt(2 - 2 * COSINE) * min(1.0, SPREADS / math.sqrt(self.dim))

    def new(self, tree: int, depth: int) -> int:
        self.place.append((tree, depth))
        return len(self.place) - 1

    def grow(self, node: int, sample: np.ndarray, rows: float, least: int = LEAST_SAMPLE) -> None:
        """Cut ``node``, which ``sample`` stands for, until a leaf has about LEAF_ROWS of its ``rows``."""
        todo = [(node, np.arange(len(sample)), rows)]
        while todo:
            node, own, n = todo.pop()
            if n <= LEAF_ROWS or len(own) < least:
                continue
            x = sample[own]
            tree, depth = self.place[node]
            for k in range(DIRECTIONS):
                number = (depth * 1009 + tree) * DIRECTIONS + k
                p = x @ _direction(self.dim, number)
                low, high = np.median(p) - self.band / 2, np.median(p) + self.band / 2
                left, right = own[p <= high], own[p >= low]
                if max(len(left), len(right)) <= SIDE * len(own):
                    break
            else:
                continue  # a cut would save nothing, or lose links
            a, b = self.new(tree, depth + 1), self.new(tree, depth + 1)
            self.cuts[node] = (number, float(low), float(high), a, b)
            todo += [(a, left, n * len(left) / len(own)), (b, right, n * len(right) / len(own))]

    def graft(self, leaf: int, cuts: list[dict]) -> None:
        """Cut ``leaf`` as another forest, which began at it as node 0, found."""
        names = {0: leaf}
        for c in sorted(cuts, key=lambda c: c["node"]):
            tree, depth = self.place[names[c["node"]]]
            a, b = self.new(tree, depth + 1), self.new(tree, depth + 1)
            names[c["a"]], names[c["b"]] = a, b
            self.cuts[names[c["node"]]] = (c["number"], c["low"], c["high"], a, b)

    def plant(self, sample: np.ndarray, rows: float, trees: int) -> None:
        for tree in range(trees):
            self.roots.append(self.new(tree, 0))
            self.grow(self.roots[-1], sample, rows)
            if self.roots[-1] not in self.cuts and rows <= 2 * LEAF_ROWS:
                return  # one leaf has all pairs

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that each vector falls into."""
        rows, leaf = [], []
        todo = [(r, np.arange(len(x))) for r in self.roots]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            cut = self.cuts.get(node)
            if cut is None:
                rows.append(own), leaf.append(np.full(len(own), node))
                continue
            p = x[own] @ _direction(self.dim, cut[0])
            todo += [(cut[3], own[p <= cut[2]]), (cut[4], own[p >= cut[1]])]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        r, f = np.concatenate(rows), np.concatenate(leaf)
        order = np.lexsort((f, r))
        return r[order], f[order]


def _unit(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    values, offsets = ragged(batch.column(column))
    x = values.astype(np.float64).reshape(len(offsets) - 1, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _deal(forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, leaf = forest.value.leaves(_unit(part, "_v"))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf, pa.int64()))], names=[*part.schema.names, "_leaves"])

    return run


_CUTS = "_leaf long, node long, number long, low double, high double, a long, b long"


def _grown(forest):
    """The cuts of one large leaf, from a sample of it."""

    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("_leaf")[0].as_py()
        own = Forest(forest.value.dim)
        own.new(*forest.value.place[leaf])
        own.grow(0, _unit(table.combine_chunks(), "_v"), table.column("_n")[0].as_py())
        rows = [(leaf, node, *cut) for node, cut in sorted(own.cuts.items())]
        names, kinds = zip(*((c.split()[0], pa.int64() if c.endswith("long") else pa.float64()) for c in _CUTS.split(", ")), strict=True)
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link counts and a spanning forest for each pair of a leaf's blocks."""
    for g in runs(batches, ["_leaf", "_i", "_j"]):
        rid, copies, block = (g.column(c).to_numpy() for c in ("_rid", "_copies", "_block"))
        i, j, leaf = (g.column(c)[0].as_py() for c in ("_i", "_j", "_leaf"))
        x = _unit(g, "_v")
        link = np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), _STRIP):
            link[at : at + _STRIP] = x[at : at + _STRIP] @ x.T >= COSINE
        np.fill_diagonal(link, False)
        if i != j:
            link &= block[:, None] != block[None, :]
        some = np.flatnonzero(link.any(1))
        if not len(some):
            continue
        if len(some) < len(x):
            link, rid, copies = link[np.ix_(some, some)], rid[some], copies[some]
        values, offsets = ragged(g.column("_leaves").take(pa.array(some)))
        row = np.repeat(np.arange(len(some)), np.diff(offsets))
        before = values < leaf
        names, cell = np.unique(values[before], return_inverse=True)
        inside = np.zeros((len(some), len(names)), np.float32)
        inside[row[before], cell] = 1
        n = np.zeros(len(some))
        for at in range(0, len(some), _STRIP):
            first = link[at : at + _STRIP] & ~(inside[at : at + _STRIP] @ inside.T > 0)
            n[at : at + _STRIP] = first @ copies.astype(np.float64)
        x = x[some]
        root = np.full(len(x), -1)
        for s in range(len(x)):
            if root[s] >= 0:
                continue
            root[s], front = s, np.array([s])
            while len(front):
                front = np.flatnonzero(link[front].any(0) & (root < 0))
                root[front] = s
        keep = (n > 0) | (root != np.arange(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(rid[keep]), pa.array(n[keep].astype(np.int64)), pa.array(rid[root][keep])], names=["u", "n", "v"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", trees: int | None = None) -> DataFrame:
    """Rows ``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    need(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    plain = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # Scaled by the largest component, so that neither tiny nor huge vectors lose their length.
    scaled = F.when(F.coalesce(plain, F.lit(False)), v)
    rows = vectors.select(F.col(id_col).alias("vec_id"), scaled.alias("_w"))
    if dict(vectors.dtypes)[vector_col] == "array<float>":
        # Floats keep their length in double precision as they are, in half the bytes.
        rows = rows.select("vec_id", F.col("_w").cast("array<float>").alias("_v"))
    else:
        rows = rows.withColumn("_m", F.array_max(F.transform("_w", lambda x: F.abs(x)))).select("vec_id", F.transform("_w", lambda x: x / F.col("_m")).alias("_v"))
    # Two hashes stand for a vector from here on; vectors themselves are moved for comparing only.
    key = ["_h", "_g"]
    rows = written(rows.withColumns({"_h": F.when(F.col("_v").isNotNull(), F.xxhash64("_v")), "_g": F.xxhash64(F.lit(7), "_v")}), "vectors")
    distinct = written(rows.filter("_v is not null").groupBy(*key).agg(F.first("_v").alias("_v"), F.count("*").alias("_copies"), F.min("vec_id").alias("_least")).withColumn("_rid", F.monotonically_increasing_id()), "distinct")

    links, edges = [], []
    for dim in sorted(r["d"] for r in distinct.groupBy(F.size("_v").alias("d")).count().collect()):
        own = distinct.filter(F.size("_v") == dim).select("_rid", "_copies", "_v")
        total = own.count()
        forest = Forest(dim)
        sample = own.sample(min(1.0, FIT_ROWS / total), seed=3).select("_v").toArrow()
        forest.plant(_unit(sample, "_v") if sample.num_rows else np.zeros((0, dim)), total, trees or trees_for(total))
        kind, before = ", ".join(f"{n} {t}" for n, t in own.dtypes), None
        while True:
            told = spark.sparkContext.broadcast(forest)
            dealt = written(own.mapInArrow(_deal(told), f"{kind}, _leaves array<long>"), "dealt")
            if before is not None:
                drop_written(before)
            before = dealt
            cells = dealt.select("_rid", F.explode("_leaves").alias("_leaf"))
            large = written(cells.groupBy("_leaf").agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * LEAF_ROWS), "large")
            picked = dealt.select("_rid", "_v", F.explode("_leaves").alias("_leaf")).join(maybe_broadcast(large), "_leaf")
            picked = picked.filter(F.pmod(F.xxhash64(F.lit(5), "_rid", "_leaf"), F.lit(1 << 30)) * F.col("_n") < F.lit(LEAF_SAMPLE << 30))
            cuts: dict[int, list[dict]] = {}
            for r in picked.groupBy("_leaf").applyInArrow(_grown(told), _CUTS).toArrow().to_pylist():
                cuts.setdefault(r["_leaf"], []).append(r)
            drop_written(large)
            if not cuts:
                break
            for leaf in sorted(cuts):
                forest.graft(leaf, cuts[leaf])
        sizes = cells.groupBy("_leaf").agg(F.count("*").alias("_n")).filter("_n > 1").select("_leaf", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks"))
        placed = dealt.withColumn("_leaf", F.explode("_leaves")).join(maybe_broadcast(sizes), "_leaf").withColumn("_block", F.pmod(F.xxhash64("_rid"), F.col("_blocks")).cast("int"))
        placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_i": F.least("_block", "_o"), "_j": F.greatest("_block", "_o")})
        placed = placed.select("_leaf", "_i", "_j", "_block", "_rid", "_copies", "_v", "_leaves").repartition("_leaf", "_i", "_j").sortWithinPartitions("_leaf", "_i", "_j")
        found = written(placed.mapInArrow(_compare, "u long, n long, v long"), "links")
        links.append(found.groupBy("u").agg(F.sum("n").alias("_n")))
        edges.append(found.select("u", "v"))
    if not links:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    count, edge = links[0], edges[0]
    for a, b in zip(links[1:], edges[1:], strict=True):
        count, edge = count.unionByName(a), edge.unionByName(b)
    label = components(edge).toDF("_rid", "_c")
    named = distinct.join(maybe_broadcast(label), "_rid", "left").withColumn("_c", F.coalesce("_c", "_rid"))
    least = named.groupBy("_c").agg(F.min("_least").alias("_first"))
    named = named.join(least, "_c").join(maybe_broadcast(count.withColumnRenamed("u", "_rid")), "_rid", "left")
    named = named.select(*key, (F.coalesce("_n", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), "_first")
    # Rows that link with nothing take no part in the join, where they would all be one task's.
    alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    out = rows.filter("_h is not null").select("vec_id", *key).join(maybe_broadcast(written(named, "named")), key)
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("_first").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("_first")).alias("kept"))
    return out.unionByName(rows.filter("_h is null").select("vec_id", *alone))
