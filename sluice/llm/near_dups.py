"""Near duplicates of texts by min-max hashing, with links confirmed on full shingle sets.

Every permutation gives its minimum and its maximum, so a band of six values costs three hash
evaluations a shingle.  Texts with equal sets are one representative from the start.  In each bucket
of a band one member, chosen by hash, is the leader, and the others are compared with it: pairs grow
with the rows, not with the square of a bucket.  Pairs are confirmed in three rounds, each only across
the components so far:

1. a representative and the leader that it shares most bands with;
2. the other leaders;
3. in buckets whose members still lie in more than one component, all members in blocks.  Without
   this round a link between two followers of a leader that is like neither would be lost.  Blocks
   give out rows that may link first, and of those a spanning forest of confirmed links, so what they
   give grows with their rows and never with their pairs.

Rounds 2 and 3 first compare sketches, a byte of each value, and skip pairs that these put below 0.65
(at a similarity of 0.75 that is four standard deviations away).  With 48 bands a
pair at 0.75 exactly is missed with probability 1e-4, one at 0.8 with 5e-7.  Words and shingles are
64-bit hashes; sets are the same if their sizes and two 64-bit sums over their shingles are.

Defined results: a null text, or one without words, has an empty set and links with nothing; a null
id is above all others; repeated rows are copies of each other; the first row of a group is that with
its least id; an empty table gives no rows; all columns of the input come back untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.batches import ragged, runs
from sluice.llm.common import drop_written, is_small, maybe_broadcast, need, written
from sluice.llm.components import components

BANDS, PERMUTATIONS_A_BAND, WORDS = 48, 3, 5
#: Similarity of a link, in hundredths.
PERCENT = 75
#: Values that a sketch holds a byte of, and the share of equal ones from which a pair is looked at.
SKETCH, SKETCH_SHARE = 2 * BANDS * PERMUTATIONS_A_BAND, 0.65
#: Members of a block in the third round, and shingles that those compared in full may hold.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Ids up to which a side is broadcast (eight bytes each).
BROADCAST_IDS = 1_000_000

_SEED = np.random.RandomState(20240517)
_A = (_SEED.randint(0, 1 << 31, BANDS * PERMUTATIONS_A_BAND).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _SEED.randint(0, 1 << 31, BANDS * PERMUTATIONS_A_BAND).astype(np.uint32) << np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: Column) -> Column:
    """64-bit hashes of a text's words: A-Z in lower case, cut at ASCII white space; null: none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.split(low, "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_sets(words: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    w = words.view(np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(w) - size + 1), np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(rolled)]
        rolled = _mix(rolled)
        sets = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= size:
                sets.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for v in w[a:b]:
                    short = short * np.uint64(0x9E3779B97F4A7C15) + v
                sets.append(_mix(np.array([short + np.uint64(1)], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set under each permutation."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(_A), 0xFFFFFFFF, np.uint32), np.zeros(len(_A), np.uint32)
    for at in range(0, len(x), 2048):
        h = np.multiply.outer(_A, x[at : at + 2048])
        h += _B[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return low, high


def _band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        both = (low.astype(np.uint64) << np.uint64(32)) | high
        key = np.arange(BANDS, dtype=np.uint64)
        for k in range(PERMUTATIONS_A_BAND):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + both[k::PERMUTATIONS_A_BAND])
    return key.view(np.int64)


def _sketch(low: np.ndarray, high: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return ((np.concatenate([low, high]) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n, sid, more, keys, sketch = [], [], [], [], []
            for s in shingle_sets(*ragged(part.column("_words"))):
                n.append(len(s))
                if len(s):
                    low, high = min_max(s)
                    with np.errstate(over="ignore"):
                        sid.append(int(_mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)))
                        more.append(int(_mix(s ^ np.uint64(0xA5A5F00DC0FFEE11)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(_band_keys(low, high))
                    sketch.append(_sketch(low, high))
                else:
                    sid.append(0), more.append(0), keys.append(np.zeros(0, np.int64)), sketch.append(b"")
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(n))), part.column("_row"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(more, pa.int64()), listed, pa.array(sketch, pa.binary())], names=["_rid", "_row", "n_shingles", "_set", "_more", "_keys", "_sketch"])
            rid += len(n)


def _links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) reach the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(small) + len(large) - both)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity; the set of a ``v`` is made once for its run of pairs."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            v = part.column("v").to_numpy()
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            x = shingle_sets(*ragged(part.column("_wx")))
            y = shingle_sets(*ragged(part.column("_wy").take(pa.array(first))))
            run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))
            part = part.filter(pa.array([_links(a, y[r]) for a, r in zip(x, run, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"])


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _sketch_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array((_sketches(batch.column("_sx")) == _sketches(batch.column("_sy"))).mean(1) >= SKETCH_SHARE)
        part = batch.filter(keep)
        yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"])


class _Block:
    """Rows of a pair of a bucket's blocks, and whom each is to be compared with."""

    def __init__(self, group: pa.Table) -> None:
        self.rid, self.comp, self.n, block = (group.column(c).to_numpy() for c in ("_rid", "_comp", "_size", "_block"))
        self.i, self.j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
        self.sketch = _sketches(group.column("_sketch"))
        self.left, self.right = np.flatnonzero(block == self.i), np.flatnonzero(block == self.j)

    def partners(self, p: int) -> np.ndarray:
        """Rows of other components whose sizes and sketches allow a link with row ``p``."""
        q = self.right[self.comp[self.right] != self.comp[p]]
        if self.i == self.j:
            q = q[self.rid[q] > self.rid[p]]
        n = self.n[q]
        q = q[100 * np.minimum(n, self.n[p]) >= PERCENT * np.maximum(n, self.n[p])]
        return q[(self.sketch[q] == self.sketch[p]).mean(1) >= SKETCH_SHARE] if len(q) else q


def _block_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (once) that a row of another component in its bucket may link with."""
    for group in runs(batches, ["_key", "_i", "_j"]):
        block = _Block(group)
        some = np.zeros(len(block.rid), bool)
        for p in block.left:
            q = block.partners(p)
            some[p] |= len(q) > 0
            some[q] = True
        if some.any():
            rid = block.rid[some]
            yield pa.RecordBatch.from_arrays([pa.array([group.column("_key")[0].as_py()] * len(rid), pa.int64()), pa.array(rid)], names=["_key", "_rid"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between the components of a pair of blocks, confirmed on full sets.

    A pair that shares several buckets is compared in the band that comes first.
    """
    for group in runs(batches, ["_key", "_i", "_j"]):
        block, key = _Block(group), group.column("_key")[0].as_py()
        keys = ragged(group.column("_keys"))[0].reshape(-1, BANDS)
        own = (keys == key).argmax(1)
        sets = shingle_sets(*ragged(group.column("_words")))
        names, root = np.unique(block.comp, return_inverse=True)
        parent = list(range(len(names)))

        def find(c: int, parent: list[int] = parent) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        u, v = [], []
        for p in block.left:
            q = block.partners(p)
            q = q[(keys[q] == keys[p]).argmax(1) == own[p]]
            for other in q:
                a, b = find(root[p]), find(root[other])
                if a != b and _links(sets[p], sets[other]):
                    parent[a] = b
                    u.append(block.rid[p]), v.append(block.rid[other])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` of buckets, each once for every pair of blocks that its block is part of."""
    placed = rows.join(maybe_broadcast(blocks), "_key").withColumn("_block", F.pmod(F.xxhash64("_rid"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return placed.withColumns({"_i": F.least("_block", "_o"), "_j": F.greatest("_block", "_o")}).drop("_o", "_blocks").repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")


class _Search:
    """The links between representatives, round by round."""

    def __init__(self, described: DataFrame, text_col: str) -> None:
        self.all, self.text_col = described, text_col
        #: Rows (id, component) of all that has a link; none before the first link.
        self.labels: DataFrame | None = None

    def _of(self, ids: DataFrame, *columns: Column | str) -> DataFrame:
        """Columns of the rows with an id in ``ids`` (u, distinct)."""
        ids = maybe_broadcast(ids, BROADCAST_IDS)
        return self.all.join(ids, self.all["_rid"] == ids["u"], "left_semi").select(*columns)

    def texts(self) -> Column:
        return F.col(f"_row.`{self.text_col}`")

    def add(self, links: DataFrame) -> None:
        """Label components anew, with further links.  A label stands for all links that made it."""
        if links.isEmpty():
            return
        if self.labels is not None:
            links = links.unionByName(self.labels.select(F.col("id").alias("u"), F.col("component").alias("v")))
        before, self.labels = self.labels, components(links)
        if before is not None:
            drop_written(before)

    def confirm(self, pairs: DataFrame, sketches: bool) -> None:
        """Add the links among ``pairs`` (u, v)."""
        pairs = written(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return
        both = lambda: pairs.select("u").union(pairs.select("v")).distinct()
        if sketches:
            held = self._of(both(), "_rid", "_sketch")
            near = pairs.join(held.toDF("u", "_sx"), "u").join(held.toDF("v", "_sy"), "v")
            few = written(near.mapInArrow(_sketch_alike, "u long, v long"), "pairs")
            drop_written(pairs)
            pairs = few
        near = pairs.join(self._of(both(), "_rid", self.texts()).toDF("u", "_tx"), "u")
        near = near.join(self._of(pairs.select(F.col("v").alias("u")).distinct(), "_rid", self.texts()).toDF("v", "_ty"), "v").select("u", "v", words_of(F.col("_tx")).alias("_wx"), words_of(F.col("_ty")).alias("_wy"))
        found = written(near.mapInArrow(_alike, "u long, v long"), "links")
        drop_written(pairs)
        self.add(found)
        drop_written(found)

    def confirm_blocks(self, apart: DataFrame) -> None:
        """Add the links among ``apart`` (_key, _rid, _comp): rows of buckets that hold several components."""
        apart = written(apart, "apart")
        if apart.isEmpty():
            return
        ids = written(apart.select(F.col("_rid").alias("u")).distinct(), "ids")
        sketches = written(self._of(ids, "_rid", F.col("n_shingles").alias("_size"), "_sketch"), "sketches")
        blocks = apart.groupBy("_key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
        found = _dealt(apart.join(maybe_broadcast(sketches, BROADCAST_IDS // 40), "_rid"), blocks).mapInArrow(_block_candidates, "_key long, _rid long")
        some = written(found.distinct(), "candidates")
        narrow = apart.join(some, ["_key", "_rid"]).join(maybe_broadcast(sketches, BROADCAST_IDS // 40), "_rid")
        narrow = written(narrow.select("_key", "_rid", "_comp", "_size", "_sketch"), "narrow")
        sizes = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("_size") / BLOCK_SHINGLES)).cast("int")
        texts = self._of(some.select(F.col("_rid").alias("u")).distinct(), "_rid", "_keys", self.texts().alias("_text"))
        dealt = _dealt(narrow.join(texts, "_rid"), narrow.groupBy("_key").agg(sizes.alias("_blocks")))
        links = written(dealt.withColumn("_words", words_of(F.col("_text"))).drop("_text").mapInArrow(_block_links, "u long, v long"), "links")
        self.add(links)
        for table in (apart, ids, sketches, some, narrow, links):
            drop_written(table)

    def labelled(self, rows: DataFrame, column: str, name: str, own: bool = True) -> DataFrame:
        """``rows`` with the component of an id; without links its own id (``own``) or null."""
        if self.labels is None:
            return rows.withColumn(name, F.col(column) if own else F.lit(None).cast("long"))
        labels = maybe_broadcast(self.labels.select(F.col("id").alias(column), F.col("component").alias("_l")))
        return rows.join(labels, column, "left").withColumn(name, F.coalesce("_l", column) if own else F.col("_l")).drop("_l")

    def apart(self, pairs: DataFrame) -> DataFrame:
        both = self.labelled(self.labelled(pairs, "u", "_cu"), "v", "_cv")
        return both.filter("_cu <> _cv").select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_row, n_shingles, component_id, kept, is_first`` for every row of ``docs``.

    ``_row`` holds the row's own columns; ``kept``: its id is the least of its group; ``is_first``:
    true for one row of each group.
    """
    need(docs, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = docs.select(words_of(F.col(text_col)).alias("_words"), row.alias("_row"))
    kind = dict(source.dtypes)["_row"]
    all_rows = written(source.mapInArrow(_describe, f"_rid long, _row {kind}, n_shingles long, _set long, _more long, _keys array<long>, _sketch binary"), "shingled")
    doc_id = F.col(f"_row.`{id_col}`")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("_rid").alias("rid"))
    same = ["_set", "_more", "n_shingles"]
    sets = written(all_rows.filter("n_shingles > 0").groupBy(*same).agg(F.min("_rid").alias("_rep"), F.min(order).alias("_least"), F.count("*").alias("_copies")), "sets")

    reps = sets.select(F.col("_rep").alias("_rid"))
    keyed = all_rows.select("_rid", "_keys")
    # Beyond a broadcast the representatives' keys are written, so that they meet their rows once.
    keyed = keyed.join(F.broadcast(reps), "_rid", "left_semi") if is_small(reps, BROADCAST_IDS) else written(keyed.join(reps, "_rid", "left_semi"), "keys")
    banded = keyed.select("_rid", F.explode("_keys").alias("_key"))
    leader = F.expr("min(struct(xxhash64(_rid, _key) as h, _rid as r))")
    buckets = banded.groupBy("_key").agg(F.count("*").alias("_n"), leader.alias("_m")).filter("_n > 1").select("_key", "_n", F.col("_m.r").alias("_leader"))
    # Written before the join, so that a bucket with very many members may be split there.
    buckets = written(buckets, "buckets")
    members = written(banded.join(maybe_broadcast(buckets, BROADCAST_IDS), "_key"), "members")

    search = _Search(all_rows, text_col)
    stars = written(members.filter("_rid <> _leader").groupBy(F.col("_rid").alias("u"), F.col("_leader").alias("v")).agg(F.count("*").alias("_shared")), "stars")
    best = stars.groupBy("u").agg(F.max(F.struct("_shared", "v")).alias("_b")).select("u", F.col("_b.v").alias("v"))
    search.confirm(best, sketches=False)
    search.confirm(search.apart(stars), sketches=True)

    followers = search.labelled(members.filter("_n > 2 and _rid <> _leader"), "_rid", "_comp").select("_key", "_rid", "_comp")
    followers = written(followers, "followers")
    mixed = followers.groupBy("_key").agg(F.min("_comp").alias("a"), F.max("_comp").alias("b")).filter("a <> b").select("_key")
    search.confirm_blocks(followers.join(maybe_broadcast(written(mixed, "mixed"), BROADCAST_IDS), "_key"))
    for table in (buckets, members, stars, followers):
        drop_written(table)

    # Only sets with copies or links need a join; every other row is a group of its own.
    named = search.labelled(sets, "_rep", "_comp", own=False).filter("_copies > 1 or _comp is not null")
    named = written(named.withColumn("_comp", F.coalesce("_comp", "_rep")), "named")
    least = written(named.groupBy("_comp").agg(F.min("_least").alias("_least")), "least")
    groups = written(named.select(*same, "_comp").join(maybe_broadcast(least), "_comp").select(*same, "_least"), "groups")
    for table in (sets, named, least):
        drop_written(table)
    out = all_rows.select("_rid", "_row", *same).join(maybe_broadcast(groups), same, "left")
    alone = F.col("_least").isNull()
    return out.select("_row", "n_shingles", F.when(alone, doc_id).otherwise(F.col("_least.id")).alias("component_id"), (alone | doc_id.eqNullSafe(F.col("_least.id"))).alias("kept"), (alone | (F.col("_rid") == F.col("_least.rid"))).alias("is_first"))
