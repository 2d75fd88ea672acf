"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Pairs of words are counted for toxic and ordinary texts.  Within a class, a pair's discounted count
backs off to the word's continuation count (how many different words it follows there), and that to
continuation counts of both classes together.  Words and pairs met fewer than LEAST times
have no counts of their own, at every size of the input: such words are one rare word, and the mass of
such pairs goes to the back-off, so that chances sum to 1.  The model grows with the input.  Its pairs
are broadcast as ratios, 12 bytes each, in blocks of at most BLOCK_PAIRS: with several blocks texts carry
the ratios of their words from one pass to the next, and neither the driver nor a worker ever holds more
than a block.  Scores are the same however many there are.

A text is scored whole: the log-likelihood ratio of toxic to ordinary, normalised by length, over the
text and over its passages of PASSAGE words.  A logistic curve over these turns them into a score; it
is fitted on at most FIT_ROWS labelled texts that the counts never saw.

Labels come only from rows with crc32(id as text) mod 4 other than 2: remainders 0 and 1 are counted,
3 fits the curve.

Defined results: a null or empty text has the score of no evidence; an id with several labels is toxic
if any says so; null labels and labels of null ids are left out; repeated rows each get a row; without
labels of both classes every score is the smoothed share of toxic labels; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.batches import ragged, slices
from sluice.llm.common import drop_written, maybe_broadcast, need, written

#: Count below which an expression is rare.
LEAST = 3
DISCOUNT = 0.75
PASSAGE = 8
FIT_ROWS = 20_000
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
#: Pairs of the model that are collected and broadcast at a time.
BLOCK_PAIRS = 16_000_000
#: Labels up to which the labels' side is broadcast.
BROADCAST_LABELS = 1_000_000
#: Counts that a worker holds before it gives them out, and words that it scores at a time.
_HELD, _WORDS = 1 << 20, 200_000


def words_of(text: Column) -> Column:
    """64-bit hashes of a text's words: lower case, cut at all ASCII but letters and digits."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


class _Sums:
    """Counts by class for each distinct key of a stream, given out whenever many keys are held."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.toxic: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, toxic: np.ndarray) -> None:
        self.keys.append(keys), self.toxic.append(toxic)
        self.held += len(keys)

    def take(self) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        toxic = np.concatenate([np.zeros(0, np.int8), *self.toxic])
        self.keys, self.toxic, self.held = [], [], 0
        order = np.argsort(keys)
        keys, toxic = keys[order], toxic[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        n = np.add.reduceat(toxic, first, dtype=np.int64) if len(first) else first
        return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(n), pa.array(np.diff(np.r_[first, len(keys)]) - n)], names=["key", "toxic", "ordinary"])


def _counted(key_of):
    """Rows (key, toxic, ordinary) from batches of word lists with a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            values, offsets = ragged(batch.column("_words"))
            toxic = batch.column("_toxic").to_numpy(zero_copy_only=False).astype(np.int8)
            for a, b in slices(offsets, _WORDS):
                own = offsets[a : b + 1]
                sums.add(key_of(values[own[0] : own[-1]], own - own[0]), np.repeat(toxic[a:b], np.diff(own)))
                if sums.held >= _HELD:
                    yield sums.take()
        yield sums.take()

    return run


def _single(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return values


def _numbered(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places in the vocabulary; its length for rare words."""
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == words, at, len(vocabulary))


def _follows(number: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """The word before each; ``start`` at the beginning of a text."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = start
    return before


def _pairs(told):
    def key_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        vocabulary = told.value
        number = _numbered(values, vocabulary)
        return _follows(number, offsets, len(vocabulary) + 1) * (len(vocabulary) + 2) + number

    return _counted(key_of)


class Model:
    """The log-likelihood ratio of toxic (0) to ordinary (1) of each word after each word.

    Of a pair with counts of its own the ratio is held; any other pair's is that of the mass which its
    first word leaves to the back-off, plus that of its second word.
    """

    def __init__(self, vocabulary: np.ndarray, after: np.ndarray, pairs: np.ndarray, begin: np.ndarray, taken: np.ndarray | None = None) -> None:
        """``after``: per word and class, distinct words before it.  ``begin``: per word and class, the
        count of all its pairs.  ``pairs``: those with counts of their own (key, toxic, ordinary), or a
        block of them; then ``taken`` says what all of them take of each word's mass."""
        n = len(vocabulary) + 2
        self.vocabulary, self.word_chance = vocabulary, self._words(after)
        order = np.argsort(pairs[:, 0])
        pairs = pairs[order]
        self.keys = np.ascontiguousarray(pairs[:, 0])
        # What pairs with counts of their own take is discounted; all else is left to the back-off, so
        # that the chances after a word sum to 1 however many pairs have no counts.
        parts = [slice(i, i + _HELD) for i in range(0, len(pairs), _HELD)]
        if taken is None:
            taken = np.zeros((n, 2))
            for part in parts:
                for c in (0, 1):
                    taken[:, c] += np.bincount(self.keys[part] // n, self._taken(pairs[part], begin, n)[:, c], n)
        self.back_chance = np.where(begin > 0, np.maximum(1 - taken, 1e-9), 1.0)
        ratio = np.empty(len(pairs), np.float32)
        for part in parts:
            before, number = np.divmod(self.keys[part], n)
            p = self._taken(pairs[part], begin, n) + self.back_chance[before] * self.word_chance[number]
            ratio[part] = np.log(p[:, 0]) - np.log(p[:, 1])
        self.pair = ratio
        self.word, self.back = ((np.log(t[:, 0]) - np.log(t[:, 1])).astype(np.float32) for t in (self.word_chance, self.back_chance))

    @staticmethod
    def _words(after: np.ndarray) -> np.ndarray:
        """Chance of each word by class: its discounted continuation count, and its share of both classes'."""
        n = len(after)
        shared = (after.sum(1) + 0.5) / (after.sum() + 0.5 * n)
        out = np.empty((n, 2))
        for c in (0, 1):
            total, kinds = max(after[:, c].sum(), 1), (after[:, c] > 0).sum()
            left = DISCOUNT * kinds / total if kinds else 1.0
            out[:, c] = np.maximum(after[:, c] - DISCOUNT, 0) / total + left * shared
        return out

    @staticmethod
    def _taken(pairs: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        return np.maximum(pairs[:, 1:] - DISCOUNT, 0) / np.maximum(begin[pairs[:, 0] // n], 1)

    def __getstate__(self) -> dict:
        # Workers need ratios only.
        return {k: v for k, v in self.__dict__.items() if not k.endswith("_chance")}

    def ratios(self, words: np.ndarray, offsets: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """The ratio of each word; ``given`` by other blocks' pairs, only those of its own pairs are put in."""
        n = len(self.vocabulary) + 2
        number = _numbered(words, self.vocabulary)
        before = _follows(number, offsets, n - 1)
        out = self.back[before] + self.word[number] if given is None else given.copy()
        if len(self.keys):
            key = before * n + number
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[hit] = self.pair[at[hit]]
        return out

    def features(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return features(lambda w, o, _: self.ratios(w, o), words, offsets)


def features(ratios: Callable, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: mean ratio, that of the best PASSAGE words in a row, of the best three of the passages
    that it falls into, and log length."""
    parts = [_features(ratios, words[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], int(offsets[a])) for a, b in slices(offsets, _WORDS)]
    return np.concatenate([np.zeros((0, 4)), *parts])


def _features(ratios: Callable, words: np.ndarray, offsets: np.ndarray, at: int) -> np.ndarray:
    n, out = np.diff(offsets), np.zeros((len(offsets) - 1, 4))
    out[:, 3] = np.log1p(n)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    r = ratios(words, offsets, at).astype(np.float64)
    out[some, 0] = np.add.reduceat(r, offsets[:-1][some]) / n[some]
    passages = -(-n[some] // PASSAGE)
    first = np.r_[0, np.cumsum(passages)]
    starts = np.repeat(offsets[:-1][some] - first[:-1] * PASSAGE, passages) + np.arange(first[-1]) * PASSAGE
    mean = np.add.reduceat(r, starts) / PASSAGE
    begin, end = np.repeat(offsets[:-1][some], n[some]), np.repeat(offsets[1:][some], n[some])
    place = np.arange(len(r))
    sums = np.r_[0.0, np.cumsum(r)]
    run = sums[np.minimum(place + PASSAGE, end)] - sums[place]
    run[(place + PASSAGE > end) & (place > begin)] = -np.inf
    out[some, 1] = np.maximum.reduceat(run, offsets[:-1][some]) / PASSAGE
    text = np.repeat(np.arange(len(some)), passages)
    order = np.lexsort((-mean, text))
    rank = np.arange(first[-1]) - first[text]
    top = rank < 3
    sums = np.zeros(len(some))
    np.add.at(sums, text[top], mean[order][top])
    out[some, 2] = sums / 3
    return out


class Curve:
    """Ridge logistic regression by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w = np.zeros(z.shape[1])
        penalty = ridge * np.r_[np.ones(x.shape[1]), 1e-6]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.w
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Blocks:
    """A model in several blocks, each collected and broadcast for a pass of its own over the texts."""

    def __init__(self, n: int, block: Callable[[int], Broadcast]) -> None:
        self.n, self.block = n, block

    def rated(self, rows: DataFrame) -> DataFrame:
        """``rows`` (_words, ...) with ``_ratios``, filled in block by block."""
        rows = rows.withColumn("_ratios", F.lit(None).cast("array<float>"))
        kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        before = None
        for k in range(self.n):
            told = self.block(k)
            rows = written(rows.mapInArrow(_rated(told, k == 0), kinds), "rated")
            told.destroy()
            if before is not None:
                drop_written(before)
            before = rows
        return rows


def _rated(told: Broadcast, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = ragged(batch.column("_words"))
            given = None if first else ragged(batch.column("_ratios"))[0]
            out = [told.value.ratios(words[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], None if first else given[offsets[a] : offsets[b]]) for a, b in slices(offsets, _WORDS)]
            rated = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.float32), *out]), pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "_ratios"), rated], names=[*(n for n in batch.schema.names if n != "_ratios"), "_ratios"])

    return run


def _mapped(rows: DataFrame, model: Broadcast | Blocks, made: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``made(batch, features)`` over ``rows`` with their words."""
    told = None if isinstance(model, Blocks) else model
    if told is None:
        rows = model.rated(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = ragged(batch.column("_words"))
            if told is None:
                held = ragged(batch.column("_ratios"))[0]
                x = features(lambda w, o, at: held[at : at + len(w)], words, offsets)
            else:
                x = told.value.features(words, offsets)
            yield made(batch, x)

    return rows.mapInArrow(run, schema)


def _featured(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("_toxic"), *(pa.array(x[:, k]) for k in range(4))], names=["toxic", "a", "b", "c", "d"])


def _scored(rows: DataFrame, fitted: tuple, name: str) -> DataFrame:
    """Rows ``name, score`` of rows with ``name`` and their words."""
    model, curve = fitted
    if isinstance(curve, float):
        return rows.select(name, F.lit(curve).alias("score"))

    def made(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(name), pa.array(curve(x))], names=[name, "score"])

    return _mapped(rows, model, made, f"`{name}` {dict(rows.dtypes)[name]}, score double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Broadcast | Blocks | None, Curve | float]:
    """The model, broadcast or in blocks, and the curve; without both classes in both parts, a constant."""
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic")).filter(remainder(F.col("_id")) != 2)
    known = written(known.withColumn("_toxic", (F.col("_toxic") > 0).cast("int")), "labels")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    labelled = texts.join(maybe_broadcast(known, BROADCAST_LABELS), "_id").withColumn("_part", remainder(F.col("_id")))
    seen = labelled.filter("_part < 2").select(words_of(F.col("_text")).alias("_words"), "_toxic")
    kinds = "key long, toxic long, ordinary long"

    shares = {(r["part"], r["_toxic"]): r["n"] for r in known.groupBy((remainder(F.col("_id")) == 3).alias("part"), "_toxic").agg(F.count("*").alias("n")).collect()}
    toxic = sum(n for (_, t), n in shares.items() if t)
    base = (toxic + 1) / (sum(shares.values()) + 10)

    counts = written(seen.mapInArrow(_counted(_single), kinds).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "words")
    tokens = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not (tokens[0] and tokens[1]):
        return None, base
    vocabulary = np.sort(counts.filter(F.col("toxic") + F.col("ordinary") >= LEAST).select("key").toArrow().column("key").to_numpy())
    n = len(vocabulary) + 2
    told = spark.sparkContext.broadcast(vocabulary)
    pairs = written(seen.mapInArrow(_pairs(told), kinds).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "pairs")
    told.destroy()
    word = F.pmod("key", F.lit(n)).alias("w")
    met = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)

    def gathered(rows: DataFrame) -> np.ndarray:
        """Two figures of each word, as an array over the vocabulary."""
        out, got = np.zeros((n, 2)), rows.toArrow()
        out[got.column("w").to_numpy()] = np.stack([got.column(c).to_numpy() for c in ("toxic", "ordinary")], 1)
        return out

    after = gathered(pairs.groupBy(word).agg(met("toxic"), met("ordinary")))
    begin = gathered(pairs.withColumn("w", F.expr(f"key div {n}")).groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    kept = pairs.filter(F.col("toxic") + F.col("ordinary") >= LEAST).select("key", F.col("toxic").cast("int").alias("toxic"), F.col("ordinary").cast("int").alias("ordinary"))
    blocks = max(1, -(-kept.count() // BLOCK_PAIRS))
    less = lambda c: F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(c)
    taken = gathered(kept.withColumn("w", F.expr(f"key div {n}")).groupBy("w").agg(less("toxic"), less("ordinary"))) / np.maximum(begin, 1)

    def block(k: int) -> Broadcast:
        own = (kept if blocks == 1 else kept.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)).toArrow()
        return spark.sparkContext.broadcast(Model(vocabulary, after, np.stack([own.column(c).to_numpy() for c in ("key", "toxic", "ordinary")], 1), begin, taken))

    model = block(0) if blocks == 1 else Blocks(blocks, block)

    fitting = sum(c for (part, _), c in shares.items() if part)
    rest = labelled.filter("_part = 3")
    if fitting > FIT_ROWS:
        rest = rest.filter(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 20)) < int((1 << 20) * FIT_ROWS / fitting))
    got = _mapped(rest.select(words_of(F.col("_text")).alias("_words"), "_toxic"), model, _featured, "toxic int, a double, b double, c double, d double").toArrow()
    y = got.column("toxic").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return model, base
    return model, Curve(np.stack([got.column(c).to_numpy() for c in "abcd"], 1), y)


def score(docs: DataFrame, fitted: tuple[Broadcast | Blocks | None, Curve | float], text_col: str = "text") -> DataFrame:
    """Rows ``_row, score`` for every row of ``docs``; ``_row`` holds its own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(words_of(F.col(text_col)).alias("_words"), row.alias("_row"))
    return _scored(rows, fitted, "_row")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    fitted = fit(docs, labels, id_col, text_col)
    scored = _slim(docs, fitted, id_col, text_col)
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _slim(docs: DataFrame, fitted, id_col: str, text_col: str) -> DataFrame:
    """As :func:`score`, carrying only the id."""
    rows = docs.select(words_of(F.col(text_col)).alias("_words"), F.col(id_col).alias("doc_id"))
    return _scored(rows, fitted, "doc_id")
