"""Source divergence audit: how far the word frequencies of a language's sources lie apart.

Plain relational: the texts' regexp matches are exploded and counted by group, groups meet the kept terms of
their language, which fills in zeros, the dense table joins itself on language and term, and sums and ranks
follow.  All arithmetic is exact: whole numbers, decimals where a product may leave 64 bits.  Matches are found
over Arrow batches and counted there before they are shuffled; the rest is DataFrame functions.

A language is one key for very many rows, so groups meet the vocabulary in PARTS parts of it, and nothing is
ever dealt by language alone.  Each language has one further, empty term that is 0 everywhere, so that its
sources pair up even where no term is kept; a regular term is never empty.  Pairs of sources are summed in one
order and then given out in both.

Defined results: a null text, language or source counts as empty; an empty text has a group and no terms;
repeated rows are documents of their own; equal values rank by the item's UTF-8 bytes; a language of one
source has no pairs; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import maybe_broadcast, need, written

#: A term matches [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+.  In UTF-8 all bytes of a character beyond ASCII are above 7F,
#: so matches are the longest runs of bytes of this class, and only A-Z change when they are lower-cased.
_BYTE = np.arange(256)
_IN_TERM = ((_BYTE > 0x40) & (_BYTE < 0x5B)) | ((_BYTE > 0x60) & (_BYTE < 0x7B)) | (_BYTE > 0x7F)
_LOWER = np.where((_BYTE > 0x40) & (_BYTE < 0x5B), _BYTE + 32, _BYTE).astype(np.uint8)
#: Bytes of texts that are looked at together; a longer text is looked at in parts of it.
PIECE_BYTES = 16 << 20
#: Documents that a term needs in its language, what is added to a count, and the scale of frequencies.
LEAST_DOCS, ADDED, SCALE = 30, 5, 1_000_000_000
#: Counts whose scaled value fits 64 bits for certain.
_SHORT = (1 << 62) // SCALE - ADDED
#: Ranks of the terms that set a source apart.
TOP_TERMS = 50
#: Parts of a language's vocabulary that groups meet one by one.
PARTS = 64


def _whole(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _names(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]


def _frequency(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms))`` without rounding."""
    above = F.lit(SCALE).cast("decimal(10,0)") * _whole(count + ADDED)
    long = F.call_function("div", F.lit(SCALE).cast("long") * (count + ADDED), total + ADDED * terms)
    return F.when(count < _SHORT, long).otherwise(F.call_function("div", above, _whole(total + ADDED * terms))) + 1


def _found(text: np.ndarray, starts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All matches in ``text``, and the row of each; rows begin at ``starts``."""
    inside = _IN_TERM[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    own = starts[starts < len(text)]
    first[own] |= inside[own]
    ends = np.append(np.flatnonzero(first[inside]), inside.sum()).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[text[inside]])])
    return terms.dictionary_encode(), np.searchsorted(starts, np.flatnonzero(first), side="right") - 1


def _counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and texts, of texts that are small enough together."""
    text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    terms, row = _found(text[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0])
    # One number for (group, term, text), so that one sort counts occurrences and texts.
    size = len(terms.dictionary)
    key = np.sort((group[row] * size + terms.indices.to_numpy()) * len(group) + row)
    new = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
    pair = key[new[:-1]] // max(len(group), 1)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    at = np.append(first, len(pair))
    return pair[first] // max(size, 1), terms.dictionary.take(pa.array(pair[first] % max(size, 1))), np.diff(new[at]), np.diff(at)


def _long(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """As :func:`_counts` for one long text, in parts that end where no term is cut."""
    all_bytes, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and _IN_TERM[all_bytes[end]]:
            end += 1
        piece = pa.array([text[at:end]], pa.binary())
        _, term, n, _ = _counts(piece, np.zeros(1, np.int64))
        parts.append(pa.table({"t": term, "n": n}))
        at = end
    found = pa.concat_tables(parts).group_by("t").aggregate([("n", "sum")]).combine_chunks()
    return np.zeros(len(found), np.int64), found["t"].combine_chunks(), found["n_sum"].to_numpy(), np.ones(len(found), np.int64)


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a few texts."""
    for batch in batches:
        size = np.diff(np.frombuffer(batch.column("_text").buffers()[1], np.int32)[batch.column("_text").offset :][: batch.num_rows + 1])
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + PIECE_BYTES, side="right")))
            part = batch.slice(at, end - at)
            names = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"]).to_pylist()
            known = {(r["lang"], r["source"]): k for k, r in enumerate(names)}
            group = np.array([known[r["lang"], r["source"]] for r in names], np.int64)
            texts = part.column("_text")
            g, terms, n, docs = _long(texts[0].as_py()) if size[at] > PIECE_BYTES else _counts(texts, group)
            g = pa.array(group[0] + g if size[at] > PIECE_BYTES else g)
            yield pa.RecordBatch.from_arrays([part.column("lang").take(g), part.column("source").take(g), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            at = end


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows ``lang, source, term, n, docs``: occurrences of a term in a group, and documents that hold it."""
    rows = docs.select(*_names(lang_col, source_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text"))
    found = rows.mapInArrow(_matches, "lang string, source string, term binary, n long, docs long")
    # Counted in pieces already, so terms go straight to where groups and documents of a language are summed.
    found = found.withColumn("term", F.col("term").cast("string")).repartition("term", "lang")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``.

    Part ``pair``: the summed distance to each other source of the language; part ``term``: the terms that the
    source has more often than its language, the ``top`` first.
    """
    need(docs, lang_col, source_col, text_col)
    counts = term_counts(docs, lang_col, source_col, text_col)
    enough = F.sum("docs").over(Window.partitionBy("term", "lang")) >= least_docs
    counts = written(counts.withColumn("_enough", enough).filter("_enough").select("lang", "source", "term", "n"), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("_all"))
    # One row for each language, and one for each group.
    langs = kept.groupBy("lang").agg(F.count("*").alias("_v"), F.sum("_all").alias("_n"))
    # A group stands for every pair of values that occurs; its texts may be empty.
    groups = docs.select(*_names(lang_col, source_col)).distinct()
    sizes = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("_m")), ["lang", "source"], "left")
    sizes = written(sizes.join(maybe_broadcast(written(langs, "langs")), "lang", "left").na.fill(0, ["_m", "_v", "_n"]), "groups")

    # The empty term stands in one part of every language, beside the vocabulary's.
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
    empty = sizes.select("lang").distinct().select("lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("_all"), F.lit(0).alias("_part"))
    placed = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dense = maybe_broadcast(placed).join(kept.unionByName(empty), ["lang", "_part"]).join(counts, ["term", "source", "lang"], "left").na.fill(0, ["n"])
    word = lambda c: F.when(F.col("term") != "", c).otherwise(0)
    p, q = _frequency(F.col("n"), F.col("_m"), F.col("_v")), _frequency(F.col("_all"), F.col("_n"), F.col("_v"))
    dense = written(dense.select("lang", "source", "term", "n", word(p).alias("p"), word(q).alias("q")), "dense")

    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("_q"))
    apart = dense.join(other, ["term", "lang"]).filter(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("_q"))).alias("value"))
    apart = apart.withColumn("_both", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    pairs = apart.select("lang", "_both.source", F.lit("pair").alias("part"), "_both.item", "value")
    terms = dense.filter((F.col("n") > 0) & (F.col("p") > F.col("q")) & (F.col("term") != "")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # Ranks beyond ``top`` are cut off before the shuffle, so a group's terms never meet in one task.
    return pairs.withColumn("rank", nth).unionByName(terms.withColumn("rank", nth).filter(F.col("rank") <= top))
