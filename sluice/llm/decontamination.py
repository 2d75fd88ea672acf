"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

Texts and items are compared in a plain form: lower case, letters and digits, single spaces.  A window
of an item (any ``w`` of its bytes, or the whole of a shorter item) stands in a text if some region there
is within ``k`` edits of it.  Such a region shares at least ``w - q + 1 - k q`` of the window's q-grams,
all inside ``k + 1`` diagonals.  Shared q-grams are therefore laid out by diagonal band (twice that wide,
overlapping by half) and place in the item; wherever as many as the bound lie within a window, the
windows there are aligned inside the band and kept if they need at most ``k`` edits.

Windows have two sizes, WINDOWS, with an edit for ten bytes.  So a verbatim part of 64 bytes is found
at whatever offset it begins, and a whole copy with fewer than 6 edits in 64 bytes.  Items shorter than
EXACT_BELOW bytes are found as whole words, without edits.

Items are searched for in blocks of bounded size, each broadcast; a text's plain form is made once and
searched with one block after the other; texts are never moved.

Defined results: a null or empty text has no region; an item without letters and digits is not searched
for; repeated items and rows are reported each; an item found in several places of a text gives a row
for each; ids may be of any type; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.batches import slices
from sluice.llm.common import maybe_broadcast, need, written

Q = 8
#: Bytes of the windows of an item, and bytes from one window to the next where a find is measured.
WINDOWS, STEP = (64, 96), 16
#: Edits allowed, as a share of a window's bytes.
EDITS = 0.1
#: Items of fewer bytes are found without edits only.
EXACT_BELOW = 24
#: Bytes of items that are searched for at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of texts that are searched at a time, and shared q-grams that are laid out at a time.
TEXT_BYTES, LAID = 1 << 20, 1 << 21
#: Diagonals from one band to the next; a band is twice as wide.
_BAND_STEP = int(EDITS * WINDOWS[-1]) + 1
_BITS = 20
#: Between texts and between items that are searched together: longer than a window with its edits, and
#: never part of one.
_GAP = b"\0" * 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "))


def _grams(data: bytes) -> np.ndarray:
    """The q-gram at each byte; the last places hold none."""
    n = len(data)
    padded = data + b"\0" * (16 - n % 8)
    out = np.empty((n // 8 + 1) * 8, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(padded, "<u8", n // 8 + 1, k) if k + (n // 8 + 1) * 8 <= len(padded) else np.frombuffer(padded + b"\0" * 8, "<u8", n // 8 + 1, k)
    return out[:n]


def _budget(size: int) -> tuple[int, int]:
    """Edits allowed in a window, and q-grams that a region within them shares at least."""
    k = 0 if size < EXACT_BELOW else min(int(EDITS * size), (size - Q) // Q)
    return k, size - Q + 1 - k * Q


class Patterns:
    """The q-grams of a block of items, (number, plain form) each.

    Items below EXACT_BELOW bytes stand between spaces; the shortest of all, which have no q-gram, are
    looked up as they are.
    """

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.tiny: dict[bytes, list[int]] = defaultdict(list)
        held = []
        for number, data in items:
            data = data if len(data) >= EXACT_BELOW else b" " + data + b" "
            if len(data) < Q:
                self.tiny[data].append(number)
            else:
                held.append((number, data))
        self.tiny_found = re.compile(b"(?=(" + b"|".join(map(re.escape, sorted(self.tiny, key=len, reverse=True))) + b"))") if self.tiny else None
        # Exact items have bounds of their own, so they do not loosen those of the others.
        self.parts = [_Grams(own) for own in ([i for i in held if len(i[1]) >= EXACT_BELOW + 2], [i for i in held if len(i[1]) < EXACT_BELOW + 2]) if own]

    def regions(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, begin, end, windows, edits): overlapping finds of an item are one region."""
        out = []
        sizes = np.array([len(t) for t in texts], np.int64)
        for a, b in slices(np.r_[0, np.cumsum(sizes)], TEXT_BYTES):
            out += [(a + f[0], *f[1:]) for f in self._regions(texts[a:b])]
        return out

    def _regions(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        # Texts begin at whole steps, so that bands lie the same whatever stands before them.
        held = [b" " + t + b" " + _GAP + b"\0" * (-(len(t) + 2 + len(_GAP)) % _BAND_STEP) for t in texts]
        data = b"".join(held)
        first = np.cumsum([0, *map(len, held)]) + 1
        spans = defaultdict(list)
        found = [f for part in self.parts for f in part.find(data)]
        if self.tiny_found:
            found += [(number, (m.start(1), m.start(1)), m.start(1), m.end(1), 0) for m in self.tiny_found.finditer(data) for number in self.tiny[m.group(1)]]
        for item, window, begin, end, edits in found:
            text = int(np.searchsorted(first, (begin + end) // 2 + 1, side="right")) - 1
            spans[text, item].append((max(0, begin - int(first[text])), min(len(texts[text]), end - int(first[text])), edits, window))
        out = []
        for (text, item), own in sorted(spans.items()):
            best: dict[tuple, int] = {}
            begin = end = -1
            for a, b, edits, window in sorted(own):
                if best and a > end:
                    out.append((text, item, begin, end, len(best), max(best.values())))
                    best = {}
                begin, end = (begin, max(end, b)) if best else (a, b)
                best[window] = min(edits, best.get(window, edits))
            out.append((text, item, begin, end, len(best), max(best.values())))
        return out


class _Grams:
    """Items one after the other, with the places of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.number = [n for n, _ in items]
        self.data = np.frombuffer(_GAP + _GAP.join(d for _, d in items) + _GAP, np.uint8)
        size = np.array([len(d) for _, d in items], np.int64)
        self.begin = np.cumsum(np.r_[len(_GAP), size[:-1] + len(_GAP)])
        self.end = self.begin + size
        #: Windows by item and size: bytes, edits and bound.
        self.window = np.stack([np.minimum(size, w) for w in WINDOWS], 1)
        budgets = {int(w): _budget(int(w)) for w in np.unique(self.window)}
        self.k = np.vectorize(lambda w: budgets[w][0])(self.window)
        self.bound = np.vectorize(lambda w: budgets[w][1])(self.window)
        self.least, self.reach = int(self.bound.min()), int((self.window + self.k).max())
        grams = _grams(self.data.tobytes())
        item = np.repeat(np.arange(len(items)), np.maximum(size - Q + 1, 0))
        at = np.concatenate([np.arange(b, e - Q + 1) for b, e in zip(self.begin, self.end, strict=True)])
        order = np.argsort(grams[at], kind="stable")
        self.at, self.item = at[order], item[order]
        self.grams, self.first, self.count = np.unique(grams[self.at], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _BITS, bool)
        with np.errstate(over="ignore"):
            self.table[(self.grams * _MULTIPLIER) >> np.uint64(64 - _BITS)] = True

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the q-gram) of the q-grams of ``data`` that the items have."""
        g = _grams(data)
        with np.errstate(over="ignore"):
            place = np.flatnonzero(self.table[(g * _MULTIPLIER) >> np.uint64(64 - _BITS)])
        if not len(place):
            return place, place
        own = g[place]
        number = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        right = self.grams[number] == own
        place, number = place[right], number[right]
        # A region holds at least `least` hits within `reach` bytes; places without are left out.
        n = self.least - 1
        if n and len(place):
            near = np.zeros(len(place), bool)
            if len(place) > n:
                dense = np.flatnonzero(place[n:] - place[: len(place) - n] <= self.reach)
                edge = np.zeros(len(place) + 1, np.int64)
                np.add.at(edge, dense, 1)
                np.add.at(edge, dense + n + 1, -1)
                near = np.cumsum(edge[:-1]) > 0
            place, number = place[near], number[near]
        return place, number

    def _stretches(self, place: np.ndarray) -> list[int]:
        """Where hits may be cut: no region reaches over a longer gap between places."""
        return [0, *(np.flatnonzero(np.diff(place) > self.reach) + 1).tolist(), len(place)]

    def find(self, data: bytes) -> list[tuple[int, tuple[int, int], int, int, int]]:
        """(number of the item, window, begin, end, edits) of all windows that stand in ``data``."""
        place, number = self.hits(data)
        if not len(place):
            return []
        out, text = [], np.frombuffer(data, np.uint8)
        cuts, n = self._stretches(place), np.r_[0, np.cumsum(self.count[number])]
        a = 0
        while a < len(cuts) - 1:
            b = a + 1
            while b < len(cuts) - 1 and n[cuts[b + 1]] - n[cuts[a]] <= LAID:
                b += 1
            out += self._find(text, place[cuts[a] : cuts[b]], number[cuts[a] : cuts[b]])
            a = b
        return out

    def _find(self, text: np.ndarray, place: np.ndarray, number: np.ndarray) -> list[tuple[int, tuple[int, int], int, int, int]]:
        """As :meth:`find`, in a stretch.  One with very many shared q-grams is laid out by ranges of bands."""
        n = self.count[number]
        total, out = int(n.sum()), []
        ranges = -(-total // LAID)
        lowest, highest = (int(place[0]) - len(self.data)) // _BAND_STEP - 1, int(place[-1]) // _BAND_STEP + 1
        for part in range(ranges):
            low = lowest + (highest - lowest + 1) * part // ranges
            high = lowest + (highest - lowest + 1) * (part + 1) // ranges
            keys, items = [], []
            # Hits are taken a slice at a time; of each, those of the range's bands stay.
            for a, b in slices(np.r_[0, np.cumsum(n)], LAID):
                row = np.repeat(np.arange(a, b), n[a:b])
                entry = np.repeat(self.first[number[a:b]] - np.r_[0, np.cumsum(n[a:b])[:-1]], n[a:b]) + np.arange(n[a:b].sum())
                at = self.at[entry]
                band = (place[row] - at) // _BAND_STEP
                for k in (band, band - 1):
                    mine = (k >= low) & (k < high)
                    keys.append(((k[mine] - lowest) << 32) | at[mine]), items.append(self.item[entry[mine]])
            key, item = np.concatenate(keys), np.concatenate(items)
            # A q-gram of a window counts once in a band, however often the text has it there.
            key, order = np.unique(key, return_index=True)
            out += self._windows(text, key, item[order], lowest)
        return out

    def _windows(self, text: np.ndarray, key: np.ndarray, item: np.ndarray, lowest: int) -> list[tuple[int, tuple[int, int], int, int, int]]:
        out, last = [], len(key) - 1
        known: dict[tuple[int, int], list[int]] = defaultdict(list)
        for size in range(len(WINDOWS)):
            w, bound = self.window[item, size], self.bound[item, size]
            top = np.arange(len(key)) + bound - 1
            ahead = key[np.minimum(top, last)]
            some = np.flatnonzero((top <= last) & (ahead - key <= w - Q))
            if size:  # items no longer than the smaller window are done
                some = some[self.window[item[some], size] > self.window[item[some], size - 1]]
            if not len(some):
                continue
            owner, band = item[some], (key[some] >> 32) + lowest
            at, then = key[some] & 0xFFFFFFFF, ahead[some] & 0xFFFFFFFF
            low, high = np.maximum(then - (w[some] - Q), self.begin[owner]), np.minimum(at, self.end[owner] - w[some])
            fit = low <= high
            # Overlapping ranges of beginnings in a band are one; `some` is in order of band and place.
            low, high, owner, band = low[fit], high[fit], owner[fit], band[fit]
            if not len(low):
                continue
            code = (band - band.min()) << 32
            new = np.r_[True, low[1:] + code[1:] > np.maximum.accumulate(high + code)[:-1] + 1]
            head = np.flatnonzero(new)
            low, high = low[head], np.maximum.reduceat(high + code, head) - code[head]
            owner, band = owner[head], band[head]
            # Windows some way apart first; all of a range only where none of those stands in the text,
            # nor one of the smaller size in its band.
            for step in (STEP, 1):
                open_ = np.flatnonzero([not any(i - WINDOWS[-1] <= p <= j + WINDOWS[-1] for p in known[o, k]) for o, k, i, j in zip(owner.tolist(), band.tolist(), low.tolist(), high.tolist(), strict=True)])
                if not len(open_):
                    break
                n = -(-(high - low)[open_] // step) + 1
                found = self._aligned(text, size, *self._starts(low[open_], high[open_], n, step), owner[open_], band[open_])
                for r, s, a, b, edits in found:
                    o, k = int(owner[open_[r]]), int(band[open_[r]])
                    known[o, k].append(s + int(self.begin[o]))
                    out.append((self.number[o], (size, s), a, b, edits))
        return out

    @staticmethod
    def _starts(low: np.ndarray, high: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(range, beginning): ``n`` places of each range, ``step`` apart, the last at its end."""
        row = np.repeat(np.arange(len(low)), n)
        nth = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        return row, np.minimum(low[row] + nth * step, high[row])

    def _aligned(self, text: np.ndarray, size: int, row: np.ndarray, start: np.ndarray, owner: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, window's place in its item, begin, end, edits) of the windows within their budget."""
        out = []
        windows = self.window[owner[row], size]
        for m in np.unique(windows):
            own = np.flatnonzero(windows == m)
            for part in np.array_split(own, -(-len(own) // 512)):
                r, s = row[part], start[part]
                k = self.k[owner[r], size]
                cost, begin, end = self._banded(text, s, s + band[r] * _BAND_STEP, int(m))
                for c in np.flatnonzero(cost <= k):
                    out.append((int(r[c]), int(s[c] - self.begin[owner[r[c]]]), max(0, int(begin[c])), min(len(text), int(end[c])), int(cost[c])))
        return out

    def _banded(self, text: np.ndarray, start: np.ndarray, low: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, begin, end) of the best region for each window, on diagonals from ``low`` on."""
        width = 2 * _BAND_STEP + 1
        shift = np.arange(width)
        wanted = self.data[start[:, None] + np.arange(m)]
        at = low[:, None] + np.arange(m + width)
        there = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], 0)
        cost = np.zeros((len(start), width), np.int32)
        begin = (low[:, None] + shift).astype(np.int64)
        none = np.full((len(start), 1), 1 << 16, np.int32)
        for i in range(m):
            step = cost + (there[:, i : i + width] != wanted[:, i : i + 1])
            skip = np.concatenate([cost[:, 1:] + 1, none], 1)
            better = skip < step
            step = np.where(better, skip, step)
            origin = np.where(better, np.concatenate([begin[:, 1:], begin[:, -1:]], 1), begin)
            run = np.minimum.accumulate((step - shift) * 4096 + shift, axis=1)
            source = run & 4095
            cost = (run >> 12).astype(np.int32) + shift.astype(np.int32)
            begin = np.take_along_axis(origin, source, 1)
        best = cost.argmin(1)
        rows = np.arange(len(start))
        return cost[rows, best], begin[rows, best], low + m + best


def _found(told: list, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(row, block, item, begin, end, windows, edits) of all regions, some rows at a time."""
    for at in range(0, len(texts), 1000):
        own = [t.encode() for t in texts.slice(at, 1000).to_pylist()]
        for n, block in enumerate(told):
            for i, *found in block.value.regions(own):
                yield (at + i, n, *found)


def _search(told: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, block, item, a, b, n, edits = ([] for _ in range(7))
            texts = batch.column("_plain")
            for i, k, which, s, e, windows, cost in _found(told, texts):
                data = texts[i].as_py().encode()
                row.append(i), block.append(k), item.append(which), n.append(windows), edits.append(cost)
                a.append(data.count(b" ", 0, s) + (data[s : s + 1] == b" ")), b.append(data.count(b" ", 0, e) + 1)
            own = [c for c in batch.schema.names if c != "_plain"]
            cols = [batch.column(c).take(pa.array(row, pa.int64())) for c in own]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (block, item, a, b, n, edits))], names=[*own, "_block", "_item", "word_start", "word_end", "n_patterns", "edits"])

    return run


def find_regions(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows ``doc_id, item_id, word_start, word_end, n_patterns, edits``: where texts hold items.

    Places count words of the plain form; ``edits`` is the most that a pattern of the region needs.
    """
    need(docs, id_col, text_col)
    need(benchmark, item_col, item_text)
    told, items = _blocks(benchmark, item_col, item_text)
    texts = docs.select(F.col(id_col).alias("doc_id"), plain(F.col(text_col)).alias("_plain"))
    found = texts.mapInArrow(_search(told), f"doc_id {dict(texts.dtypes)['doc_id']}, _block long, _item long, word_start long, word_end long, n_patterns long, edits long")
    return found.join(maybe_broadcast(items), ["_block", "_item"]).select("doc_id", "item_id", "word_start", "word_end", "n_patterns", "edits")


def count_regions(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows ``_row, n_regions`` for every row of ``docs``: its own columns, and how many regions it holds.

    Rows are neither joined nor moved, so null and repeated ids do not matter.
    """
    need(docs, text_col)
    need(benchmark, item_col, item_text)
    told, _ = _blocks(benchmark, item_col, item_text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), plain(F.col(text_col)).alias("_plain"))
    return rows.mapInArrow(_count(told), f"_row {dict(rows.dtypes)['_row']}, n_regions long")


def _count(told: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for i, *_ in _found(told, batch.column("_plain")):
                n[i] += 1
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(n)], names=["_row", "n_regions"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> tuple[list, DataFrame]:
    """The blocks' patterns, broadcast each, and the ids of their items (_block, _item, item_id)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), plain(F.col(f"`{item_text}`")).alias("t")).filter("t <> ''")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    # Equal texts are one pattern, whose number stands for all their ids.
    texts = items.groupBy("t").agg(F.collect_list(F.struct("item_id")).alias("_ids")).withColumn("_block", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    texts = written(texts.withColumn("_item", F.monotonically_increasing_id()), "items")
    told = []
    for k in range(blocks):
        own = texts.filter(F.col("_block") == k).select("_item", "t").toArrow()
        held = zip(own.column("_item").to_pylist(), own.column("t").to_pylist(), strict=True)
        told.append(spark.sparkContext.broadcast(Patterns(sorted((n, t.encode()) for n, t in held))))
    return told, texts.select("_block", "_item", F.explode("_ids").alias("_id")).select("_block", "_item", "_id.item_id")
