"""Benchmark decontamination by greedy string tiling.

Every benchmark item is cut into rolling seeds of ``min_match`` lower-cased words; documents probe them with every
rolling window of their own.  A document and an item that share seeds enough to reach the coverage are tiled: the
longest common runs that do not overlap words already marked on either side are found with Karp-Rabin hashes and
marked, longest first, until none of ``min_match`` words is left.  Tiles may lie in any order, so reordered passages
count.  The item is leaked when tiles cover at least ``coverage`` of its words.

Items of fewer than ``min_match`` words are their own only seed.  The benchmark is broadcast whole when its size,
counted first, is at most ``broadcast_bytes``, and beyond that in parts of at most that size (or of one larger item),
each of which reads the documents once more: documents are never shuffled, and a seed that many documents and items share makes no task larger.

Tiling lists no pairs of places: for each place of the item the next free place of the document with its hash is
taken, so a round costs about the words of the document's parts that share seeds with the item.

Defined results: null or empty texts and items without words match nothing; null ids are kept as null ids; rows
that repeat an id are judged one by one; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.shared import cut
from lattica.llm.tokens import U64, WINDOW_MULT, Words, mix, pieces, power_table, rolling, window_starts, words

TILE = T.StructType([T.StructField(k, T.LongType()) for k in ("doc_word", "item_word", "n_words")])
RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("item_words", T.LongType()),
    T.StructField("covered_words", T.LongType()),
    T.StructField("n_tiles", T.LongType()),
    T.StructField("coverage", T.DoubleType()),
    T.StructField("tiles", T.ArrayType(TILE)),
])


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i] + 1, ... n[i] values each."""
    ends = np.cumsum(n)
    return np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Windows:
    """Karp-Rabin hashes of the windows of a word sequence, of any length."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        self.up, self.down = power_table(WINDOW_MULT[0], n + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate(([U64(0)], np.cumsum(words * self.up[:n], dtype=U64)))

    def of(self, length: int) -> np.ndarray:
        n = max(len(self.words) - length + 1, 0)
        with np.errstate(over="ignore"):
            return mix((self.total[length : length + n] - self.total[:n]) * self.down[:n])


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Places where windows of that length begin that hold no marked word."""
    if len(marked) < length:
        return np.zeros(0, np.int64)
    before = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(before[length:] == before[:-length])


def _shared(x: _Windows, y: _Windows, marked_x: np.ndarray, marked_y: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Free places of x whose window's hash y has too, by hash and place, and for each of y's places its part of them."""
    at_x, at_y = _free(marked_x, length), _free(marked_y, length)
    hx, hy = x.of(length)[at_x], y.of(length)[at_y]
    kinds, which = np.unique(hy, return_inverse=True)
    i = np.searchsorted(kinds, hx)
    hit = np.flatnonzero(kinds[np.minimum(i, len(kinds) - 1)] == hx) if len(kinds) else i[:0]
    by = np.argsort(i[hit], kind="stable")
    borders = np.searchsorted(i[hit][by], np.arange(len(kinds) + 1))
    return at_x[hit[by]], borders, at_y, which


def tile(x: np.ndarray, y: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in x, start in y, length) of two word sequences; longest first, ties from the left of y, then of x."""
    shortest = max(1, min(min_match, len(y)))
    wy = _Windows(y)
    # only what lies in windows that y has can be tiled; other words between stand for a mark
    seeds = np.flatnonzero(np.isin(_Windows(x).of(shortest), wy.of(shortest))) if len(x) else np.zeros(0, np.int64)
    if not len(seeds):
        return []
    near = np.zeros(len(x) + 1, np.int64)
    np.add.at(near, seeds, 1)
    np.add.at(near, seeds + shortest, -1)
    near = np.cumsum(near[:-1]) > 0
    place = np.flatnonzero(near | np.concatenate(([False], near[:-1])))  # each part with the word behind it
    wx = _Windows(x[place])
    marked_x, marked_y = (~near[place]).astype(np.int64), np.zeros(len(y), np.int64)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(place), len(y))
    while top >= shortest:
        lo, hi = shortest, top  # a common run of some length implies shorter ones: the longest is found by halving
        if not len(_shared(wx, wy, marked_x, marked_y, lo)[0]):
            break
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(_shared(wx, wy, marked_x, marked_y, mid)[0]) else (lo, mid - 1)
        at_x, borders, at_y, which = _shared(wx, wy, marked_x, marked_y, lo)
        following = borders[:-1].copy()  # marks are never taken back, so each list is walked once
        found = 0
        for j, kind in zip(at_y.tolist(), which.tolist(), strict=True):
            if marked_y[j : j + lo].any():
                continue
            k, end = following[kind], borders[kind + 1]
            while k < end and marked_x[at_x[k] : at_x[k] + lo].any():
                k += 1
            following[kind] = k
            if k < end and np.array_equal(wx.words[at_x[k] : at_x[k] + lo], y[j : j + lo]):
                i = int(at_x[k])
                marked_x[i : i + lo] = marked_y[j : j + lo] = 1
                tiles.append((int(place[i]), j, lo))
                found += 1
        top = lo if found else lo - 1
    return tiles


def _seeds(w: Words, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and their texts: rolling windows, or the whole of a shorter text."""
    at = window_starts(w.first, min_match)
    hashes, owner = [rolling(w.hash, min_match)[at]], [np.searchsorted(w.first, at, side="right") - 1]
    n = w.lengths
    for k in range(1, min_match):
        short = np.flatnonzero(n == k)
        hashes.append(rolling(w.hash, k)[w.first[short]])
        owner.append(short)
    return np.concatenate(hashes), np.concatenate(owner)


def _probes(w: Words, lengths: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for k in lengths:
        at = window_starts(w.first, k)
        out.append((k, at, rolling(w.hash, k)[at]))
    return out


class _Items:
    """The benchmark as hashes: words of each item, and sorted seeds with the items that hold them."""

    def __init__(self, ids: list, texts: pa.Array, min_match: int):
        w = words(texts, lower=True)
        self.ids, self.first, self.hash = ids, w.first, w.hash
        seed, owner = _seeds(w, min_match)
        by = np.lexsort((owner, seed))
        self.seed, self.owner = seed[by], owner[by]
        self.lengths = sorted({int(min(n, min_match)) for n in w.lengths if n})

    def pairs(self, w: Words, min_match: int, coverage: float) -> np.ndarray:
        """Distinct (document, item) numbers that share seeds of enough of the item's words."""
        found = []
        for k, at, h in _probes(w, self.lengths):
            if len(self.seed) and len(h):
                i = np.minimum(np.searchsorted(self.seed, h), len(self.seed) - 1)
                hit = np.flatnonzero(self.seed[i] == h)
                doc = np.searchsorted(w.first, at[hit], side="right") - 1
                doc, lo = np.unique(np.stack((doc, i[hit]), 1), axis=0).T if len(hit) else (doc, hit)
                n = np.searchsorted(self.seed, self.seed[lo], "right") - lo
                both, places = np.unique(np.stack((np.repeat(doc, n), self.owner[_spread(lo, n)]), 1), axis=0, return_counts=True)
                size = np.diff(self.first)[both[:, 1]] if len(both) else places
                found.append(both[np.minimum(places * min(k, min_match), size) >= coverage * size])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _rows(judged: list[tuple]) -> pa.Table:
    tiles = pa.array([[dict(zip(TILE.names, t, strict=True)) for t in r[-1]] for r in judged], pa.list_(pa.struct([(k, pa.int64()) for k in TILE.names])))
    kinds = [pa.int64()] * 5 + [pa.float64()]
    return pa.table([*(pa.array([r[i] for r in judged], k) for i, k in enumerate(kinds)), tiles], names=RESULT.names)


def _judge(doc_id, item_id, x: np.ndarray, y: np.ndarray, min_match: int, coverage: float) -> tuple | None:
    tiles = tile(x, y, min_match)
    covered = sum(n for _, _, n in tiles)
    if not len(y) or covered < coverage * len(y):
        return None
    return doc_id, item_id, len(y), covered, len(tiles), covered / len(y), tiles


class Decontaminator:
    """Documents that hold passages of benchmark items, in whatever order."""

    def __init__(self, min_match: int = 5, coverage: float = 0.5, broadcast_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
        if min_match < 1 or not 0 < coverage <= 1:
            raise ValueError("min_match is at least 1 and coverage lies in (0, 1]")
        self.min_match, self.coverage, self.broadcast_bytes = min_match, coverage, broadcast_bytes
        self.id_col, self.text_col, self.item_col, self.item_text_col = id_col, text_col, item_col, item_text_col

    def leaks(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """One row per document and item it leaks, with the tiles; see RESULT."""
        docs = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.col(self.text_col).alias("text"))
        items = benchmark.select(F.col(self.item_col).cast("long").alias("item_id"), F.col(self.item_text_col).alias("text"))
        return reduce(DataFrame.unionByName, [self._broadcast(docs, part) for part in self.parts(items)])

    def parts(self, items: DataFrame) -> list[DataFrame]:
        """The items in parts of at most ``broadcast_bytes``, or of a single item; equal rows are dealt by their place."""
        bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
        size = items.agg(F.sum(bytes_of)).first()[0] or 0
        if size <= self.broadcast_bytes:
            return [items]
        placed, n = cut(items.withColumn("_place", F.monotonically_increasing_id()), "benchmark"), math.ceil(size / self.broadcast_bytes)
        while True:
            part = F.pmod(F.xxhash64("text", "item_id", "_place"), F.lit(n))
            over = placed.groupBy(part.alias("part")).agg(F.sum(bytes_of).alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") > self.broadcast_bytes) & (F.col("n") > 1))
            if over.isEmpty():
                return [placed.where(part == k).drop("_place") for k in range(n)]
            n *= 2

    def _broadcast(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        rows = sorted((r.item_id is None, r.item_id or 0, r.text or "", r.item_id) for r in items.collect())  # about broadcast_bytes
        held = docs.sparkSession.sparkContext.broadcast(([r[3] for r in rows], [r[2] for r in rows]))
        min_match, coverage = self.min_match, self.coverage

        def judge(batches):
            ids, texts = held.value
            bench = _Items(ids, pa.array(texts, pa.large_string()), min_match)
            for batch in pieces(batches, "text"):
                w = words(batch.column("text"), lower=True)
                names = batch.column("doc_id").to_pylist()
                judged = [_judge(names[d], bench.ids[i], w.hash[w.first[d] : w.first[d + 1]], bench.hash[bench.first[i] : bench.first[i + 1]], min_match, coverage) for d, i in bench.pairs(w, min_match, coverage).tolist()]
                yield from _rows([r for r in judged if r]).to_batches()

        return docs.mapInArrow(judge, RESULT)
