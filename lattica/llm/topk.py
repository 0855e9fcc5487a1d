"""Exact top-k inner-product search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become integers floor(scale * x).  Candidates lie in groups; a group keeps, for every dimension, its rows in
descending order.  For a query, each dimension's list is read from the end that helps it (descending where the
query's component is positive, ascending where negative; lists of zero components add nothing and are not read), all
lists to the same depth, which doubles.  A row seen for the first time gets its exact score by random access.  No
unseen row can beat the threshold, the sum of the products at that depth; the query is done when the threshold is
below its k-th best score (ties go on, as a smaller id may win), or when the lists have shown every row.  Only unseen
rows are candidates of a query; a row that several queries of a tile reach at once is scored for all of these together.

Queries and groups meet as blocks: every pair of a query block and a candidate group is one bounded task, and each
query merges k rows a group.  A candidate is copied once for every ``query_block`` queries.

Defined results: vectors null, empty, or holding null or non-finite components take no part on either side, nor do
those with a component whose scaled size reaches the root of 2**62 / length less 1, so that scores have 64 bits; vectors
of unlike lengths do not meet; a query's own id is no candidate of it; rows that repeat an id are separate
candidates; query rows that repeat id and vector ask once, those that repeat an id with another vector ask each for
itself; fewer candidates than k give fewer rows; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_DEPTH, TILE = 4, 64
#: Integers of doubles are exact up to here.
EXACT = 1 << 53
RESULT = "query_id long, _no long, vec_id long, score long, read double"


class Block:
    """Candidates with their sorted lists."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.order = np.argsort(-values.T, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)


def scores(queries: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where none can exceed their integers, else by 64-bit or Python integers."""
    bound = int(np.abs(values).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, values.shape[1])
    if bound < EXACT:
        return (queries.astype(np.float64) @ values.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return queries @ values.T
    return queries.astype(object) @ values.T.astype(object)


class Best:
    """The best k of each of n queries, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def kth(self, q: int) -> int | None:
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.k else None

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        kth = self.kth(q)
        if kth is not None:
            better = score >= kth
            ids, score = ids[better], score[better]
        if len(ids) > self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            ids, score = ids[score >= cut], score[score >= cut]
            if len(ids) > self.k:
                keep = np.lexsort((ids, -score))[: self.k]
                ids, score = ids[keep], score[keep]
        if len(ids):
            new = [(-int(s), int(i)) for i, s in zip(ids.tolist(), score.tolist(), strict=True)]
            self.rows[q] = sorted(self.rows[q] + new)[: self.k]


def search(block: Block, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> np.ndarray:
    """The threshold algorithm of every query on one group; returns the share of each query's lists that was read.

    Queries go in tiles of 64: a bit of a row's number tells whether a query has seen the row.
    """
    n, one = len(block.ids), np.uint64(1)
    depths = np.full(len(queries), n)
    for s in range(0, len(queries), TILE):
        active = np.arange(s, min(s + TILE, len(queries)))
        bits = one << (active - s).astype(np.uint64)
        seen, depth = np.zeros(n, np.uint64), 0
        while len(active):
            reach = min(n, max(FIRST_DEPTH, 2 * depth))
            q = queries[active]
            fresh = np.zeros(n, np.uint64)
            for j in range(q.shape[1]):
                up, down = np.bitwise_or.reduce(bits[q[:, j] > 0]), np.bitwise_or.reduce(bits[q[:, j] < 0])
                if up:
                    fresh[block.order[j, depth:reach]] |= up
                if down:
                    fresh[block.order[j, n - reach : n - depth]] |= down
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            found, ids, fresh = scores(q, block.values[rows]), block.ids[rows], fresh[rows]
            high, low = block.sorted[:, reach - 1], block.sorted[:, n - reach]
            edges = np.where(q > 0, high, low)
            bound = int(np.abs(edges).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, q.shape[1])
            threshold = (edges * q).sum(1) if bound < 1 << 63 else (edges.astype(object) * q.astype(object)).sum(1)
            whole = np.bitwise_and.reduce(seen)
            going = np.zeros(len(active), bool)
            for k, query in enumerate(active.tolist()):
                kth = best.kth(query)
                own = np.arange(len(rows)) if kth is None else np.flatnonzero(found[k] >= kth)
                own = own[((fresh[own] & bits[k]) != 0) & (ids[own] != query_ids[query])]
                best.offer(query, ids[own], found[k, own])
                kth = best.kth(query)
                going[k] = reach < n and not (kth is not None and int(threshold[k]) < kth) and not whole & bits[k]
            depths[active[~going]] = reach
            active, bits, depth = active[going], bits[going], reach
    return depths / max(n, 1)


class ExactTopK:
    """Each query's k candidates of highest integer inner product."""

    def __init__(self, k: int = 5, scale: int = 256, group_rows: int = 16384, query_block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding"):
        if min(k, scale, group_rows, query_block) < 1:
            raise ValueError("k, scale and the block sizes are positive")
        self.k, self.scale, self.group_rows, self.query_block = k, scale, group_rows, query_block
        self.id_col, self.vector_col = id_col, vector_col

    def quantised(self, vectors: DataFrame) -> DataFrame:
        """(id, v) with v the integer vector; rows that can't take part are left out."""
        x = F.col(self.vector_col).cast("array<double>")
        sound = F.size(x) > 0
        most = F.sqrt(F.lit(2.0**62) / F.size(x)) - 1
        finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * float(self.scale)) < most))
        rows = vectors.where(F.col(self.id_col).isNotNull() & F.col(self.vector_col).isNotNull()).where(sound & finite)
        return rows.select(F.col(self.id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * self.scale)).alias("v"))

    def _met(self, vectors: DataFrame, queries: DataFrame) -> DataFrame:
        """Each query's best k of each group, with the share of its lists read there."""
        wanted, held = self.quantised(queries).distinct().withColumn("_no", F.xxhash64("id", "v")), self.quantised(vectors)
        n_queries, n = wanted.count(), held.count()
        q_blocks, c_groups = max(1, math.ceil(n_queries / self.query_block)), max(1, math.ceil(n / self.group_rows))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        asked = wanted.select("id", "v", "_no", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(q_blocks)).cast("int").alias("_q"), every(c_groups).alias("_c"))
        offered = held.select("id", "v", F.pmod(F.xxhash64("id", "v", F.lit(5)), F.lit(c_groups)).cast("int").alias("_c"), every(q_blocks).alias("_q"))
        k = self.k

        def meet(key: tuple, asked: pa.Table, offered: pa.Table) -> pa.Table:
            found: list[tuple] = []
            by_size = lambda t: {d: np.flatnonzero(size == d) for size in [np.array(pc.list_value_length(t.column("v")))] for d in np.unique(size)}
            of_q, of_c = by_size(asked), by_size(offered)
            for dims in of_q.keys() & of_c.keys():
                mine = asked.take(pa.array(of_q[dims]))
                (qi, qv), (ci, cv) = (_matrix(t, int(dims)) for t in (mine, offered.take(pa.array(of_c[dims]))))
                best = Best(len(qi), k)
                read = search(Block(ci, cv), qi, qv, best)
                found += [(q, no, c, -s, part) for q, no, own, part in zip(qi.tolist(), mine.column("_no").to_pylist(), best.rows, read.tolist(), strict=True) for s, c in own]
            kinds = (("query_id", pa.int64()), ("_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("read", pa.float64()))
            return pa.table({name: pa.array([f[i] for f in found], kind) for i, (name, kind) in enumerate(kinds)})

        return asked.groupBy("_q", "_c").cogroup(offered.groupBy("_q", "_c")).applyInArrow(meet, RESULT)

    def transform(self, vectors: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score, read) for rows of ``queries`` against all of ``vectors``.

        ``read`` is the share of the sorted lists that was read in the group the row comes from.
        """
        rank = F.row_number().over(Window.partitionBy("query_id", "_no").orderBy(F.desc("score"), "vec_id")).cast("int")
        return self._met(vectors, queries).withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score", "read")


def _matrix(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    v = table.column("v").combine_chunks()
    return table.column("id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
