"""Centroid clustering of quantised vectors, each different one counted once with its multiplicity.

Components become integers floor(scale * x).  Vectors that are then equal collapse into one row with their number, in
an aggregation that combines before it shuffles, so copies cost what one of them costs.  Lloyd's rounds read that
table: a task assigns its vectors and adds up their components times their multiplicities, one row for each centroid;
the centroids alone, k times ``size`` numbers, meet on the driver, as exact floors of integer sums over counts.  At the
end the assignments are joined back to the rows by 128 bits of the vector's hash.  A vector that at least one in
``HOT`` rows share is joined by broadcast, and there are at most ``HOT`` of them; the others meet by shuffle.

The first centroids are the k rows with the smallest sha256 of ``<seed>:<id>``.  A vector goes to its nearest centroid by
squared distance, ties to the smaller number; a centroid without vectors stays where it is.

Defined results: vectors null, of another size, or with components that are null, not finite, or of 2**27 or more when
scaled take no part, so that every squared distance has 64 bits; fewer vectors than k give as many centroids; rows that
repeat an id are vectors each by itself; rows without an id are first centroids only if there are too few others; where
hashes tie the smaller vector is first; an empty table gives an empty result; extra columns play no part.  An inertia
of more than 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import cut

#: Scaled components stay below it, so that 64 squares of differences add up within 64 bits.
BOUND = 1 << 27
HOT = 1024
#: Vectors that are compared with the centroids at once.
SLICE = 1 << 13
Centroids = list[tuple[int, ...]]


@dataclass(frozen=True)
class Clustering:
    """``members`` (vec_id, cluster, distance) of every row that takes part, ``distinct`` (q, weight, cluster, distance) of every different vector, final centroids, and of each one the sum of its distances."""

    members: DataFrame
    distinct: DataFrame
    centroids: Centroids
    inertias: list[int]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, and the squared distance to it."""
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for k, c in enumerate(centroids):
        d = x - c
        own = np.einsum("ij,ij->i", d, d)
        cluster[own < best] = k
        best = np.minimum(best, own)
    return cluster, best


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().astype(np.int64).reshape(-1, size)


class WeightedLloyd:
    """``rounds`` rounds of Lloyd's algorithm with k centroids over integer vectors of ``size`` components."""

    def __init__(self, k: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"):
        if not 1 <= k <= 1024 or not 1 <= size <= 64 or rounds < 0:
            raise ValueError("k lies in 1..1024, size in 1..64, and rounds is not negative")
        self.k, self.rounds, self.scale, self.size, self.seed, self.id_col, self.vector_col = k, rounds, scale, size, seed, id_col, vector_col

    def quantised(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, q, d1, d2) of every row that takes part: its integers, and 128 bits of hash."""
        own = vectors.select(F.col(self.id_col).alias("vec_id"), F.col(self.vector_col).cast("array<double>").alias("_e"))
        own = own.where((F.size("_e") == self.size) & F.forall("_e", lambda x: F.abs(x * float(self.scale)) < float(BOUND)))
        own = own.select("vec_id", F.transform("_e", lambda x: F.floor(x * float(self.scale)).cast("int")).alias("q"))
        return own.withColumns({"d1": F.xxhash64("q"), "d2": F.xxhash64(F.lit(self.seed), "q")})

    def first(self, quantised: DataFrame) -> Centroids:
        drawn = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.col("vec_id").cast("string")), 256)
        return [tuple(r.q) for r in quantised.select(drawn.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(self.k).collect()]

    def fit(self, vectors: DataFrame) -> Clustering:
        rows = self.quantised(vectors)
        distinct = cut(rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight"), F.first("d1").alias("d1"), F.first("d2").alias("d2")), "distinct")
        centroids = self.first(rows)
        for _ in range(self.rounds):
            moved = self._moved(distinct, centroids)
            if moved == centroids:  # the rounds that are left would change nothing
                break
            centroids = moved
        placed = cut(self._placed(distinct, centroids), "placed")
        sums = placed.groupBy("cluster").agg(F.sum(F.col("weight").cast("decimal(20,0)") * F.col("distance").cast("decimal(18,0)")).alias("s")).collect()  # k rows
        inertia = {r.cluster: int(r.s) for r in sums}
        return Clustering(self._members(rows, placed), placed.select("q", "weight", "cluster", "distance"), centroids, [inertia.get(c, 0) for c in range(len(centroids))])

    def _moved(self, distinct: DataFrame, centroids: Centroids) -> Centroids:
        """Centroids after a round."""
        if not centroids:
            return centroids
        size, at = self.size, np.array(centroids, np.int64).reshape(-1, self.size)

        def add(batches):
            n, total = np.zeros(len(at), np.int64), np.zeros((len(at), size), np.int64)
            for whole in batches:
                for begin in range(0, len(whole), SLICE):
                    batch = whole.slice(begin, SLICE)
                    x, weight = _vectors(batch, size), batch.column("weight").to_numpy()
                    cluster, _ = nearest(x, at)
                    np.add.at(n, cluster, weight)
                    order = np.argsort(cluster, kind="stable")
                    begins = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                    total[cluster[order[begins]]] += np.add.reduceat(x[order] * weight[order, None], begins, axis=0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

        parts = distinct.select("q", "weight").mapInArrow(add, "cluster int, n long, total array<long>")
        exact = lambda c: F.sum(c.cast("decimal(38,0)"))
        sums = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), *(exact(F.get("total", F.lit(d))).alias(f"s{d}") for d in range(size))).collect()  # k rows
        out = list(centroids)
        for r in sums:
            out[r.cluster] = tuple(int(r[f"s{d}"]) // int(r.n) for d in range(size))
        return out

    def _placed(self, distinct: DataFrame, centroids: Centroids) -> DataFrame:
        size, at = self.size, np.array(centroids, np.int64).reshape(-1, self.size)

        def place(batches):
            for whole in batches:
                for begin in range(0, len(whole), SLICE):
                    batch = whole.slice(begin, SLICE)
                    cluster, distance = nearest(_vectors(batch, size), at)
                    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"cluster": pa.array(cluster), "distance": pa.array(distance)}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return distinct.mapInArrow(place, "q array<int>, weight long, d1 long, d2 long, cluster int, distance long")

    def _members(self, rows: DataFrame, placed: DataFrame) -> DataFrame:
        """(vec_id, cluster, distance) of every row."""
        total = placed.agg(F.sum("weight")).first()[0] or 0
        told = placed.select("d1", "d2", "cluster", "distance", (F.col("weight") * HOT >= total).alias("hot"))
        hot, rest = told.where("hot").drop("hot"), told.where("NOT hot").drop("hot")
        own, out = rows.select("vec_id", "d1", "d2"), ("vec_id", "cluster", "distance")
        shared = own.join(F.broadcast(hot), ["d1", "d2"])  # HOT rows at most
        others = own.join(F.broadcast(hot.select("d1", "d2")), ["d1", "d2"], "left_anti").join(rest, ["d1", "d2"])
        return shared.select(*out).unionByName(others.select(*out))
