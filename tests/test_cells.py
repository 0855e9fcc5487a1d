"""Products cell by cell: nothing that grows with the products is exchanged, and all cuts give the same sums."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.operators import blas23 as b2
from lattica.operators import cells
from lattica.tables import SWEEP
from lattica.timing import spent
from lattica.types import CooMatrix


def noop(df):
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("product", [b2.spgemm, b2.spgemm_balanced])
def test_products_are_not_exchanged(spark, product):
    n = 400  # 3 inner indices: n * n results of 3 products each
    own = spark.range(3 * n).select((F.col("id") / 3).cast("bigint").alias("i"), (F.col("id") % 3).alias("j"), (F.col("id") % 7 + 0.5).alias("v"))
    a = CooMatrix(own, n, 3)
    out = []
    used = spent(spark, lambda: noop(out.append(product(a, a.transpose()).df) or out[0]))
    assert used.shuffle_written < 200_000 and used.spilled == 0
    dense = np.zeros((n, 3))
    for r in own.collect():
        dense[r.i, r.j] = r.v
    assert {(r.i, r.j): r.v for r in out[0].collect()} == {k: v for k, v in np.ndenumerate(dense @ dense.T)}


def stream(entries):
    """Batches of three rows of what Spark sends, sorted."""
    rows = sorted(entries)
    for k in range(0, len(rows), 3):
        yield pa.RecordBatch.from_pylist([dict(zip(("g", "q", "side", "x", "y", "v"), r, strict=True)) for r in rows[k : k + 3]])


@pytest.mark.parametrize("size,sparse", [(1, 12), (7, 12), (7, 0), (1000, 12), (1000, 0)])
def test_slices_give_the_same_sums(monkeypatch, size, sparse):
    monkeypatch.setattr(cells, "SLICE", size)
    monkeypatch.setattr(cells, "SPARSE", sparse)
    r = np.random.default_rng(size)
    a = {(int(i), int(j)): float(v) for i, j, v in zip(r.integers(0, 9, 60), r.integers(0, 8, 60), r.integers(-3, 4, 60), strict=True)}
    b = {(int(i), int(j)): float(v) for i, j, v in zip(r.integers(0, 7, 40), r.integers(0, 50, 40), r.integers(-3, 4, 40), strict=True)}
    sent = [(i // 5, k % 2, 1, i, j, v) for (i, j), v in a.items() for k in range(2)] + [(g, k % 2, 0, j, k, v) for (j, k), v in b.items() for g in range(2)]
    want = {}
    for (i, j), v in a.items():
        for (x, k), w in b.items():
            if x == j:
                want[i, k] = want.get((i, k), 0) + v * w
    got = [tuple(x.values()) for out in cells.multiply(stream(sent)) for x in out.to_pylist()]
    assert len(got) == len(want) and {(i, k): v for i, k, v in got} == want


def test_few_inner_indices_are_cut_both_ways():
    ranges, work = cells._ranges(25e9, 420_000, 420_000, 200)
    assert 8 <= ranges <= 128 and work <= cells.WORK  # a range each of its hundreds of cells would move B as often
    assert cells._ranges(1e9, 36_000_000, 36_000_000, 200)[0] == 200


def test_symmetrize_reads_its_matrix_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    a = CooMatrix(spark.range(30).select((F.col("id") % 5).alias("i"), (F.col("id") % 6).alias("j"), F.lit(2.0).alias("v")).mapInArrow(count, "i bigint, j bigint, v double"), 6, 6)
    assert a.symmetrize(-1).df.count() == 55 and seen.value == 30
    assert sorted({tuple(r) for r in a.symmetrize(-1).df.where("i + j = 1").collect()}) == [(0, 1, -2.0), (0, 1, 2.0), (1, 0, -2.0), (1, 0, 2.0)]


def test_every_cell_is_a_partition(spark, monkeypatch):
    def counted(batches):
        seen = set()
        for b in batches:
            seen |= set(zip(b.column("g").to_pylist(), b.column("q").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([len(seen)], pa.int64()), pa.array([0], pa.int64()), pa.array([0.0])], names=["i", "j", "v"])

    monkeypatch.setattr(cells, "SENT", 500)
    monkeypatch.setattr(cells, "multiply", counted)
    a = CooMatrix(spark.range(4000).select((F.col("id") / 4).cast("bigint").alias("i"), (F.col("id") * 7 % 900).alias("j"), F.lit(1.0).alias("v")), 1000, 900)
    found = [r.i for r in b2.spgemm(a, a.transpose()).df.collect()]
    assert max(found) == 1 and sum(found) >= 16


def test_cells_are_sent_a_bounded_number_of_entries():
    total, entries = 1e7, 1 << 30
    _, work = cells._ranges(total, entries, 1 << 10, 4)
    assert round(total / work) >= entries // cells.SENT


@pytest.mark.parametrize("kind", ["double", "float"])
def test_the_diagonal_of_a_product_is_made_alone(spark, kind):
    own = spark.range(600).select((F.col("id") * 13 % 40).alias("i"), (F.col("id") * 7 % 45).alias("j"), (F.col("id") % 7 + 0.5).cast(kind).alias("v"))
    a = CooMatrix(own, 40, 45)  # coordinates repeat
    for inverse in (False, True):
        out = b2.spgemm_diagonal(a.transpose(), a, inverse)
        assert out.n == 45 and "MapInArrow" not in out.df._jdf.queryExecution().toString()
        assert sorted(out.df.collect()) == sorted(b2.diagonal(b2.spgemm(a.transpose(), a), inverse).df.collect())


def test_entries_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(cells, "SENT", 60_000)  # some twenty ranges, each sent nearly all of B
    own = spark.range(200_000).select((F.col("id") / 4).cast("bigint").alias("i"), F.pmod(F.xxhash64("id"), F.lit(2000)).alias("j"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) + 1.0).alias("v"))
    other = spark.range(40_000).select((F.col("id") % 2000).alias("i"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)).alias("j"), (F.col("id") % 50 + 1.0).alias("v"))
    out = b2.spgemm(CooMatrix(own, 50_000, 2000), CooMatrix(other, 2000, 1000)).df
    used = spent(spark, lambda: noop(out))
    assert used.shuffle_written < 1_500_000  # a row an entry: 3.8 MB


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(k).getName() for k in range(found.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_planning_leaves_no_shuffles(spark):
    own = spark.range(3000).select((F.col("id") % 300).alias("i"), (F.col("id") * 7 % 310).alias("j"), F.lit(1.0).alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    a, there = CooMatrix(own, 300, 310), shuffle_files(spark)
    setting = spark.conf.get(SWEEP, None)
    out = b2.spgemm(a, a.transpose()).df
    assert shuffle_files(spark) <= there and spark.conf.get(SWEEP, None) == setting
    first = sorted(out.collect())
    assert shuffle_files(spark) - there and sorted(out.collect()) == first  # a result's own shuffles stay, for other reads of it


@pytest.mark.parametrize("x", [[0], [3, 3, 2**62, 2**62 + 1], [5, 1, 2**63 - 1, 0]])
def test_packed_entries_come_back(x):
    v = np.array([np.nan, -0.0, np.inf, 1e-320])[: len(x)]
    own = np.array(x, np.int64), np.array(x[::-1], np.int64) - 4, v
    back = cells.unpack(pa.scalar(cells.pack(*own), pa.binary()), len(x))
    assert all(p.tobytes() == q.tobytes() for p, q in zip(own, back, strict=True))


def test_blobs_keep_rows_in_order(monkeypatch):
    monkeypatch.setattr(cells, "BLOB", 2)
    a = [(0, 1, 0, 2.0), (0, 1, 1, 3.0), (0, 1, 2, 4.0), (0, 4, 0, 1.0), (0, 0, 1, 5.0), (1, 0, 0, 7.0)]  # a piece of range 0 read late
    b = [(0, 2, 9, 1.0), (1, 0, 3, 1.0), (0, 0, 9, 2.0), (0, 1, 8, 1.0), (0, 0, 7, 3.0)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["g", "x", "y", "v"])
    blobs = [r for made in (cells.packed_rows([batch(a)]), cells.packed_cells([batch(b[:3]), batch(b[3:])])) for x in made for r in x.to_pylist()]
    assert max(r["n"] for r in blobs) == 2
    blobs.sort(key=lambda r: (r["cell"], r["side"], r["lo"], r["hi"]))
    types = pa.schema([("cell", pa.int32()), ("side", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])
    got = [tuple(x.values()) for out in cells.multiply(cells.unpacked([pa.RecordBatch.from_pylist(blobs, types)])) for x in out.to_pylist()]
    assert sorted(got) == [(0, 3, 7.0), (0, 8, 5.0), (1, 7, 6.0), (1, 8, 3.0), (1, 9, 8.0), (4, 7, 3.0), (4, 9, 2.0)]


def test_what_a_quadratic_product_moves_grows_with_its_factors():
    def moved(n):  # seven inner indices, n rows and columns
        ranges, work = cells._ranges(7.0 * n * n, 7 * n, 7 * n, 200)
        count = round(7.0 * n * n / work)
        return 7 * n * max(1, count / ranges) + min(ranges * 7 * n, 7.0 * n * n)

    assert moved(360_000) < 400_000_000 and moved(720_000) < 2.1 * moved(360_000)
