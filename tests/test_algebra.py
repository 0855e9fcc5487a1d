import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lattica.conf import EngineConf
from lattica.errors import InvalidSize, InvalidSystemSize, InvalidValue
from lattica.events import Queue, wait_all
from lattica.functions.exprs import accurate_sums, ieee_div
from lattica.operators import blas1 as b1
from lattica.operators import blas23 as b2
from lattica.operators import convert as cv
from lattica.operators import prims as pr
from lattica.operators.convert import store
from lattica.plans import solvers
from lattica.plans.solvers import SolverControl, _buckets, bicgstab, cg
from lattica.timing import spent
from lattica.types import CooMatrix, CsrMatrix, DenseMatrix, Vector


def vec(spark, values, kind="double"):
    return Vector(spark.createDataFrame(list(enumerate(values)), f"i bigint, v {kind}"), len(values))


def coo(spark, entries, m, n):
    return CooMatrix(spark.createDataFrame(entries, "i bigint, j bigint, v double"), m, n)


def values(v):
    return [r.v for r in v.df.orderBy("i").collect()]


def test_constant_vectors(spark):
    x, y = Vector.constant(spark, 1024, 4.0), Vector.constant(spark, 1024, 2.0)
    one = lambda df: df.first()[0]
    assert (one(b1.reduce(x)), one(b1.nrm1(x)), one(b1.nrm2(x)), one(b1.dot(x, y))) == (4096, 4096, 128, 8192)
    for out, want in ((b1.scale(2, x), 8), (b1.axpy(2, x, y), 10), (b1.axpby(2, x, 4, y), 16), (b1.add(x, y), 6), (b1.sub(x, y), 2), (b1.mul(x, y), 8), (b1.div(x, y), 2)):
        assert set(values(out)) == {want}


def test_unused_operands_do_not_leak_nan(spark):
    bad, y = vec(spark, [math.nan, math.inf]), vec(spark, [1.0, 2.0])
    assert values(b1.scale(0, bad)) == [0, 0]
    assert values(b1.axpy(0, bad, y)) == [1, 2]
    assert values(b1.axpby(0, bad, 3, y)) == [3, 6]
    a = coo(spark, [(0, 0, 1.0)], 2, 2)
    assert values(b2.csrmv(1, a, y, 0, bad)) == [1, 0]
    assert values(b2.csrmv(0, a, bad, 2, y)) == [2, 4]


def test_ieee_division(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (6.0, 3.0)], "x double, y double").select(ieee_div(F.col("x"), F.col("y")).alias("q")).collect()
    q = [r.q for r in rows]
    assert q[:3] == [math.inf, -math.inf, -math.inf] and math.isnan(q[3]) and q[4] == 2


def test_sparse_vectors_join_as_zeros(spark):
    x = Vector(spark.createDataFrame([(1, 5.0)], "i bigint, v double"), 3, dense=False)
    assert values(b1.add(x, vec(spark, [1.0, 1.0, 1.0]))) == [1, 6, 1]
    assert values(x.completed()) == [0, 5, 0]
    with pytest.raises(InvalidSize):
        b1.add(x, vec(spark, [1.0]))


def test_accurate_sums(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1e16), (1, 1.0), (1, -1e16), (2, 0.1), (3, math.inf), (4, 0.0)], "k int, x double")
    got = {r.k: r.v for r in accurate_sums(df, ["k"], F.col("x")).collect()}
    assert got == {1: 2.0, 2: 0.1, 3: math.inf, 4: 0.0}
    rng = random.Random(3)
    xs = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 12) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert accurate_sums(df, [], F.col("x")).first().v == pytest.approx(math.fsum(xs), rel=1e-15)


def test_accurate_sums_are_exact(spark):
    rng, groups = random.Random(3), {}
    for k in range(40):
        scale = rng.choice([0, 3, 50, 300, -300, -1060, 900, -1074])
        xs = [rng.choice([-1, 1]) * rng.random() * 2.0 ** (rng.randint(-20, 20) + scale) for _ in range(rng.randrange(1, 40))]
        groups[k] = xs + [-x for x in xs] + [5e-324, 1.5] if k % 7 == 0 else xs
    groups |= {100: [1.7e308, -1.7e308, 1e308], 101: [0.0, -0.0], 102: [math.inf, 1.0], 103: [1.0, -1.0]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs] + [(1, None)], "k int, x double")
    got = {r.k: r.v for r in accurate_sums(df, ["k"], F.col("x")).collect()}
    for k, xs in groups.items():
        want = math.fsum(xs)
        assert got[k] == want or abs(got[k] - want) <= math.ulp(want), k
    for n in (1, 3, 11):  # equal bits however the rows are dealt
        dealt = df.repartition(n, F.rand(n))
        assert {r.k: r.v for r in accurate_sums(dealt, ["k"], F.col("x")).collect()} == got
    mixed = {accurate_sums(df.where("k < 100").repartition(n, F.rand(n)), [], F.col("x")).first().v for n in (1, 4, 9)}
    assert mixed == {math.fsum(x for k, xs in groups.items() if k < 100 for x in xs)}
    odd = spark.createDataFrame([(1, math.inf), (1, -math.inf), (2, math.nan), (2, 1.0)], "k int, x double")
    assert all(math.isnan(r.v) for r in accurate_sums(odd, ["k"], F.col("x")).collect())
    assert plan_of(accurate_sums(df, ["k"], F.col("x"))).count("Scan ExistingRDD") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df, marker):
    """How many exchanges of a plan have rows of a scan below them that no aggregation has added up."""
    open_, found = [], 0
    for line in plan_of(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        open_ = [(d, kind) for d, kind in open_ if d < depth]
        if "HashAggregate" in line or "SortAggregate" in line or "ObjectHashAggregate" in line:
            open_.append((depth, "sum"))
        elif "Exchange hashpartitioning" in line:
            open_.append((depth, "exchange"))
        elif marker in line and "FileScan" in line:
            found += any(kind == "exchange" and not any(k == "sum" for e, k in open_ if e > d) for d, kind in open_)
    return found


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_solvers_read_the_stored_matrix_where_it_lies(spark, no_broadcast):
    n, conf = 60, EngineConf(spark)
    a = coo(spark, [(i, j, 4.0 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n], n, n)
    system = solvers._System(a, conf)
    state = conf.store(vec(spark, [1.0] * n).df.select("i", F.col("v").alias("x")), "state", "i")
    plan = system.product(state, F.col("x"), "y")
    assert exchanged(plan, "lattica_matrix") == exchanged(plan, "lattica_state") == 0 and plan_of(plan).count("Exchange hash") == 1
    plain = CooMatrix(conf.checkpoint(a.df), n, n)
    loose = plain.df.join(state.select(F.col("i").alias("j"), "x"), "j")
    assert exchanged(loose, "matrix") + exchanged(loose, "/state-") > 0  # what the check would find otherwise
    out, (total,) = system.times(state, F.col("x"), "y", F.col("y"))
    assert "SelectedBucketsCount" in plan_of(out.join(state.select("i"), "i")) and total == 2 * n + 2
    stored = store(a, "j")
    assert store(stored, "j") is stored and stored.transpose().by == "i" and stored.symmetrize().by is None
    b = vec(spark, [float(k % 5) for k in range(n)])
    got, want = cg(stored, b, control=SolverControl(rel_tol=1e-12, abs_tol=0)), cg(a, b, control=SolverControl(rel_tol=1e-12, abs_tol=0))
    assert values(got.x) == pytest.approx(values(want.x)) and stored.df.count() == a.df.count()  # a matrix stored by its owner stays
    names = {r.tableName for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("lattica_")}
    conf.free(stored.df)
    assert len(names - {r.tableName for r in spark.sql("SHOW TABLES").collect()}) == 1
    with pytest.raises(InvalidValue):
        store(a, "v")


def test_stored_matrices_add_up_without_an_exchange(spark, no_broadcast):
    rng = random.Random(4)
    cells = [{(rng.randrange(20), rng.randrange(20)): float(rng.randrange(1, 9)) for _ in range(90)} for _ in range(2)]
    a, b = (store(coo(spark, [(i, j, v) for (i, j), v in c.items()], 20, 20)) for c in cells)
    out = b2.matrix_add(a, b)
    assert "Exchange" not in plan_of(out.df) and out.by == "i"
    assert {(r.i, r.j): r.v for r in out.df.collect()} == {k: cells[0].get(k, 0) + cells[1].get(k, 0) for k in cells[0].keys() | cells[1].keys()}


def test_adaptive_product_of_a_row_of_a_million(spark):
    long, n = 1_000_000, 1_000_000
    rows = spark.range(long).select(F.lit(3).cast("bigint").alias("i"), F.col("id").alias("j"), (F.col("id") % 7).cast("double").alias("v"))
    short = spark.range(5000).select((5 + F.col("id") % 900).cast("bigint").alias("i"), (F.col("id") * 31 % n).alias("j"), F.lit(2.0).alias("v"))
    a = CooMatrix(rows.unionAll(short), 1000, n)
    blocked = cv.block_rows(a)
    sizes = blocked.df.groupBy("block", "chunk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("rows")).collect()
    assert {r.rows for r in sizes if r.block < 0} == {1} and len([r for r in sizes if r.block < 0]) == math.ceil(long / 3072)
    assert max(r.n for r in sizes) < 4096 and sum(r.n for r in sizes) == long + 5000
    x = Vector.of(spark.range(n), "id", F.col("id") % 5, n)
    out = b2.csrmv_adaptive(1, blocked, x)
    assert {r.i: r.v for r in out.df.collect()} == {r.i: r.v for r in b2.csrmv(1, a, x).df.collect()}
    done = b2.spmv(blocked, x, EngineConf(spark, broadcast_bytes=n * 16))
    assert exchanged(done.where("i >= 5"), "lattica_blocks") == 0  # short rows are summed where they lie
    assert {r.i: r.v for r in done.where("i < 10").collect()} == {r.i: r.v for r in b2.spmv(a, x).where("i < 10").collect()}
    assert {r.i: r.v for r in b2.spmv(blocked, x, EngineConf(spark, broadcast_bytes=0)).collect()} == {r.i: r.v for r in done.collect()}


def test_balanced_product_deals_a_hot_index_evenly(spark):
    conf = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = lambda: spark.range(1500).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).cast("bigint").alias("j"), (F.col("id") % 4 + 1).cast("double").alias("v"))
        a, b = CooMatrix(entries(), 1500, 400), CooMatrix(entries(), 1500, 400).transpose()
        made = b2.balanced_products(a, b).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        sizes = sorted(r.n for r in made.collect())
        assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[4]
        plain = a.df.join(b.df.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        skewed = sorted(r.n for r in plain.collect())
        assert skewed[-1] > 20 * skewed[len(skewed) // 2] and sum(skewed) == sum(sizes)
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(b2.spgemm_balanced(a, b).df) == key(b2.spgemm(a, b).df)
        nothing = CooMatrix(entries().where("i < 0"), 1500, 400)
        assert b2.spgemm_balanced(nothing, b).df.count() == 0
        with pytest.raises(InvalidSize):
            b2.balanced_products(a, a)
    finally:
        for k, v in conf.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("op,fold", [("sum", sum), ("min", min), ("max", max)])
def test_scans_over_blocks(spark, op, fold):
    xs = [float((7 * k) % 11) for k in range(50)]
    df = vec(spark, xs).df
    assert [r.v for r in pr.scan(df, op, block=8).orderBy("i").collect()] == [fold(xs[: k + 1]) for k in range(50)]
    start = {"sum": 0.0, "min": math.inf, "max": -math.inf}[op]
    assert [r.v for r in pr.scan(df, op, inclusive=False, block=8).orderBy("i").collect()] == [fold(xs[:k]) if k else start for k in range(50)]


def test_runs(spark):
    keys = [3, 3, 1, 1, 1, 2, 3, 3]
    df = spark.createDataFrame(list(enumerate(keys)), "i bigint, key int")
    assert [r.flag for r in pr.key_change_flags(df, block=3).orderBy("i").collect()] == [0, 0, 1, 0, 0, 1, 1, 0]
    assert [r.run for r in pr.run_index(df, block=3).orderBy("i").collect()] == [0, 0, 1, 1, 1, 2, 3, 3]
    assert sorted((r.i, r.key) for r in pr.last_of_run(df, block=3).collect()) == [(1, 3), (4, 1), (5, 2), (7, 3)]


def test_sort_by_key(spark):
    keys = [5, -2, 5, 0, 7, -2]
    df = spark.createDataFrame(list(enumerate(keys)), "i bigint, key int")
    for descending in (False, True):
        got = [r.i for r in pr.sort_by_key(df, "key", "i", descending).orderBy("pos").collect()]
        assert got == sorted(range(6), key=lambda k: (-keys[k] if descending else keys[k], k))


@pytest.mark.parametrize("shape,entries", [((3, 4), [(0, 0, 1.5), (0, 2, -1.0), (2, 3, 2.0)]), ((1, 1), []), ((1, 5), [(0, 4, 1.0)]), ((5, 1), [(4, 0, 1.0)])])
def test_round_trips(spark, shape, entries):
    m, n = shape
    a = coo(spark, entries, m, n)
    csr = cv.coo2csr(a)
    rows = csr.df.orderBy("i").collect()
    assert [r.nnz for r in rows] == [sum(e[0] == i for e in entries) for i in range(m)]
    assert [r.off for r in rows] == [sum(e[0] < i for e in entries) for i in range(m)]
    back = lambda x: sorted(map(tuple, x.df.collect()))
    assert back(cv.csr2coo(csr)) == sorted(entries)
    dense = cv.csr2dense(csr)
    assert all(len(r.vals) == n for r in dense.df.collect())
    assert back(cv.dense2coo(dense)) == sorted(entries)
    assert back(cv.csr2coo(cv.dense2csr(dense))) == sorted(entries)


def test_products_against_plain_python(spark):
    rng = random.Random(5)
    a = {(rng.randrange(6), rng.randrange(5)): float(rng.randint(-14, 14)) for _ in range(14)}
    b = {(rng.randrange(5), rng.randrange(4)): float(rng.randint(-14, 14)) for _ in range(10)}
    A, B = coo(spark, [(*k, v) for k, v in a.items()], 6, 5), coo(spark, [(*k, v) for k, v in b.items()], 5, 4)
    x, y = [float(k + 1) for k in range(5)], [float(k) for k in range(6)]
    want = [2 * sum(v * x[j] for (i, j), v in a.items() if i == r) + 3 * y[r] for r in range(6)]
    for matrix in (A, cv.coo2csr(A)):
        for conf in (EngineConf(spark), EngineConf(spark, broadcast_bytes=0), EngineConf(spark, extended_precision=True)):
            assert values(b2.csrmv(2, matrix, vec(spark, x), 3, vec(spark, y), conf)) == want
    product = {}
    for (i, j), v in a.items():
        for (k, l), w in b.items():
            if j == k:
                product[i, l] = product.get((i, l), 0) + v * w
    assert {(r.i, r.j): r.v for r in b2.spgemm(A, B).df.collect()} == product
    dense = DenseMatrix(spark.createDataFrame([(i, [b.get((i, j), 0.0) for j in range(4)]) for i in range(5)], "i bigint, vals array<double>"), 5, 4)
    got = {r.i: r.vals for r in b2.csrmm(1, A, dense).df.collect()}
    assert got == {i: [product.get((i, j), 0.0) for j in range(4)] for i in range(6)}
    with pytest.raises(InvalidSize):
        b2.spgemm(A, A)


def test_cancellation_keeps_the_entry(spark):
    a, b = coo(spark, [(0, 0, 1.0), (0, 1, 1.0)], 1, 2), coo(spark, [(0, 0, 1.0), (1, 0, -1.0)], 2, 1)
    assert b2.spgemm(a, b).df.collect()[0].v == 0
    assert b2.spgemm(a, b).prune().df.count() == 0


def test_wide_dense_product(spark):
    a = coo(spark, [(0, 0, 2.0), (1, 1, 3.0)], 2, 2)
    b = DenseMatrix(spark.createDataFrame([(i, [float(i + k) for k in range(70)]) for i in range(2)], "i bigint, vals array<double>"), 2, 70)
    got = {r.i: r.vals for r in b2.csrmm(1, a, b).df.collect()}
    assert got == {0: [2.0 * k for k in range(70)], 1: [3.0 * (k + 1) for k in range(70)]}


def test_row_blocks_cut_long_rows(spark):
    df = spark.range(5000).select(F.lit(1).cast("bigint").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    rows = {r.i: (r.nnz, r.block, r.chunks) for r in cv.row_blocks(CooMatrix(df, 3, 5000)).collect()}
    assert rows == {0: (0, 0, 1), 1: (5000, -1, 2), 2: (0, 0, 1)}
    stats = cv.row_stats(CooMatrix(df, 3, 5000)).first()
    assert (stats.rows, stats.nnz, stats.empty_rows, stats.max_nnz, stats.nnz_per_row, round(stats.mean_nnz, 3), round(stats.deviation, 3)) == (3, 5000, 2, 5000, 1666, 1666.667, 2357.023)


def tridiagonal(spark, n, below, mid, above):
    rows = [(i, j, v) for i in range(n) for j, v in ((i - 1, below), (i, mid), (i + 1, above)) if 0 <= j < n]
    return coo(spark, rows, n, n)


def test_solvers(spark):
    tight = SolverControl(rel_tol=1e-10, abs_tol=0.0, max_iters=30)
    out = cg(tridiagonal(spark, 6, -1.0, 2.0, -1.0), Vector.constant(spark, 6, 1.0), control=tight)
    assert out.converged and values(out.x) == pytest.approx([(i + 1) * (6 - i) / 2 for i in range(6)])
    a = tridiagonal(spark, 6, -1.5, 4.0, -1.0)
    b = b2.csrmv(1, a, vec(spark, [float(i % 4) for i in range(6)]))
    out = bicgstab(a, b, control=SolverControl("diagonal", 30, 1e-10, 0.0))
    assert out.converged and values(out.x) == pytest.approx([i % 4 for i in range(6)], abs=1e-8)


def test_solver_ends(spark):
    a, ones = tridiagonal(spark, 8, -1.0, 2.0, -1.0), Vector.constant(spark, 8, 1.0)
    zero = cg(a, Vector.constant(spark, 8, 0.0))
    assert (zero.iterations, zero.converged, set(values(zero.x))) == (0, True, {0.0})
    none = bicgstab(a, ones, control=SolverControl(max_iters=0))
    assert (none.iterations, none.converged) == (0, False)
    capped = cg(a, ones, control=SolverControl(max_iters=1, rel_tol=0.0, abs_tol=0.0))
    assert (capped.iterations, capped.converged) == (1, False)
    with pytest.raises(InvalidSystemSize):
        cg(a, Vector.constant(spark, 7, 1.0))
    with pytest.raises(InvalidValue):
        cg(coo(spark, [(0, 1, 1.0), (1, 0, 1.0)], 2, 2), Vector.constant(spark, 2, 1.0), control=SolverControl("diagonal"))


def test_sort_by_any_key(spark):
    rows = [(0, 1.7, "b"), (1, 1.2, None), (2, None, "a"), (3, -0.5, "b"), (4, math.inf, "ä"), (5, 1.2, ""), (6, None, "B")]
    df = spark.createDataFrame(rows, "i bigint, x double, s string").repartition(3)
    order = lambda key, down: [r.i for r in pr.sort_by_key(df, key, "i", down).orderBy("pos").collect()]
    assert order("x", False) == [3, 1, 5, 0, 4, 2, 6] and order("x", True) == [4, 0, 1, 5, 3, 2, 6]
    assert order("s", False) == [5, 6, 2, 0, 3, 4, 1]
    assert [r.pos for r in pr.sort_by_key(df, "x", "i").collect()] == list(range(7))
    hot = spark.range(1000).select(F.lit("same").alias("key"), F.col("id").alias("i"))
    assert [r.pos for r in pr.sort_by_key(hot, "key", "i").collect()] == list(range(1000))
    assert pr.sort_by_key(df.where("1 = 0"), "x", "i").count() == 0


def test_scan_over_three_levels(spark):
    df = vec(spark, [float(k % 5) for k in range(200)]).df
    assert pr.levels_for(200, 4) == 4
    for levels in (2, 3, 4):
        assert [r.v for r in pr.scan(df, block=4, levels=levels).orderBy("i").collect()] == [sum(j % 5 for j in range(k + 1)) for k in range(200)]
        keyed = pr.scan(df.withColumn("k", F.col("i") % 2), keys=["k"], block=4, levels=levels, inclusive=False)
        assert [r.v for r in keyed.orderBy("i").collect()] == [sum(j % 5 for j in range(k % 2, k, 2)) for k in range(200)]


def test_dense_forms_add_repeats(spark):
    a = coo(spark, [(0, 3, 1.0), (0, 0, 2.0), (0, 3, 4.0), (2, 1, -1.0), (2, 1, 1.0)], 3, 5)
    csr = cv.coo2csr(a)
    assert {r.i: r.vals for r in cv.csr2dense(csr).df.collect()} == {0: [2.0, 0.0, 0.0, 5.0, 0.0], 1: [0.0] * 5, 2: [0.0] * 5}
    dense = DenseMatrix(spark.createDataFrame([(0, [0.0, math.nan, 3.0]), (1, [0.0] * 3), (2, [-0.0, 1.0, 0.0])], "i bigint, vals array<double>"), 3, 3)
    rows = cv.dense2csr(dense).df.orderBy("i").collect()
    assert [(r.off, r.nnz, r.cols) for r in rows] == [(0, 2, [1, 2]), (2, 0, []), (2, 1, [1])]
    assert math.isnan(rows[0].vals[0]) and rows[2].vals == [1.0]


def test_single_precision(spark):
    a = CooMatrix(spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2)], "i bigint, j bigint, v float"), 1, 2)
    x = vec(spark, [1.0, 1.0], "float")
    out = b2.csrmv(1, a, x)
    assert dict(out.df.dtypes)["v"] == "float" and values(out) == [pytest.approx(0.3, abs=1e-7)]
    assert dict(b2.csrmv(1, a, vec(spark, [1.0, 1.0])).df.dtypes)["v"] == "double"
    b = DenseMatrix(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "i bigint, vals array<float>"), 2, 2)
    assert dict(b2.csrmm(1, a, b).df.dtypes)["vals"] == "array<float>"
    assert dict(b2.spgemm(a, a.transpose()).df.dtypes)["v"] == "float"


def test_settings(spark):
    from lattica.conf import __version__

    assert len(__version__) == 4
    conf = EngineConf(spark, eager=True)
    y = b2.csrmv(1, coo(spark, [(0, 0, 2.0)], 1, 1), vec(spark, [3.0]), conf=conf)
    assert y.df.inputFiles() and values(y) == [6]  # computed when it was asked for
    conf.free(y.df)
    with pytest.raises(Exception, match="(?i)not.*exist"):
        y.df.collect()
    kept = spark.createDataFrame([(1,)], "x int")
    conf.free(kept)
    assert kept.count() == 1


def test_solver_leaves_one_table(spark):
    import os

    from lattica.tables import folder

    there = lambda: {x for x in os.listdir(f"{folder(spark).removeprefix('file://')}/lattica") if x.startswith("state-")}
    spark.range(1).write.mode("overwrite").parquet(f"{folder(spark)}/lattica/other")
    before = there()
    out = cg(tridiagonal(spark, 6, -1.0, 2.0, -1.0), Vector.constant(spark, 6, 1.0), control=SolverControl(rel_tol=1e-10, abs_tol=0.0))
    assert out.iterations >= 3 and len(there() - before) == 1
    assert values(out.x) == pytest.approx([(i + 1) * (6 - i) / 2 for i in range(6)])


def test_own_preconditioner(spark):
    a, b = tridiagonal(spark, 6, -1.0, 4.0, -1.0), Vector.constant(spark, 6, 1.0)
    plain = cg(a, b, control=SolverControl(rel_tol=1e-10, abs_tol=0.0))
    half = SolverControl(lambda m: m.df.sparkSession.range(m.n).select(F.col("id").alias("i"), F.lit(0.5).alias("d")), rel_tol=1e-10, abs_tol=0.0)
    for solve in (cg, bicgstab):
        assert values(solve(a, b, control=half).x) == pytest.approx(values(plain.x))
    with pytest.raises(InvalidValue):
        SolverControl("unheard of")


def test_timer():
    from lattica.timing import Timer

    timer = Timer([1.0, 1.1, 0.9, 9.0])
    assert timer.prune() == 1 and timer.mean == pytest.approx(1.0) and timer.deviation == pytest.approx(0.0816, abs=1e-3)
    assert len(Timer().run(lambda: None, 3).seconds) == 3 and Timer().mean == 0 and Timer([2.0]).prune() == 0


def test_scratch_tables_go(spark):
    from lattica.tables import cut, new_path, scratch

    path = new_path(spark, "result")
    with scratch(spark):
        first = cut(spark.range(5), "first")
        cut(first.where("id > 1"), "second").write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        first.collect()


@pytest.mark.parametrize("broadcast", [0, 64 << 20])
def test_wide_operands_go_by_tiles(spark, monkeypatch, broadcast):
    monkeypatch.setattr(b2, "WIDE", 4)
    rng = random.Random(2)
    cells = {(rng.randrange(6), rng.randrange(5)): float(rng.randrange(1, 9)) for _ in range(14)}
    dense = [[float(rng.randrange(9)) for _ in range(11)] for _ in range(5)]
    b = DenseMatrix(spark.createDataFrame(list(enumerate(dense)), "i bigint, vals array<double>"), 5, 11)
    out = b2.csrmm(2, coo(spark, [(i, j, v) for (i, j), v in cells.items()], 6, 5), b, conf=EngineConf(spark, broadcast_bytes=broadcast))
    got = {r.i: list(r.vals) for r in out.df.collect()}
    assert got == {i: [sum(2 * v * dense[j][k] for (r, j), v in cells.items() if r == i) for k in range(11)] for i in range(6)}
    assert "posexplode(vals" not in plan_of(out.df)


@pytest.mark.parametrize("entry", [(9, 0, 1.0), (0, -1, 1.0), (None, 0, 1.0), (0, None, 1.0), (1, 1, None)])
def test_entries_that_do_not_belong_raise(spark, entry):
    x = vec(spark, [1.0, 2.0])
    good = coo(spark, [(0, 1, 3.0), (1, 0, 4.0)], 2, 2)
    assert values(b2.csrmv(1, good.checked(), x)) == values(b2.csrmv(1, good, x))
    bad = coo(spark, [(0, 1, 3.0), entry], 2, 2).checked()
    with pytest.raises(Exception, match="not an entry of a 2 x 2 matrix"):
        b2.csrmv(1, bad, x).df.collect()
    assert plan_of(b2.csrmv(1, bad, x).df).count("Scan ExistingRDD") == 2  # A and x, once each


def test_repeated_coordinates_raise_when_asked(spark):
    df = spark.createDataFrame([(0, 1, 3.0), (0, 1, 4.0), (1, 1, 1.0)], "a bigint, b bigint, x double")
    assert sorted(map(tuple, CooMatrix.from_entries(df, "a", "b", "x", 2, 2).df.collect())) == [(0, 1, 7.0), (1, 1, 1.0)]
    with pytest.raises(Exception, match=r"repeated coordinate \(0, 1\)"):
        CooMatrix.from_entries(df, "a", "b", "x", 2, 2, dup="error").df.collect()
    assert CooMatrix.from_entries(df.where("x <> 4"), "a", "b", "x", 2, 2, dup="error").df.count() == 2


def slow(spark, seconds, n=4):
    import time

    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(0, n, 1, n).mapInPandas(wait, "id long")


def test_events_overlap_wait_and_cancel(spark):
    import time

    with Queue(spark, 2) as queue:
        began = time.perf_counter()
        one, two = (queue.submit(lambda n=n: slow(spark, 3, 2).count() + n) for n in (10, 20))
        assert not one.done()
        with pytest.raises(TimeoutError):
            one.wait(0.01)
        assert wait_all(one, two) == [12, 22] and one.done() and not one.cancel()
        together = time.perf_counter() - began
        long = queue.submit(lambda: slow(spark, 120, 2).count())
        while not spark.sparkContext.statusTracker().getActiveJobsIds():
            time.sleep(0.1)
        assert long.cancel()
        with pytest.raises(Exception, match="cancel"):
            long.wait(60)
        failing = queue.submit(lambda: 1 // 0)
        with pytest.raises(ZeroDivisionError):
            failing.wait()
    assert together < 3 * 2 + 20 and time.perf_counter() - began < 100


def test_sorting_exchanges_rows_once(spark):
    df = spark.range(500).select((F.col("id") * 7 % 50).alias("key"), "id")
    out = pr.sort_by_key(df, "key", "id", ordered=False)
    assert "Exchange hashpartitioning(key" not in plan_of(out) and "rangepartitioning" not in plan_of(out)
    want = sorted(((k * 7 % 50, k) for k in range(500)))
    assert sorted((r.pos, r.key, r.id) for r in out.collect()) == [(p, *w) for p, w in enumerate(want)]


def test_neighbours_of_many_blocks(spark):
    df = vec(spark, [float(k * k % 10) for k in range(60)]).df.where("i % 7 <> 3").select("i", F.col("v").alias("key"))
    for step in (-1, 1):
        plain, deep = ({r.i: r.b for r in pr.neighbour(df, "key", "b", step, block=3, levels=n).collect()} for n in (2, 4))
        assert plain == deep
    rows = [r.i for r in df.orderBy("i").collect()]
    assert [deep[i] for i in rows[:-1]] == [float(j * j % 10) for j in rows[1:]] and deep[rows[-1]] is None
    assert [r.run for r in pr.run_index(df, block=3, levels=4).orderBy("i").collect()] == [r.run for r in pr.run_index(df).orderBy("i").collect()]
    assert sorted(r.i for r in pr.last_of_run(df, block=3, levels=4).collect()) == sorted(r.i for r in pr.last_of_run(df).collect())


def test_metrics_of_a_run(spark):
    from lattica.timing import spent

    other = spent(spark, lambda: spark.range(10).count())
    of = spent(spark, lambda: spark.range(0, 200_000, 1, 3).groupBy((F.col("id") % 1000).alias("k")).count().write.format("noop").mode("overwrite").save())
    assert of.stages == 2 and of.tasks >= 4 and of.cpu_seconds > 0 and of.task_seconds > 0
    assert of.shuffle_written == of.shuffle_read > 8000 > other.shuffle_written and of.spilled == 0
    with pytest.raises(ZeroDivisionError):
        spent(spark, lambda: 1 // 0)


def test_dense_rows_take_time_linear_in_their_entries(spark):
    n, k = 30_000, 60_000  # every column twice
    row = spark.range(1).select(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("off"), F.lit(k).cast("bigint").alias("nnz"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda e: (e % n).cast("bigint")).alias("cols"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda e: e.cast("double")).alias("vals"))
    began = time.perf_counter()
    got = cv.csr2dense(CsrMatrix(row, 1, n)).df.first()
    assert time.perf_counter() - began < 20
    assert got.vals == [float(2 * j + n) for j in range(n)]


def test_dense_rows_stay_where_they_lie(spark):
    dense = DenseMatrix(spark.range(3000).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda e: (e * F.col("id") % 5).cast("double")).alias("vals")), 3000, 32)
    out = cv.csr2dense(cv.dense2csr(dense)).df
    used = spent(spark, lambda: out.write.format("noop").mode("overwrite").save())
    assert used.shuffle_written < 10_000
    assert {r.i: r.vals for r in out.collect()} == {i: [float(j * i % 5) for j in range(32)] for i in range(3000)}


@pytest.mark.parametrize("solve", [cg, bicgstab])
def test_small_systems_have_few_tasks(spark, solve):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        a = coo(spark, [(i, j, 4.0 if i == j else -1.0) for i in range(30) for j in (i - 1, i, i + 1) if 0 <= j < 30], 30, 30)
        out = []
        used = spent(spark, lambda: out.append(solve(a, Vector.constant(spark, 30, 1.0), control=SolverControl(rel_tol=1e-8, abs_tol=0.0))))
        assert out[0].converged and used.tasks < 20 * (out[0].iterations + 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_buckets_grow_with_the_entries():
    assert _buckets(75, 200) == 1 and _buckets(1 << 21, 200) == 8 and _buckets(1 << 26, 200) == 200 and _buckets(1 << 32, 200) == 1024
