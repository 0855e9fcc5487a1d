"""One query for each operator of the algebra over the test tables, and the SQL it must agree with.

A is orders x parts (quantities), Q parts x suppliers, x and u part sizes, w part keys modulo 11, y customer keys of
orders modulo 7: all integral, so that sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.conf import EngineConf, __version__
from lattica.errors import EngineError
from lattica.events import Queue, wait_all
from lattica.functions.exprs import accurate_sums
from lattica.operators import blas1 as b1
from lattica.operators import blas23 as b2
from lattica.operators import convert as cv
from lattica.operators import prims as pr
from lattica.plans.solvers import SolverControl, bicgstab, cg
from lattica.sources import mtx
from lattica.streaming.accumulate import accumulate, accumulate_windows, finals, latest, merged, start, start_final, start_merged
from lattica.tables import cut, new_path, write_text
from lattica.types import CooMatrix, DenseMatrix, Vector

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Matrices and vectors of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.size: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        if name not in self.size:
            self.size[name] = self.table(name).count()
        return self.size[name]

    def matrix(self, i: str, j: str, m: str, n: str, kind: str = "double") -> CooMatrix:
        return CooMatrix.from_entries(self.table("lineitem"), i, j, "l_quantity", self.rows(m), self.rows(n), kind=kind)

    @property
    def A(self) -> CooMatrix:
        return self.matrix("l_orderkey", "l_partkey", "orders", "part")

    @property
    def Q(self) -> CooMatrix:
        return self.matrix("l_partkey", "l_suppkey", "part", "supplier")

    @property
    def u(self) -> Vector:
        return Vector.of(self.table("part"), "p_partkey", "p_size", self.rows("part"))

    @property
    def w(self) -> Vector:
        return Vector.of(self.table("part"), "p_partkey", F.col("p_partkey") % 11, self.rows("part"))

    @property
    def y(self) -> Vector:
        return Vector.of(self.table("orders"), "o_orderkey", F.col("o_custkey") % 7, self.rows("orders"))

    @property
    def B(self) -> DenseMatrix:
        cols = [F.col("p_size"), F.col("p_partkey") % 11, F.lit(1)]
        return DenseMatrix(self.table("part").select(F.col("p_partkey").cast("bigint").alias("i"), F.array(*(c.cast("double") for c in cols)).alias("vals")), self.rows("part"), 3)

    @property
    def C(self) -> DenseMatrix:
        own = F.array(*((F.col("o_custkey") % k).cast("double") for k in (7, 5, 3)))
        return DenseMatrix(self.table("orders").select(F.col("o_orderkey").cast("bigint").alias("i"), own.alias("vals")), self.rows("orders"), 3)

    def poisson(self, below: float = -1.0, mid: float = 2.0, above: float = -1.0, table: str = "nation", key: str = "n_nationkey") -> CooMatrix:
        """A tridiagonal matrix over the rows of a table."""
        n = self.rows(table)
        own = self.table(table).select(F.col(key).cast("bigint").alias("i"))
        bands = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(v).alias("v")) for d, v in ((-1, below), (0, mid), (1, above)))))
        df = own.select("i", bands.alias("e")).select("i", (F.col("i") + F.col("e.d")).cast("bigint").alias("j"), F.col("e.v").alias("v"))
        return CooMatrix(df.where((F.col("j") >= 0) & (F.col("j") < n)), n, n)


A = "A AS (SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
Q = "Q AS (SELECT CAST(l_partkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
V = "V AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS u, CAST(p_partkey % 11 AS DOUBLE) AS w FROM part)"
Y = "Y AS (SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_custkey % 7 AS DOUBLE) AS y FROM orders)"
AX = "AX AS (SELECT A.i, sum(A.v * V.u) AS s FROM A JOIN V ON A.j = V.i GROUP BY 1)"
RUNS = "K AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_orderkey AS key, CAST(l_quantity AS DOUBLE) AS v FROM lineitem)"


def query(name: str, sql: str | None, make: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql


def vectors(name: str, expression: str, make: Callable[[Tables], Vector], kind: str = "DOUBLE") -> None:
    """A query of one vector over the parts."""
    query(name, f"WITH {V} SELECT i, CAST({expression} AS {kind}) AS v FROM V", lambda t: make(t).df)


# elementwise
vectors("scale", "2.5e0 * u", lambda t: b1.scale(2.5, t.u))
vectors("scale_zero", "0e0", lambda t: b1.scale(0, t.u))
vectors("axpy", "3 * u + w", lambda t: b1.axpy(3, t.u, t.w))
vectors("axpy_minus", "w - 3 * u", lambda t: b1.axpy(3, t.u, t.w, minus=True))
vectors("axpy_alpha0", "w", lambda t: b1.axpy(0, t.u, t.w))
vectors("axpby", "2 * u + 3 * w", lambda t: b1.axpby(2, t.u, 3, t.w))
vectors("axpby_fill", "0e0", lambda t: b1.axpby(0, t.u, 0, t.w))
vectors("axpby_scale_y", "3 * w", lambda t: b1.axpby(0, t.u, 3, t.w))
vectors("axpby_scale_x", "2 * u", lambda t: b1.axpby(2, t.u, 0, t.w))
vectors("axpby_alpha1", "u + 3 * w", lambda t: b1.axpby(1, t.u, 3, t.w))
vectors("axpby_beta1", "2 * u + w", lambda t: b1.axpby(2, t.u, 1, t.w))
vectors("axpby_minus", "2 * u - 3 * w", lambda t: b1.axpby(2, t.u, 3, t.w, minus=True))
vectors("vec_add", "u + w", lambda t: b1.add(t.u, t.w))
vectors("vec_sub", "u - w", lambda t: b1.sub(t.u, t.w))
vectors("vec_mul", "u * w", lambda t: b1.mul(t.u, t.w))
vectors("vec_div", "u / w", lambda t: b1.div(t.u, t.w))
vectors("vec_min", "least(u, w)", lambda t: b1.minimum(t.u, t.w))
vectors("vec_max", "greatest(u, w)", lambda t: b1.maximum(t.u, t.w))
vectors("fill", "7e0", lambda t: b1.fill(t.u, 7))
vectors("copy", "u", lambda t: b1.copy(t.u))
vectors("nonzero_mask", "w <> 0", lambda t: b1.nonzeros(t.w), "INTEGER")
query("element_at", f"WITH {V} SELECT i, u AS v FROM V WHERE i = 17", lambda t: b1.element(t.u, 17))
query("vec_equal", f"WITH {V} SELECT count(*) FILTER (u IS DISTINCT FROM w) = 0 AS equal FROM V", lambda t: b1.equal(t.u, t.w))
query("explicit_zero_filter", f"WITH {V} SELECT i, w AS v FROM V WHERE w <> 0", lambda t: t.w.df.where("v <> 0"))
query("vec_slice", f"WITH {V} SELECT i - 10 AS i, u AS v FROM V WHERE i BETWEEN 10 AND 109", lambda t: t.u.slice(10, 100).df)

# reductions
query("reduce_int", "SELECT CAST(sum(p_size) AS BIGINT) AS v FROM part", lambda t: b1.reduce(Vector.of(t.table("part"), "p_partkey", "p_size", t.rows("part"), "int")))
query("reduce_float", "SELECT CAST(sum(p_size) AS FLOAT) AS v FROM part", lambda t: b1.reduce(Vector.of(t.table("part"), "p_partkey", "p_size", t.rows("part"), "float")))
query("reduce_double", "SELECT sum(l_quantity) AS v FROM lineitem", lambda t: b1.reduce(Vector(t.table("lineitem").select(F.lit(0).alias("i"), F.col("l_quantity").alias("v")), t.rows("lineitem"))))
query("vec_equal_copy", f"WITH {V} SELECT count(*) FILTER (2 * u IS DISTINCT FROM u + u) = 0 AS equal FROM V", lambda t: b1.equal(b1.scale(2, t.u), b1.add(t.u, t.u)))
query("reduce_empty", f"WITH {V} SELECT coalesce(sum(u), 0) AS v FROM V WHERE u < 0", lambda t: b1.reduce(Vector(t.u.df.where("v < 0"), t.u.n, dense=False)))
query("nrm1", f"WITH {V} SELECT sum(abs(u - 3 * w)) AS v FROM V", lambda t: b1.nrm1(b1.axpy(3, t.w, t.u, minus=True)))
query("nrm2", f"WITH {V} SELECT sqrt(sum(u * u)) AS v FROM V", lambda t: b1.nrm2(t.u))
query("dot", f"WITH {V} SELECT sum(u * w) AS v FROM V", lambda t: b1.dot(t.u, t.w))
query("nnz_dense", f"WITH {V} SELECT count(*) AS nnz FROM V WHERE w <> 0", lambda t: b1.nnz(t.w))
query("accurate_sum", "SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(30, 6))) AS DOUBLE), 2) AS v FROM lineitem", lambda t: accurate_sums(t.table("lineitem"), [], F.col("l_extendedprice")).select(F.round("v", 2).alias("v")))

# runs, scans, sorts
query("reduce_by_key", "SELECT l_orderkey AS key, sum(l_quantity) AS v FROM lineitem GROUP BY 1", lambda t: pr.reduce_by_key(t.table("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("v")), ["key"]))


def runs(t: Tables) -> DataFrame:
    """Line items numbered by order; keys repeat in runs."""
    own = t.table("lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").alias("v"))
    place = F.row_number().over(pr.Window.partitionBy("key").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) - 1
    offsets = pr.scan(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sum", False, None, "key", "n", name="before").select("key", "before")
    return own.withColumn("place", place).join(offsets, "key").select((F.col("before") + F.col("place")).alias("i"), "key", "v")


query("key_change_flags", f"WITH {RUNS} SELECT i, key, CASE WHEN key <> lag(key) OVER (ORDER BY i) THEN 1 ELSE 0 END AS flag FROM K", lambda t: pr.key_change_flags(runs(t), block=1000).select("i", "key", "flag"))
query("run_index", f"WITH {RUNS} SELECT i, dense_rank() OVER (ORDER BY key) - 1 AS run FROM K", lambda t: pr.run_index(runs(t), block=1000).select("i", "run"))
query("last_of_run", f"WITH {RUNS} SELECT max(i) AS i, key FROM K GROUP BY key", lambda t: pr.last_of_run(runs(t), block=1000).select("i", "key"))
query("scan_by_key", f"WITH {RUNS} SELECT i, sum(v) OVER (PARTITION BY key ORDER BY i) AS v FROM K", lambda t: pr.scan(runs(t), keys=["key"], block=1000).select("i", "v"))
for _op in ("sum", "min", "max"):
    query(f"inclusive_scan_{_op}", f"WITH {V} SELECT i, {_op}(w) OVER (ORDER BY i) AS v FROM V", lambda t, o=_op: pr.scan(t.w.df, o))
query("exclusive_scan", f"WITH {V} SELECT i, coalesce(sum(u) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v FROM V", lambda t: pr.scan(t.u.df, "sum", inclusive=False))
query("two_level_scan", f"WITH {V} SELECT i, sum(u) OVER (ORDER BY i) AS v FROM V", lambda t: pr.scan(t.u.df, "sum", block=128))
query("sort_coo", f"WITH {A} SELECT i, j, v, row_number() OVER (ORDER BY i, j) - 1 AS pos FROM A", lambda t: pr.sort_by_key(t.A.df, "i", "j", ordered=False))
query("sort_by_key_asc", "SELECT p_size AS key, p_partkey AS i, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS pos FROM part", lambda t: pr.sort_by_key(t.table("part").select(F.col("p_size").alias("key"), F.col("p_partkey").alias("i")), "key", "i", ordered=False))
query("sort_by_key_desc", "SELECT p_size AS key, p_partkey AS i, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS pos FROM part", lambda t: pr.sort_by_key(t.table("part").select(F.col("p_size").alias("key"), F.col("p_partkey").alias("i")), "key", "i", descending=True, ordered=False))

# conversions
POINTER = f"WITH {A}, R AS (SELECT Y.i, coalesce(n, 0) AS nnz FROM (SELECT CAST(o_orderkey AS BIGINT) AS i FROM orders) Y LEFT JOIN (SELECT i, count(*) AS n FROM A GROUP BY 1) USING (i))"
query("csr_row_pointer", f"{POINTER} SELECT i, CAST(sum(nnz) OVER (ORDER BY i) - nnz AS BIGINT) AS off, nnz FROM R", lambda t: cv.row_pointer(t.A).select("i", "off", "nnz"))
query("coo2csr", f"{POINTER}, L AS (SELECT i, CAST(array_to_string(list(j ORDER BY j), ',') AS VARCHAR) AS cols, sum(v) AS total FROM A GROUP BY 1) SELECT R.i, CAST(sum(nnz) OVER (ORDER BY R.i) - nnz AS BIGINT) AS off, nnz, coalesce(cols, '') AS cols, coalesce(total, 0) AS total FROM R LEFT JOIN L USING (i)", lambda t: cv.coo2csr(t.A).df.select("i", "off", "nnz", F.concat_ws(",", F.transform("cols", lambda c: c.cast("string"))).alias("cols"), F.aggregate("vals", F.lit(0.0), lambda s, e: s + e).alias("total")))
query("csr2coo", f"WITH {A} SELECT * FROM A", lambda t: cv.csr2coo(cv.coo2csr(t.A)).df)
CELLS = "E AS (SELECT CAST(vec_id AS BIGINT) AS i, unnest(generate_series(0, 63)) AS j, unnest(embedding) AS v FROM embeddings)"


def embedded(t: Tables) -> DenseMatrix:
    """The embeddings, a row each."""
    return DenseMatrix(t.table("embeddings").select(F.col("vec_id").cast("bigint").alias("i"), F.col("embedding").cast("array<double>").alias("vals")), t.rows("embeddings"), 64)


query("csr2dense", f"WITH {CELLS} SELECT i, j, CAST(v AS DOUBLE) AS v FROM E", lambda t: cv.csr2dense(cv.dense2csr(embedded(t))).df.select("i", F.posexplode("vals").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), "v"))
query("dense2coo", f"WITH {CELLS} SELECT i, j, CAST(v AS DOUBLE) AS v FROM E WHERE v <> 0", lambda t: cv.dense2coo(embedded(t)).df)
query("dense2csr", "SELECT CAST(p_partkey AS BIGINT) AS i, CAST((p_size <> 0)::INT + (p_partkey % 11 <> 0)::INT + 1 AS BIGINT) AS nnz, CAST(p_size + p_partkey % 11 + 1 AS DOUBLE) AS total FROM part", lambda t: cv.dense2csr(t.B).df.select("i", "nnz", F.aggregate("vals", F.lit(0.0), lambda s, e: s + e).alias("total")))
query("dense_embeddings_nnz", "SELECT CAST(vec_id AS BIGINT) AS i, CAST(len(list_filter(embedding, lambda e: e <> 0)) AS BIGINT) AS nnz FROM embeddings", lambda t: cv.dense2csr(DenseMatrix(t.table("embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("vals")), t.rows("embeddings"), 64)).df.select("i", "nnz"))

# products
query("csrmv", f"WITH {A}, {V}, {Y}, {AX} SELECT Y.i, 2 * coalesce(s, 0) + 3 * y AS v FROM Y LEFT JOIN AX USING (i)", lambda t: b2.csrmv(2, t.A, t.u, 3, t.y).df)
query("csrmv_beta0", f"WITH {A}, {V}, {Y}, {AX} SELECT Y.i, coalesce(s, 0) AS v FROM Y LEFT JOIN AX USING (i)", lambda t: b2.csrmv(1, t.A, t.u).df)
query("csrmv_alpha0", f"WITH {Y} SELECT i, 3 * y AS v FROM Y", lambda t: b2.csrmv(0, t.A, t.u, 3, t.y).df)
query("csrmv_packed", ORACLES["csrmv_beta0"], lambda t: b2.csrmv(1, cv.coo2csr(t.A), t.u).df)
query("csrmv_shuffled", ORACLES["csrmv_beta0"], lambda t: b2.csrmv(1, t.A, t.u, conf=EngineConf(t.spark, broadcast_bytes=0)).df)
query("csrmv_extended", ORACLES["csrmv_beta0"], lambda t: b2.csrmv(1, t.A, t.u, conf=EngineConf(t.spark, extended_precision=True)).df)
query("csrmv_adaptive", ORACLES["csrmv_beta0"], lambda t: b2.csrmv_adaptive(1, cv.block_rows(t.A), t.u).df)
LONG = "SELECT CAST(l_linenumber AS BIGINT) - 1 AS i, 2 * sum(l_quantity * p_size) + 3e0 * l_linenumber AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linenumber"


def line_numbers(t: Tables) -> tuple[CooMatrix, Vector]:
    """A matrix with few rows, of a share of all entries each, and a vector with a value for each row."""
    m = t.table("lineitem").agg(F.max("l_linenumber")).first()[0]
    own = t.table("lineitem").select((F.col("l_linenumber") - 1).cast("bigint").alias("i"), F.col("l_partkey").cast("bigint").alias("j"), F.col("l_quantity").cast("double").alias("v"))
    return CooMatrix(own.groupBy("i", "j").agg(F.sum("v").alias("v")), m, t.rows("part")), Vector.of(t.spark.range(m), "id", F.col("id") + 1, m)


def long_rows(t: Tables) -> DataFrame:
    a, y = line_numbers(t)
    return b2.csrmv_adaptive(2, cv.block_rows(a), t.u, 3, y).df


query("csrmv_adaptive_long", LONG, long_rows)
query("coomv", ORACLES["csrmv"], lambda t: b2.coomv(2, t.A, t.u, 3, t.y).df)
MM = f"WITH {A}, P AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS b0, CAST(p_partkey % 11 AS DOUBLE) AS b1 FROM part), O AS (SELECT CAST(o_orderkey AS BIGINT) AS i, o_custkey AS k FROM orders), S AS (SELECT A.i, sum(v * b0) AS c0, sum(v * b1) AS c1, sum(v) AS c2 FROM A JOIN P ON A.j = P.i GROUP BY 1)"


def cells(m: DenseMatrix) -> DataFrame:
    return m.df.select("i", *(F.get("vals", F.lit(k)).alias(f"c{k}") for k in range(m.n)))


query("csrmm", f"{MM} SELECT O.i, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2 FROM O LEFT JOIN S USING (i)", lambda t: cells(b2.csrmm(1, t.A, t.B)))
query("csrmm_beta", f"{MM} SELECT O.i, 2 * coalesce(c0, 0) + 3e0 * (k % 7) AS c0, 2 * coalesce(c1, 0) + 3e0 * (k % 5) AS c1, 2 * coalesce(c2, 0) + 3e0 * (k % 3) AS c2 FROM O LEFT JOIN S USING (i)", lambda t: cells(b2.csrmm(2, t.A, t.B, 3, t.C)))


def tiled(t: Tables, copies: int) -> DataFrame:
    """(i, k, c): suppliers x vectors times vectors x components, the components ``copies`` times over, times 1, 2, and so on."""
    n = t.rows("embeddings")
    own = t.table("lineitem").select(F.col("l_suppkey").cast("bigint").alias("i"), (F.col("l_partkey") % n).cast("bigint").alias("j"), F.col("l_quantity").alias("v"))
    times = lambda c: F.transform("embedding", lambda x: F.floor(x * 256.0) * F.lit(float(c)))
    whole = F.flatten(F.array(*(times(c + 1) for c in range(copies))))
    b = DenseMatrix(t.table("embeddings").select(F.col("vec_id").cast("bigint").alias("i"), whole.alias("vals")), n, 64 * copies)
    out = b2.csrmm(1, CooMatrix.from_entries(own, "i", "j", "v", t.rows("supplier"), n), b)
    return out.df.select("i", F.posexplode("vals").alias("k", "c")).select("i", F.col("k").cast("bigint").alias("k"), "c")


def tiled_sql(copies: int) -> str:
    return f"""WITH W AS (SELECT CAST(l_suppkey AS BIGINT) AS i, l_partkey % (SELECT count(*) FROM embeddings) AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
        E AS (SELECT vec_id AS j, unnest(generate_series(0, 63)) AS k, floor(CAST(unnest(embedding) AS DOUBLE) * 256) AS b FROM embeddings),
        S AS (SELECT i, k, sum(v * b) AS c FROM W JOIN E USING (j) GROUP BY 1, 2),
        G AS (SELECT s_suppkey AS i, unnest(generate_series(0, 63)) AS k FROM supplier),
        C AS (SELECT G.i, G.k, coalesce(c, 0) AS c, unnest(generate_series(0, {copies - 1})) AS m FROM G LEFT JOIN S USING (i, k))
        SELECT CAST(i AS BIGINT) AS i, CAST(k + 64 * m AS BIGINT) AS k, c * (m + 1) AS c FROM C"""


for _copies in (1, 4):
    query(f"csrmm_wide_{64 * _copies}", tiled_sql(_copies), lambda t, c=_copies: tiled(t, c))
query("spgemm_ata", f"WITH {A} SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM A a JOIN A b USING (i) GROUP BY 1, 2", lambda t: b2.spgemm(t.A.transpose(), t.A).df)
query("spgemm_aq", f"WITH {A}, {Q} SELECT A.i, Q.j, sum(A.v * Q.v) AS v FROM A JOIN Q ON A.j = Q.i GROUP BY 1, 2", lambda t: b2.spgemm(t.A, t.Q).df)
query("spgemm_balanced", ORACLES["spgemm_aq"], lambda t: b2.spgemm_balanced(t.A, t.Q).df)
query("spgemm_balanced_hot", "WITH L AS (SELECT l_linenumber AS k, l_suppkey AS s, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT CAST(a.s AS BIGINT) AS i, CAST(b.s AS BIGINT) AS j, sum(a.v * b.v) AS v FROM L a JOIN L b USING (k) GROUP BY 1, 2", lambda t: b2.spgemm_balanced(*(lambda a: (a.transpose(), a))(t.matrix("l_linenumber", "l_suppkey", "lineitem", "supplier"))).df)
BOUND = f"WITH {A}, {Q}, L AS (SELECT i, count(*) AS n FROM Q GROUP BY 1), U AS (SELECT A.i, CAST(sum(n) AS BIGINT) AS bound FROM A JOIN L ON A.j = L.i GROUP BY 1)"
query("spgemm_upper_bound", f"{BOUND} SELECT i, bound FROM U", lambda t: b2.spgemm_upper_bound(t.A, t.Q))
query("spgemm_flops", f"{BOUND} SELECT CAST(2 * sum(bound) AS BIGINT) AS flops FROM U", lambda t: b2.spgemm_flops(t.A, t.Q))
query("spgemm_bins", f"{BOUND}, H AS (SELECT CAST(CASE WHEN coalesce(bound, 0) < 122 THEN coalesce(bound, 0) WHEN bound <= 128 THEN 122 WHEN bound <= 256 THEN 123 WHEN bound <= 512 THEN 124 ELSE 127 END AS BIGINT) AS bin, coalesce(bound, 0) AS bound FROM (SELECT o_orderkey AS i FROM orders) LEFT JOIN U USING (i)) SELECT bin, count(*) AS rows, CAST(sum(bound) AS BIGINT) AS products, CAST(sum(count(*)) OVER (ORDER BY bin) - count(*) AS BIGINT) AS first FROM H GROUP BY 1", lambda t: b2.spgemm_bins(t.A, t.Q))
query("matrix_add", f"WITH {A} SELECT i, j, 2 * v AS v FROM A", lambda t: b2.matrix_add(t.A, t.A).df)
query("matrix_add_stored", ORACLES["matrix_add"], lambda t: b2.matrix_add(cv.store(t.A), cv.store(t.A)).df)
query("transpose", f"WITH {A} SELECT j AS i, i AS j, v FROM A", lambda t: t.A.transpose().df)
query("symmetrize", f"WITH {A}, S AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM A a JOIN A b USING (i) GROUP BY 1, 2) SELECT i, j, v FROM S UNION ALL SELECT j, i, v FROM S WHERE i <> j", lambda t: b2.spgemm(t.A.transpose(), t.A).symmetrize().df)


def once(t: Tables) -> CooMatrix:
    """A, added up once and written, for plans that read it twice."""
    return CooMatrix(cut(t.A.df, "a"), t.rows("orders"), t.rows("part"))


def gram(t: Tables) -> CooMatrix:
    a = once(t)
    return b2.spgemm(a.transpose(), a)


def gram_diagonal(t: Tables, inverse: bool = False) -> DataFrame:
    a = once(t)
    return b2.spgemm_diagonal(a.transpose(), a, inverse).df


GRAM = f"WITH {A}, D AS (SELECT j AS i, sum(v * v) AS v FROM A GROUP BY 1)"
query("diagonal", f"{GRAM} SELECT i, v FROM D", gram_diagonal)
query("inv_diagonal", f"{GRAM} SELECT i, 1 / v AS v FROM D", lambda t: gram_diagonal(t, inverse=True))
query("row_stats", f"WITH {A}, R AS (SELECT count(*) AS m FROM orders), N AS (SELECT i, count(*) AS n FROM A GROUP BY 1) SELECT m AS rows, CAST(sum(n) AS BIGINT) AS nnz, m - count(*) AS empty_rows, max(n) AS max_nnz, CAST(sum(n) // m AS BIGINT) AS nnz_per_row, round(sum(n) / m, 6) AS mean_nnz, round(sqrt(sum(n * n) / m - (sum(n) / m) * (sum(n) / m)), 6) AS deviation FROM N, R GROUP BY m", lambda t: cv.row_stats(t.A).withColumns({k: F.round(k, 6) for k in ("mean_nnz", "deviation")}))
query("row_blocks", f"{POINTER}, B AS (SELECT i, nnz, sum(CASE WHEN nnz <= 1024 THEN nnz ELSE 0 END) OVER (ORDER BY i) - CASE WHEN nnz <= 1024 THEN nnz ELSE 0 END AS base FROM R) SELECT i, nnz, CAST(CASE WHEN nnz > 1024 THEN -1 ELSE base // 1024 END AS BIGINT) AS block, CAST(CASE WHEN nnz > 1024 THEN ceil(nnz / 3072) ELSE 1 END AS BIGINT) AS chunks FROM R JOIN B USING (i, nnz)", lambda t: cv.row_blocks(t.A))
LINES = "WITH G AS (SELECT CAST(l_linenumber AS BIGINT) - 1 AS i, count(*) AS nnz FROM lineitem GROUP BY 1), S AS (SELECT *, CASE WHEN nnz <= 1024 THEN nnz ELSE 0 END AS short FROM G) SELECT i, nnz, CAST(CASE WHEN nnz > 1024 THEN -1 ELSE (sum(short) OVER (ORDER BY i) - short) // 1024 END AS BIGINT) AS block, CAST(CASE WHEN nnz > 1024 THEN ceil(nnz / 3072) ELSE 1 END AS BIGINT) AS chunks FROM S"
query("row_blocks_long", LINES, lambda t: cv.row_blocks(CooMatrix(t.table("lineitem").select((F.col("l_linenumber") - 1).cast("bigint").alias("i"), F.monotonically_increasing_id().alias("j"), F.col("l_quantity").alias("v")), t.table("lineitem").agg(F.max("l_linenumber")).first()[0], 1 << 62)))
query("csrmv_float", f"WITH {A}, {V}, {AX} SELECT O.i, CAST(coalesce(s, 0) AS FLOAT) AS v FROM (SELECT CAST(o_orderkey AS BIGINT) AS i FROM orders) O LEFT JOIN AX USING (i)", lambda t: b2.csrmv(1, t.matrix("l_orderkey", "l_partkey", "orders", "part", "float"), Vector.of(t.table("part"), "p_partkey", "p_size", t.rows("part"), "float")).df)
query("spgemm_float", f"WITH {A}, {Q} SELECT A.i, Q.j, CAST(sum(A.v * Q.v) AS FLOAT) AS v FROM A JOIN Q ON A.j = Q.i GROUP BY 1, 2", lambda t: b2.spgemm(t.matrix("l_orderkey", "l_partkey", "orders", "part", "float"), t.matrix("l_partkey", "l_suppkey", "part", "supplier", "float")).df)
query("sort_by_double_key", "SELECT l_extendedprice AS key, row_number() OVER (ORDER BY l_extendedprice, l_orderkey * 100 + l_linenumber) - 1 AS pos FROM lineitem", lambda t: pr.sort_by_key(t.table("lineitem").select(F.col("l_extendedprice").alias("key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("i")), "key", "i", ordered=False).drop("i"))

# solvers
TIGHT = SolverControl(rel_tol=1e-12, abs_tol=0.0, max_iters=60)


def solved(t: Tables, out: Vector) -> DataFrame:
    return out.df.select("i", F.round(F.col("v") + 0.0, 6).alias("v"))


def ones(t: Tables) -> Vector:
    return Vector.of(t.table("nation"), "n_nationkey", F.lit(1.0), t.rows("nation"))


def summary(t: Tables, result) -> DataFrame:
    return t.spark.range(1).select(F.lit(result.iterations).cast("bigint").alias("iterations"), F.lit(bool(result.converged)).alias("converged"))


CURVE = "SELECT CAST(n_nationkey AS BIGINT) AS i, round((n_nationkey + 1) * (25 - n_nationkey) / 2e0, 6) AS v FROM nation"
query("cg_poisson", CURVE, lambda t: solved(t, cg(t.poisson(), ones(t), control=TIGHT).x))
query("cg_jacobi", CURVE, lambda t: solved(t, cg(t.poisson(), ones(t), control=SolverControl("diagonal", 60, 1e-12, 0.0)).x))


def convection(t: Tables) -> tuple[CooMatrix, Vector]:
    a = t.poisson(-1.5, 4.0, -1.0)
    x = Vector.of(t.table("nation"), "n_nationkey", F.col("n_nationkey") % 7, t.rows("nation"))
    return a, b2.csrmv(1, a, x)


MOD7 = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey % 7 AS DOUBLE) AS v FROM nation"
query("bicgstab_convdiff", MOD7, lambda t: solved(t, bicgstab(*convection(t), control=TIGHT).x))
query("bicgstab_jacobi", MOD7, lambda t: solved(t, bicgstab(*convection(t), control=SolverControl("diagonal", 60, 1e-12, 0.0)).x))
STRIPES = "SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_partkey % 7 AS DOUBLE) AS v FROM part"


def stripes(t: Tables, below: float) -> tuple[CooMatrix, Vector]:
    """A tridiagonal system with a row for every part."""
    a = t.poisson(below, 4.0, -1.0, "part", "p_partkey")
    return a, b2.csrmv(1, a, Vector.of(t.table("part"), "p_partkey", F.col("p_partkey") % 7, t.rows("part")))


query("cg_parts", STRIPES, lambda t: solved(t, cg(*stripes(t, -1.0), control=TIGHT).x))
query("bicgstab_parts", STRIPES, lambda t: solved(t, bicgstab(*stripes(t, -1.5), control=TIGHT).x))
query("solver_zero_rhs", "SELECT CAST(0 AS BIGINT) AS iterations, true AS converged", lambda t: summary(t, cg(t.poisson(), Vector.constant(t.spark, t.rows("nation"), 0.0))))
query("solver_iteration_cap", "SELECT CAST(3 AS BIGINT) AS iterations, false AS converged", lambda t: summary(t, cg(t.poisson(), ones(t), control=SolverControl(max_iters=3, rel_tol=1e-12, abs_tol=0.0))))
query("solver_diagonal_system", "SELECT CAST(p_partkey AS BIGINT) AS i, round((p_partkey % 11) / CAST(p_size AS DOUBLE), 9) AS v FROM part", lambda t: cg(CooMatrix(t.u.df.select("i", F.col("i").alias("j"), "v"), t.u.n, t.u.n), t.w, control=SolverControl("diagonal", 5, 1e-12, 0.0)).x.df.select("i", F.round("v", 9).alias("v")))

# Matrix Market files: matrices of the tables written to the shared folder, where driver and executors see them, and read
def saved(t: Tables, a: CooMatrix, name: str = "a", folder: str | None = None, **options) -> str:
    path = f"{folder or new_path(t.spark, 'mtx')}/{name}.mtx"
    mtx.save(a, path, **options)
    return path


def halved(a: CooMatrix) -> CooMatrix:
    """The matrix with zeros for its even values."""
    return CooMatrix(a.df.withColumn("v", F.when(F.col("v") % 2 == 0, 0.0).otherwise(F.col("v"))), a.m, a.n)


GRAM_ALL = f"WITH {A}, S AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM A a JOIN A b USING (i) GROUP BY 1, 2)"
query("mtx_coo_general", f"WITH {A} SELECT * FROM A", lambda t: mtx.read_coo(t.spark, saved(t, t.A)).df)
query("mtx_coo_symmetric", f"{GRAM_ALL} SELECT * FROM S", lambda t: mtx.read_coo(t.spark, saved(t, gram(t), symmetry="symmetric")).df)
query("mtx_coo_integer", f"WITH {A} SELECT * FROM A", lambda t: mtx.read_coo(t.spark, saved(t, t.A, field="integer")).df)
query("mtx_coo_pattern", f"WITH {A} SELECT i, j, 1e0 AS v FROM A", lambda t: mtx.read_coo(t.spark, saved(t, t.A, field="pattern")).df)
query("mtx_coo_skew", f"{GRAM_ALL} SELECT i, j, CASE WHEN i > j THEN v ELSE -v END AS v FROM S WHERE i <> j", lambda t: mtx.read_coo(t.spark, saved(t, gram(t), symmetry="skew-symmetric")).df)
query("mtx_coo_without_zeros", f"WITH {A} SELECT * FROM A WHERE v % 2 <> 0", lambda t: mtx.read_coo(t.spark, saved(t, halved(t.A)), zeros=False).df)
query("mtx_filtered", f"WITH {A} SELECT * FROM A WHERE i < 500 AND j >= 20 AND v <= 30", lambda t: mtx.read_coo(t.spark, saved(t, t.A, ranged=True, file_entries=1 << 12)).df.where("i < 500 AND j >= 20 AND v <= 30"))
query("mtx_csr", f"{POINTER} SELECT i, CAST(sum(nnz) OVER (ORDER BY i) - nnz AS BIGINT) AS off, nnz FROM R", lambda t: mtx.read_csr(t.spark, saved(t, t.A)).df.select("i", "off", "nnz"))


def header(t: Tables) -> DataFrame:
    head = next(iter(mtx.list_matrices(saved(t, gram(t), symmetry="symmetric")).values()))
    return t.spark.range(1).select(*(F.lit(getattr(head, k)).cast(c).alias(k) for k, c in (("m", "bigint"), ("n", "bigint"), ("nnz", "bigint"), ("symmetry", "string"))))


query("mtx_header", f"{GRAM_ALL} SELECT (SELECT count(*) FROM part) AS m, (SELECT count(*) FROM part) AS n, CAST(2 * count(*) AS BIGINT) AS nnz, 'symmetric' AS symmetry FROM S WHERE i >= j", header)


def folder_heads(t: Tables) -> DataFrame:
    """Every matrix of a folder with its shape, bound and the entries it really has."""
    path = new_path(t.spark, "mtx")
    for name, a in (("a", t.A), ("q", t.Q)):
        saved(t, a, name, path)
    heads = mtx.list_matrices(path)
    rows = [a.df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(p.rsplit("/", 1)[-1]).alias("name"), F.lit(a.m).cast("bigint").alias("m"), F.lit(a.n).cast("bigint").alias("n"), F.lit(heads[p].nnz).cast("bigint").alias("nnz"), "entries") for p, a in mtx.read_folder(t.spark, path).items()]
    return reduce(DataFrame.unionByName, rows)


query("mtx_folder", f"WITH {A}, {Q} SELECT 'a.mtx' AS name, (SELECT count(*) FROM orders) AS m, (SELECT count(*) FROM part) AS n, count(*) AS nnz, count(*) AS entries FROM A UNION ALL SELECT 'q.mtx', (SELECT count(*) FROM part), (SELECT count(*) FROM supplier), count(*), count(*) FROM Q", folder_heads)


def rejects(t: Tables) -> DataFrame:
    """The errors of files and arguments that the engine refuses before any job runs."""
    body, names = "3 3 1\n1 1 1\n", {"array.mtx": "matrix array real general", "complex.mtx": "matrix coordinate complex general", "short.mtx": "matrix coordinate real", "name.txt": "matrix coordinate real general"}
    folder, tried = new_path(t.spark, "mtx"), {}
    for name, banner in names.items():
        write_text(t.spark, f"{folder}/{name}", f"%%MatrixMarket {banner}\n{body}")
        tried[name] = lambda n=name: mtx.read_header(f"{folder}/{n}")
    tried |= {"missing.mtx": lambda: mtx.read_header(f"{folder}/missing.mtx"), "shapes": lambda: b2.csrmv(1, t.A, t.y), "inner": lambda: b2.spgemm(t.A, t.A), "system": lambda: cg(t.A, t.y), "scan": lambda: pr.scan(t.u.df, "median"), "control": lambda: SolverControl("unheard of")}
    found = []
    for name, attempt in tried.items():
        try:
            attempt()
        except EngineError as e:
            found.append((name, type(e).__name__))
    return t.spark.createDataFrame(found, "name string, error string")


REJECTED = {"array.mtx": "InvalidFileFormat", "complex.mtx": "InvalidFileFormat", "short.mtx": "InvalidFileFormat", "name.txt": "InvalidFile", "missing.mtx": "InvalidFile", "shapes": "InvalidSize", "inner": "InvalidSize", "system": "InvalidSystemSize", "scan": "InvalidValue", "control": "InvalidValue"}
query("rejects", f"SELECT a AS name, b AS error FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in REJECTED.items())}) AS t(a, b)", rejects)
query("csrmv_eager", ORACLES["csrmv_beta0"], lambda t: b2.csrmv(1, t.A, t.u, conf=EngineConf(t.spark, eager=True)).df)
query("csrmv_checked", ORACLES["csrmv_beta0"], lambda t: b2.csrmv(1, t.A.checked(), t.u).df)


def submitted(t: Tables) -> DataFrame:
    """A u and A w side by side, each computed and written by jobs of its own."""
    conf = EngineConf(t.spark, eager=True)
    with Queue(t.spark) as queue:
        works = [queue.submit(lambda x=x: b2.csrmv(1, t.A, x, conf=conf)) for x in (t.u, t.w)]
        u, w = wait_all(*works)
    return u.df.withColumnRenamed("v", "u").join(w.df.withColumnRenamed("v", "w"), "i")


query("csrmv_submitted", f"WITH {A}, {V}, S AS (SELECT A.i, sum(A.v * V.u) AS u, sum(A.v * V.w) AS w FROM A JOIN V ON A.j = V.i GROUP BY 1) SELECT O.i, coalesce(u, 0) AS u, coalesce(w, 0) AS w FROM (SELECT CAST(o_orderkey AS BIGINT) AS i FROM orders) O LEFT JOIN S USING (i)", submitted)
query("engine_version", "SELECT CAST(0 AS BIGINT) AS major, CAST(2 AS BIGINT) AS minor, CAST(0 AS BIGINT) AS patch, CAST(0 AS BIGINT) AS tweak", lambda t: t.spark.range(1).select(*(F.lit(v).cast("bigint").alias(k) for k, v in zip(("major", "minor", "patch", "tweak"), __version__, strict=True))))


def events(t: Tables) -> DataFrame:
    # a file stream wants a folder: the one that holds the tables, narrowed to this one
    return t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


def finished(t: Tables, matrix: DataFrame) -> DataFrame:
    """What the stream leaves when it has read all there is."""
    path = new_path(t.spark, "stream")
    start(matrix, f"{path}/table", f"{path}/state").awaitTermination()
    return latest(t.spark, f"{path}/table")


query("stream_accumulate", "SELECT CAST(user_id AS BIGINT) AS i, CAST(user_id AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1", lambda t: finished(t, accumulate(events(t), "user_id", "user_id", F.lit(1))))
def merged_stream(t: Tables) -> DataFrame:
    path = new_path(t.spark, "stream")
    start_merged(accumulate(events(t), "user_id", "user_id", F.lit(1)), f"{path}/table", f"{path}/state").awaitTermination()
    return merged(t.spark, f"{path}/table")


def final_windows(t: Tables) -> DataFrame:
    """Days that ended an hour before the last event."""
    path, seconds = new_path(t.spark, "stream"), F.timestamp_seconds(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    own = events(t).select(seconds.alias("ts"), (F.col("user_id") % 10).alias("k"))
    start_final(accumulate_windows(own, "ts", "1 day", "1 hour", "k", "k", F.lit(1)), f"{path}/table", f"{path}/state").awaitTermination()
    return finals(t.spark, f"{path}/table").withColumn("begin", F.col("begin").cast("long"))


query("stream_merged", ORACLES["stream_accumulate"], merged_stream)
DAYS = "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS begin, CAST(user_id % 10 AS BIGINT) AS i, CAST(user_id % 10 AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2"
query("stream_windows_final", f"SELECT * FROM ({DAYS}) WHERE begin + 86400 <= (SELECT floor(epoch(max(ts))) - 3600 FROM events)", final_windows)
query("stream_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS begin, CAST(user_id % 10 AS BIGINT) AS i, CAST(user_id % 10 AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2", lambda t: finished(t, accumulate_windows(events(t).select(F.timestamp_seconds(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")).alias("ts"), (F.col("user_id") % 10).alias("k")), "ts", "1 day", "1 hour", "k", "k", F.lit(1))).withColumn("begin", F.col("begin").cast("timestamp").cast("long")))
