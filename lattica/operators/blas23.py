"""Matrix products as joins and aggregations.

The vector side of a product is broadcast only while its length keeps it under the session's bound; beyond it both
sides shuffle on the shared index and adaptive execution splits hot columns.  Long rows are combined map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.conf import EngineConf, conf_of
from lattica.errors import InvalidSize
from lattica.functions.exprs import accurate_sums
from lattica.operators.blas1 import scale
from lattica.operators.cells import product
from lattica.types import BlockedMatrix, CooMatrix, CsrMatrix, DenseMatrix, Vector

Matrix = CooMatrix | CsrMatrix | BlockedMatrix

#: Columns of a dense operand, or of a tile of a wider one, whose products are kept as one aggregate each.
WIDE = 64
PAIR_BYTES = 16
#: Bounds below the first number are bins of their own; then the largest bound of a bin, and its number; then the last bin.
BIN_TOPS = ((122, 122), (128, 122), (256, 123), (512, 124))
LAST_BIN = 127
#: Shares of a task's products from which an inner index is cut into cells.
SHARE = 16


def entries(a: Matrix) -> DataFrame:
    """(i, j, v) of a matrix in any sparse form."""
    if isinstance(a, CooMatrix):
        return a.df
    if isinstance(a, BlockedMatrix):
        return a.df.select("i", "j", "v")
    return a.df.select("i", F.inline(F.arrays_zip("cols", "vals"))).select("i", F.col("cols").alias("j"), F.col("vals").alias("v"))


def _small(df: DataFrame, rows: int, conf: EngineConf, width: int = 1) -> DataFrame:
    return F.broadcast(df) if rows * (8 + 8 * width) <= conf.broadcast_bytes else df


def spmv(a: Matrix, x: Vector, conf: EngineConf | None = None) -> DataFrame:
    """(i, v) of A x, without the rows that have no entry.

    Over row blocks each block and chunk adds up where it lies: with a vector that is broadcast, rows of blocks are
    done then, and only the chunks of long rows meet in a second, small aggregation.
    """
    if a.n != x.n:
        raise InvalidSize(f"matrix of {a.n} columns, vector of {x.n}")
    conf = conf_of(x.df, conf)
    blocked = isinstance(a, BlockedMatrix) and not conf.extended_precision
    joined = (a.df if blocked else entries(a)).join(_small(x.df.select(F.col("i").alias("j"), F.col("v").alias("_x")), x.n, conf), "j")
    product = F.col("v") * F.col("_x")
    single = _single(entries(a), x.df)
    if conf.extended_precision:
        out = accurate_sums(joined, ["i"], product)
    elif blocked:
        sums = joined.groupBy("block", "chunk", "i").agg(F.sum(product).alias("v"))
        long = sums.where("block < 0").groupBy("i").agg(F.sum("v").alias("v"))
        out = sums.where("block >= 0").select("i", "v").unionByName(long)
    else:
        out = joined.groupBy("i").agg(F.sum(product).alias("v"))
    return out.withColumn("v", F.col("v").cast("float")) if single else out


def _single(*frames: DataFrame) -> bool:
    """Whether all values are of single precision; sums of such are kept in double and rounded once."""
    return all(dict(f.dtypes).get("v", "float") == "float" and dict(f.dtypes).get("vals", "array<float>") == "array<float>" for f in frames)


def csrmv(alpha: float, a: Matrix, x: Vector, beta: float = 0.0, y: Vector | None = None, conf: EngineConf | None = None) -> Vector:
    """alpha A x + beta y.  With beta = 0 y is not read, with alpha = 0 neither A nor x."""
    if beta != 0 and (y is None or y.n != a.m):
        raise InvalidSize(f"matrix of {a.m} rows, vector of {y.n if y else 'none'}")
    if a.n != x.n:
        raise InvalidSize(f"matrix of {a.n} columns, vector of {x.n}")
    if alpha == 0:
        return scale(beta, y.completed()) if beta else Vector.constant(x.df.sparkSession, a.m, 0.0)
    product = spmv(a, x, conf).select("i", F.col("v").alias("_ax"))
    term, finish = F.lit(float(alpha)) * F.coalesce("_ax", F.lit(0.0)), conf_of(x.df, conf).finish
    kind = "float" if _single(entries(a), x.df) else "double"
    if beta == 0:
        every = x.df.sparkSession.range(a.m).withColumnRenamed("id", "i")
        return Vector(finish(every.join(product, "i", "left").select("i", term.cast(kind).alias("v"))), a.m)
    kind = kind if _single(y.df) else "double"
    out = y.completed().df.join(product, "i", "left").select("i", (term + F.lit(float(beta)) * F.col("v")).cast(kind).alias("v"))
    return Vector(finish(out), a.m)


coomv = csrmv


def csrmv_adaptive(alpha: float, a: BlockedMatrix, x: Vector, beta: float = 0.0, y: Vector | None = None, conf: EngineConf | None = None) -> Vector:
    """``csrmv`` over row blocks; see ``convert.block_rows``."""
    return csrmv(alpha, a, x, beta, y, conf)


def csrmm(alpha: float, a: CooMatrix | CsrMatrix, b: DenseMatrix, beta: float = 0.0, c: DenseMatrix | None = None, conf: EngineConf | None = None) -> DenseMatrix:
    """alpha A B + beta C for dense B and C, by row arrays; wide rows meet A in tiles of ``WIDE`` columns, summed as such."""
    if a.n != b.m or beta != 0 and (c is None or (c.m, c.n) != (a.m, b.n)):
        raise InvalidSize("shapes of A, B and C do not fit")
    conf, n = conf_of(b.df, conf), b.n
    zeros = F.array_repeat(F.lit(0.0), n)
    every = b.df.sparkSession.range(a.m).withColumnRenamed("id", "i")
    if alpha == 0:
        product = every.select("i", F.lit(None).cast("array<double>").alias("_ab"))
    else:
        if n <= WIDE:
            joined = entries(a).join(_small(b.df.select(F.col("i").alias("j"), "vals"), b.m, conf, n), "j")
            sums = [F.sum(F.col("v") * F.get("vals", F.lit(k))).alias(f"_{k}") for k in range(n)]
            product = joined.groupBy("i").agg(*sums).select("i", F.array(*(f"_{k}" for k in range(n))).alias("_ab"))
        else:
            tiles = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // WIDE)), lambda t: F.slice("vals", t * WIDE + 1, WIDE))
            joined = entries(a).join(_small(b.df.select(F.col("i").alias("j"), F.posexplode(tiles).alias("tile", "part")), b.m, conf, n), "j")
            per = joined.groupBy("i", "tile").agg(*(F.sum(F.col("v") * F.get("part", F.lit(k))).alias(f"_{k}") for k in range(WIDE)))
            per = per.select("i", F.struct("tile", F.array(*(f"_{k}" for k in range(WIDE))).alias("part")).alias("t"))
            product = per.groupBy("i").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda e: e.part)), 1, n).alias("_ab"))
    base = every if beta == 0 else c.df
    term = F.transform(F.coalesce("_ab", zeros), lambda e: F.lit(float(alpha)) * e)
    out = base.join(product, "i", "left")
    value = term if beta == 0 else F.zip_with(term, F.col("vals"), lambda p, q: p + F.lit(float(beta)) * q)
    single = _single(entries(a), b.df, *([c.df] if beta else []))
    return DenseMatrix(conf.finish(out.select("i", value.cast(f"array<{'float' if single else 'double'}>").alias("vals"))), a.m, n)


def spgemm(a: CooMatrix | CsrMatrix, b: CooMatrix | CsrMatrix, conf: EngineConf | None = None) -> CooMatrix:
    """A B for sparse operands, by ``cells.product``; entries that cancel to zero stay."""
    if a.n != b.m:
        raise InvalidSize(f"inner dimensions {a.n} and {b.m}")
    kind = "float" if _single(entries(a), entries(b)) else "double"
    conf = conf_of(entries(b), conf)
    out = product(entries(a), entries(b), conf)
    return CooMatrix(conf.finish(out.withColumn("v", F.col("v").cast(kind))), a.m, b.n)


def _cells(a: Matrix, b: Matrix, conf: EngineConf) -> DataFrame:
    """(j, sa, sb): into how many parts the entries of a heavy inner index are cut on either side.

    An index is heavy if its products are more than a ``SHARE``-th part of a task's, so there are at most ``SHARE``
    times as many as tasks.
    """
    parts = int(conf.spark.conf.get("spark.sql.shuffle.partitions"))
    of = lambda df, c, name: df.groupBy(F.col(c).alias("j")).agg(F.count(F.lit(1)).cast("double").alias(name))
    products = F.col("na") * F.col("nb")
    lengths = conf.checkpoint(of(entries(a), "j", "na").join(of(entries(b), "i", "nb"), "j"))
    most = (lengths.agg(F.sum(products)).first()[0] or 0.0) / (parts * SHARE)
    heavy = []
    for j, na, nb in lengths.where(products > most).collect() if most else ():  # parts * SHARE rows at most
        side = math.sqrt(most)
        sa, sb = (1, math.ceil(na * nb / most)) if na <= side else (math.ceil(na * nb / most), 1) if nb <= side else (math.ceil(na / side), math.ceil(nb / side))
        heavy.append((j, sa, sb))
    conf.free(lengths)
    return conf.spark.createDataFrame(heavy, "j bigint, sa int, sb int")


def balanced_products(a: Matrix, b: Matrix, conf: EngineConf | None = None) -> DataFrame:
    """(i, j, v): every product of A B, dealt so that no task has many more than others whatever inner index they share.

    The entries of a heavy inner index form a grid: A's are cut by row and B's by column, each part is sent to all cells
    of its row or column of the grid, and a cell's products are bounded.  Other indices are one cell each.
    """
    if a.n != b.m:
        raise InvalidSize(f"inner dimensions {a.n} and {b.m}")
    conf = conf_of(entries(a), conf)
    cells = F.broadcast(_cells(a, b, conf))
    sa, sb = F.coalesce("sa", F.lit(1)), F.coalesce("sb", F.lit(1))
    of = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    each = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), n - 1), cell)).alias("cell")
    left = entries(a).join(cells, "j", "left").select("j", each(sb, lambda q: of("i", sa) * sb + q), "i", "v")
    right = entries(b).select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("_b")).join(cells, "j", "left").select("j", each(sa, lambda p: p * sb + of("k", sb)), "k", "_b")
    return left.join(right, ["j", "cell"]).select("i", F.col("k").alias("j"), (F.col("v") * F.col("_b")).alias("v"))


def spgemm_balanced(a: Matrix, b: Matrix, conf: EngineConf | None = None) -> CooMatrix:
    """A B as ``spgemm`` has it, whose cells bound the work of heavy inner indices; ``balanced_products`` deals single products."""
    return spgemm(a, b, conf)


def spgemm_upper_bound(a: CooMatrix | CsrMatrix, b: CooMatrix | CsrMatrix) -> DataFrame:
    """(i, bound): for each row of A with entries, how many products A B adds up in it."""
    if a.n != b.m:
        raise InvalidSize(f"inner dimensions {a.n} and {b.m}")
    lengths = entries(b).groupBy(F.col("i").alias("j")).agg(F.count(F.lit(1)).alias("_len"))
    return entries(a).join(lengths, "j").groupBy("i").agg(F.sum("_len").alias("bound"))


def spgemm_flops(a: CooMatrix | CsrMatrix, b: CooMatrix | CsrMatrix) -> DataFrame:
    """(flops): two for each product of A B."""
    return spgemm_upper_bound(a, b).agg((2 * F.coalesce(F.sum("bound"), F.lit(0))).alias("flops"))


def spgemm_bins(a: CooMatrix | CsrMatrix, b: CooMatrix | CsrMatrix) -> DataFrame:
    """(bin, rows, products, first): histogram of the rows of A by their bound, and how many rows lie in smaller bins."""
    every = entries(a).sparkSession.range(a.m).withColumnRenamed("id", "i")
    bound = F.coalesce("bound", F.lit(0))
    label = F.when(bound < BIN_TOPS[0][0], bound)
    for top, number in BIN_TOPS[1:]:
        label = label.when(bound <= top, number)
    binned = every.join(spgemm_upper_bound(a, b), "i", "left").select(label.otherwise(LAST_BIN).cast("bigint").alias("bin"), bound.alias("bound"))
    counted = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.sum("bound").alias("products"))
    first = F.coalesce(F.sum("rows").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bin
    return counted.withColumn("first", first)


def matrix_add(a: CooMatrix, b: CooMatrix) -> CooMatrix:
    """A + B; two stored matrices that are bucketed alike meet without an exchange."""
    if (a.m, a.n) != (b.m, b.n):
        raise InvalidSize("shapes differ")
    # Spark 4.1 unions column batches without regard to buckets and still takes the union for bucketed: filters make rows of them
    own, other = (x.df.where("v IS NOT NULL") for x in (a, b))
    return CooMatrix(own.unionAll(other).groupBy("i", "j").agg(F.sum("v").alias("v")), a.m, a.n, a.by if a.by == b.by else None)


def diagonal(a: CooMatrix | CsrMatrix, inverse: bool = False) -> Vector:
    """Entries of the diagonal, or their reciprocals by IEEE rules; what is missing stays out."""
    from lattica.functions.exprs import ieee_div

    own = entries(a).where("i = j").groupBy("i").agg(F.sum("v").alias("v"))
    return Vector(own.select("i", (ieee_div(F.lit(1.0), F.col("v")) if inverse else F.col("v")).alias("v")), min(a.m, a.n), dense=False)


def spgemm_diagonal(a: CooMatrix | CsrMatrix, b: CooMatrix | CsrMatrix, inverse: bool = False) -> Vector:
    """``diagonal`` of A B from the entries that meet on it: no other entry of the product is made."""
    if a.n != b.m:
        raise InvalidSize(f"inner dimensions {a.n} and {b.m}")
    kind = "float" if _single(entries(a), entries(b)) else "double"
    double = lambda c: F.col(c).cast("double")
    met = entries(a).join(entries(b).select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("_b")), ["i", "j"])
    own = met.groupBy("i").agg(F.sum(double("v") * double("_b")).cast(kind).alias("v"))
    return diagonal(CooMatrix(own.select("i", F.col("i").alias("j"), "v"), a.m, b.n), inverse)
