"""Vector operators.  Scalars are known when the plan is built, so special cases leave out joins and operands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import InvalidSize
from lattica.functions.exprs import ieee_div
from lattica.operators.prims import zip_with
from lattica.types import Vector


def fill(x: Vector, value: float) -> Vector:
    """A vector of x's indices that holds ``value`` everywhere."""
    return x.completed().with_values(F.lit(float(value)))


def copy(x: Vector) -> Vector:
    """x itself: frames never change."""
    return x


def scale(alpha: float, x: Vector) -> Vector:
    """alpha x; zeros for alpha = 0, whatever x holds."""
    return x.with_values(F.lit(0.0) if alpha == 0 else F.lit(float(alpha)) * F.col("v"))


def axpy(alpha: float, x: Vector, y: Vector, minus: bool = False) -> Vector:
    """y + alpha x, or y - alpha x; y alone for alpha = 0."""
    _fits(x, y)
    a = -float(alpha) if minus else float(alpha)
    return y if alpha == 0 else zip_with(x, y, lambda p, q: F.lit(a) * p + q)


def axpby(alpha: float, x: Vector, beta: float, y: Vector, minus: bool = False) -> Vector:
    """alpha x + beta y, or alpha x - beta y; an operand with factor 0 is not read."""
    _fits(x, y)
    b = -float(beta) if minus else float(beta)
    if alpha == 0 and beta == 0:
        return fill(y, 0.0)
    if alpha == 0:
        return scale(b, y)
    if beta == 0:
        return scale(alpha, x)
    if alpha == 1:
        return axpy(b, y, x)
    if b == 1:
        return axpy(alpha, x, y)
    return zip_with(x, y, lambda p, q: F.lit(float(alpha)) * p + F.lit(b) * q)


def add(x: Vector, y: Vector) -> Vector:
    return zip_with(x, y, lambda p, q: p + q)


def sub(x: Vector, y: Vector) -> Vector:
    return zip_with(x, y, lambda p, q: p - q)


def mul(x: Vector, y: Vector) -> Vector:
    return zip_with(x, y, lambda p, q: p * q)


def div(x: Vector, y: Vector) -> Vector:
    """x / y by IEEE rules."""
    return zip_with(x, y, ieee_div)


def minimum(x: Vector, y: Vector) -> Vector:
    return zip_with(x, y, F.least)


def maximum(x: Vector, y: Vector) -> Vector:
    return zip_with(x, y, F.greatest)


def nonzeros(x: Vector) -> Vector:
    """1 where x is not zero (NaN included), 0 elsewhere."""
    return x.with_values((F.col("v") != 0).cast("int"))


def element(x: Vector, i: int) -> DataFrame:
    """(i, v) of one place."""
    if not 0 <= i < x.n:
        raise InvalidSize(f"place {i} of {x.n}")
    return x.df.where(F.col("i") == i)


def equal(x: Vector, y: Vector) -> DataFrame:
    """(equal) whether both hold the same values, as one row; NaN equals NaN."""
    _fits(x, y)
    differs = zip_with(x, y, lambda p, q: (~p.eqNullSafe(q)).cast("int")).df
    return differs.agg((F.coalesce(F.sum("v"), F.lit(0)) == 0).alias("equal"))


def reduce(x: Vector) -> DataFrame:
    """(v) the sum; 0 of an empty vector.  Integers add up to 64 bits, floats are rounded once, at the end."""
    kind = dict(x.df.dtypes)["v"]
    total = F.coalesce(F.sum("v"), F.lit(0))
    return x.df.agg(total.cast({"int": "bigint", "bigint": "bigint", "float": "float"}.get(kind, "double")).alias("v"))


def _total(x: Vector, e: Column) -> DataFrame:
    return x.df.agg(F.coalesce(F.sum(e), F.lit(0.0)).alias("v"))


def nrm1(x: Vector) -> DataFrame:
    return _total(x, F.abs("v"))


def nrm2(x: Vector) -> DataFrame:
    return _total(x, F.col("v") * F.col("v")).select(F.sqrt("v").alias("v"))


def dot(x: Vector, y: Vector) -> DataFrame:
    return _total(mul(x, y), F.col("v"))


def nnz(x: Vector) -> DataFrame:
    """(nnz) how many values are not zero."""
    return x.df.agg(F.count_if(F.col("v") != 0).alias("nnz"))


def _fits(x: Vector, y: Vector) -> None:
    if x.n != y.n:
        raise InvalidSize(f"vectors of {x.n} and {y.n}")
