"""Vectors and matrices: DataFrames keyed by 0-based coordinates, with their shapes on the driver.

An entry that is not there is a structural zero; values are never null.  ``dense`` says that a vector has a row for
every index, which lets joins of dense vectors be inner ones.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import InvalidSize


@dataclass(frozen=True)
class Vector:
    """(i bigint, v) and its length."""

    df: DataFrame
    n: int
    dense: bool = True

    @classmethod
    def of(cls, df: DataFrame, i: Column | str, v: Column | str, n: int, kind: str = "double", dense: bool = True) -> Vector:
        col = lambda c: F.col(c) if isinstance(c, str) else c
        return cls(df.select(col(i).cast("bigint").alias("i"), col(v).cast(kind).alias("v")), n, dense)

    @classmethod
    def constant(cls, spark: SparkSession, n: int, value: float) -> Vector:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.lit(value).alias("v")), n)

    def with_values(self, v: Column) -> Vector:
        return replace(self, df=self.df.select("i", v.alias("v")))

    def slice(self, offset: int, n: int) -> Vector:
        """The n entries from an offset on, numbered from 0."""
        if offset < 0 or n < 0 or offset + n > self.n:
            raise InvalidSize(f"slice [{offset}, {offset + n}) of {self.n}")
        own = self.df.where((F.col("i") >= offset) & (F.col("i") < offset + n))
        return replace(self, df=own.select((F.col("i") - offset).alias("i"), "v"), n=n)

    def completed(self) -> Vector:
        """The same vector with explicit zeros."""
        if self.dense:
            return self
        every = self.df.sparkSession.range(self.n).withColumnRenamed("id", "i")
        return Vector(every.join(self.df, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v")), self.n)


@dataclass(frozen=True)
class CooMatrix:
    """(i bigint, j bigint, v) and its shape; ``by`` names the coordinate that a stored matrix is bucketed by."""

    df: DataFrame
    m: int
    n: int
    by: str | None = None

    @classmethod
    def from_entries(cls, df: DataFrame, i: str, j: str, v: Column | str, m: int, n: int, dup: str = "sum", kind: str = "double") -> CooMatrix:
        """Entries from any columns; equal coordinates are added, kept apart with ``dup='keep'``, or refused with ``dup='error'``.

        ``kind``: double or float.  What is refused raises while a plan that reads the matrix runs.
        """
        value = F.col(v) if isinstance(v, str) else v
        own = df.select(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), value.cast(kind).alias("v"))
        if dup == "keep":
            return cls(own, m, n)
        total = F.sum("v").cast(kind)
        if dup == "error":
            total = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("repeated coordinate "), _at()))).otherwise(total)
        return cls(own.groupBy("i", "j").agg(total.alias("v")), m, n)

    def checked(self) -> CooMatrix:
        """The same entries; a coordinate or value that is null, or a coordinate out of range, raises while they are read.

        The conditions are part of whatever plan reads the matrix, which needs no pass of its own for them.
        """
        inside = F.col("i").between(0, self.m - 1) & F.col("j").between(0, self.n - 1) & F.col("v").isNotNull()
        refuse = F.raise_error(F.concat(F.lit(f"not an entry of a {self.m} x {self.n} matrix: "), _at()))
        held = lambda c: F.when(F.coalesce(inside, F.lit(False)), F.col(c)).otherwise(refuse.cast("bigint")).alias(c)
        return replace(self, df=self.df.select(held("i"), held("j"), "v"), by=None)

    def transpose(self) -> CooMatrix:
        return CooMatrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.n, self.m, {"i": "j", "j": "i"}.get(self.by))

    def prune(self) -> CooMatrix:
        """Without entries that are zero."""
        return replace(self, df=self.df.where("v <> 0"))

    def symmetrize(self, sign: int = 1) -> CooMatrix:
        """Each entry off the diagonal also mirrored, times ``sign``."""
        if self.m != self.n:
            raise InvalidSize("only a square matrix can be mirrored")
        cell = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.cast(self.df.schema["v"].dataType).alias("v"))
        own, mirror = cell("i", "j", F.col("v")), cell("j", "i", F.col("v") * sign)
        both = F.when(F.col("i") != F.col("j"), F.array(own, mirror)).otherwise(F.array(own))  # one pass: the matrix may cost a product
        return replace(self, df=self.df.select(F.inline(both)), by=None)


def _at() -> Column:
    return F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("null")) if c in "ij" else F.lit(c) for c in ("(", "i", ", ", "j", ")")))


@dataclass(frozen=True)
class CsrMatrix:
    """(i, off, nnz, cols, vals), a row for every matrix row, empty ones included."""

    df: DataFrame
    m: int
    n: int


@dataclass(frozen=True)
class BlockedMatrix:
    """(block, chunk, i, j, v), bucketed by block and chunk: whole short rows in a block of their own each, long rows in chunks.

    Blocks of short rows are numbered from 0 and have chunk 0; a long row has a negative block and several chunks.
    """

    df: DataFrame
    m: int
    n: int


@dataclass(frozen=True)
class DenseMatrix:
    """(i, vals array<double>), every array of length n."""

    df: DataFrame
    m: int
    n: int
