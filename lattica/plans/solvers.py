"""Conjugate gradients and BiCGStab over one state frame.

All vectors of an iteration are columns of one frame keyed by i, so updates are projections, dot products and norms
are column aggregates, and only the products with A join.  A is stored bucketed by column, the state by index with as
many buckets, which grow in number with A's entries, so a product reads both where they lie and shuffles only the sums
of its rows.  The state is written to the shared folder once for each product, which ends its lineage, and the one
before it is deleted; the dot products of a fresh product are observed while it is written.  Scalars alone reach the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lattica.conf import EngineConf, conf_of
from lattica.errors import InvalidSystemSize, InvalidValue
from lattica.operators.blas23 import diagonal, entries
from lattica.operators.convert import store
from lattica.types import CooMatrix, CsrMatrix, Vector

#: From a matrix to (i, d), the factors a residual is multiplied by; None multiplies by one.
Preconditioner = Callable[[CooMatrix | CsrMatrix], DataFrame]


def jacobi(a: CooMatrix | CsrMatrix) -> DataFrame:
    """The reciprocals of the diagonal."""
    d = diagonal(a).df
    if d.where("v <> 0").count() < a.n:
        raise InvalidValue("the diagonal preconditioner needs a diagonal without zeros")
    return d.select("i", (1 / F.col("v")).alias("d"))


#: Entries of a matrix that are worth a bucket, and that a bucket has at most.
BUCKET, LARGEST = 1 << 18, 1 << 22

#: Preconditioners by name; a control may name any function of this kind instead.
PRECONDITIONERS: dict[str, Preconditioner | None] = {"none": None, "diagonal": jacobi}


@dataclass(frozen=True)
class SolverControl:
    """When to stop: the residual |r|1 / |b|1 is at most ``rel_tol``, or at most ``abs_tol`` times the first one.

    ``max_iters`` is the number of iterations run at most.  ``compat_cap`` runs one more, half of one in BiCGStab,
    and still reports the cap.  ``verbose`` prints each residual.
    """

    preconditioner: str | Preconditioner = "none"
    max_iters: int = 100
    rel_tol: float = 1e-2
    abs_tol: float = 1e-5
    compat_cap: bool = False
    verbose: bool = False

    def __post_init__(self):
        if not callable(self.preconditioner) and self.preconditioner not in PRECONDITIONERS or self.max_iters < 0 or self.rel_tol < 0 or self.abs_tol < 0:
            raise InvalidValue(f"solver control {self}")

    def done(self, residual: float, first: float) -> bool:
        return residual <= self.rel_tol or residual <= self.abs_tol * first


@dataclass(frozen=True)
class SolveResult:
    x: Vector
    iterations: int
    residual: float
    converged: bool


def _start(a: CooMatrix | CsrMatrix, b: Vector, x0: Vector | None, control: SolverControl) -> DataFrame:
    """(i, x, b, d): the unknowns, the right side, and the preconditioner's factor."""
    if a.m != a.n or b.n != a.n or x0 is not None and x0.n != a.n:
        raise InvalidSystemSize(f"matrix {a.m} x {a.n}, right side {b.n}, start {x0.n if x0 else 'none'}")
    state = b.completed().df.select("i", F.col("v").cast("double").alias("b"))
    state = state.withColumn("x", F.lit(0.0)) if x0 is None else state.join(x0.completed().df.select("i", F.col("v").cast("double").alias("x")), "i")
    own = control.preconditioner if callable(control.preconditioner) else PRECONDITIONERS[control.preconditioner]
    return state.withColumn("d", F.lit(1.0)) if own is None else state.join(own(a).select("i", "d"), "i")


def _buckets(entries: int, parts: int) -> int:
    """Of a matrix and its states: every product starts a task and writes a file for each, so small systems have few."""
    return max(min(parts, math.ceil(entries / BUCKET)), math.ceil(entries / LARGEST), 1)


class _System:
    """The matrix, stored by column once, and products of it with columns of the state."""

    def __init__(self, a: CooMatrix | CsrMatrix, conf: EngineConf):
        self.conf, self.held = conf, []
        self.matrix, self.own = store(a, "j", conf).df, not (isinstance(a, CooMatrix) and a.by == "j")

    @classmethod
    def sized(cls, a: CooMatrix | CsrMatrix, conf: EngineConf) -> _System:
        """With as many buckets as the matrix is worth, unless it is stored or the settings give a number."""
        if conf.buckets or isinstance(a, CooMatrix) and a.by == "j":
            return cls(a, conf)
        written = conf.checkpoint(entries(a))
        buckets = _buckets(written.count(), int(conf.spark.conf.get("spark.sql.shuffle.partitions")))
        system = cls(CooMatrix(written, a.m, a.n), replace(conf, buckets=buckets))
        conf.free(written)
        return system

    def product(self, state: DataFrame, column: Column, name: str) -> DataFrame:
        """The state with A times the column added."""
        product = self.matrix.join(state.select(F.col("i").alias("j"), column.alias("_x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("_y"))
        return state.join(product, "i", "left").withColumn(name, F.coalesce("_y", F.lit(0.0))).drop("_y")

    def times(self, state: DataFrame, column: Column, name: str, *products: Column) -> tuple[DataFrame, list[float]]:
        """The state with A times the column added, cut from its lineage, and the sums of some columns of it."""
        out, seen = self.product(state, column, name), Observation()
        if products:
            out = out.observe(seen, *(F.coalesce(F.sum(p), F.lit(0.0)).alias(f"s{k}") for k, p in enumerate(products)))
        out = self.conf.store(out, "state", "i")
        for table in self.held:  # what the new table was made from
            self.conf.free(table)
        self.held = [out]
        return out, [seen.get[f"s{k}"] for k in range(len(products))]

    def end(self) -> None:
        if self.own:
            self.conf.free(self.matrix)


def _sums(state: DataFrame, *products: Column) -> list[float]:
    """The sums of some columns, in one pass."""
    row = state.agg(*(F.coalesce(F.sum(p), F.lit(0.0)).alias(f"s{k}") for k, p in enumerate(products))).first()
    return [row[k] for k in range(len(products))]


def _prepare(a, b, x0, control, conf):
    """The state with r = b - A x, |b|1 and the first residual; no state where b is zero."""
    state = _start(a, b, x0, control)
    norm = _sums(state, F.abs("b"))[0]
    if norm == 0:
        return None, None, 0.0, 0.0
    system = _System.sized(a, conf)
    state, (first,) = system.times(state, F.col("x"), "y", F.abs(F.col("b") - F.col("y")))
    return system, state.withColumn("r", F.col("b") - F.col("y")).drop("y", "b"), norm, first / norm


def _result(state: DataFrame, n: int, iterations: int, residual: float, first: float, control: SolverControl) -> SolveResult:
    return SolveResult(Vector(state.select("i", F.col("x").alias("v")), n), iterations, residual, control.done(residual, first))


def cg(a: CooMatrix | CsrMatrix, b: Vector, x0: Vector | None = None, control: SolverControl | None = None, conf: EngineConf | None = None) -> SolveResult:
    """Preconditioned conjugate gradients for a symmetric positive definite matrix; x = 0 for b = 0."""
    control, conf = control or SolverControl(), conf_of(b.df, conf)
    system, state, norm, first = _prepare(a, b, x0, control, conf)
    if system is None:
        return SolveResult(Vector.constant(b.df.sparkSession, b.n, 0.0), 0, 0.0, True)
    residual, done = first, 0
    if control.done(residual, first) or control.max_iters == 0:
        system.end()
        return _result(state, b.n, 0, residual, first, control)
    z = F.col("d") * F.col("r")
    state = state.withColumn("p", z)
    rz = _sums(state, F.col("r") * z)[0]
    cap = control.max_iters + control.compat_cap
    while done < cap:
        state, (py,) = system.times(state, F.col("p"), "y", F.col("p") * F.col("y"))
        alpha = rz / py if py else 0.0
        state = state.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("y")}).drop("y")
        new, left = _sums(state, F.col("r") * z, F.abs("r"))
        state = state.withColumn("p", z + (new / rz if rz else 0.0) * F.col("p"))
        rz, residual, done = new, left / norm, done + 1
        if control.verbose:
            print(f"iteration {done}: residual {residual:.6g}")
        if control.done(residual, first) or py == 0:
            break
    system.end()
    return _result(state, b.n, min(done, control.max_iters), residual, first, control)


def bicgstab(a: CooMatrix | CsrMatrix, b: Vector, x0: Vector | None = None, control: SolverControl | None = None, conf: EngineConf | None = None) -> SolveResult:
    """Right-preconditioned BiCGStab for any regular matrix; x = 0 for b = 0."""
    control, conf = control or SolverControl(), conf_of(b.df, conf)
    system, state, norm, first = _prepare(a, b, x0, control, conf)
    if system is None:
        return SolveResult(Vector.constant(b.df.sparkSession, b.n, 0.0), 0, 0.0, True)
    residual, done = first, 0
    if control.done(residual, first) or control.max_iters == 0:
        system.end()
        return _result(state, b.n, 0, residual, first, control)
    state = state.withColumns({"h": F.col("r"), "p": F.col("r")})
    rho = _sums(state, F.col("h") * F.col("r"))[0]
    cap = control.max_iters + control.compat_cap
    while done < cap:
        state, (hv,) = system.times(state, F.col("d") * F.col("p"), "v", F.col("h") * F.col("v"))
        alpha = rho / hv if hv else 0.0
        state = state.withColumn("s", F.col("r") - alpha * F.col("v"))
        # the half step's residual is seen with the next product, which is not needed if that ends the run
        state, (ts, tt, half) = system.times(state, F.col("d") * F.col("s"), "t", F.col("t") * F.col("s"), F.col("t") * F.col("t"), F.abs("s"))
        half = half / norm
        if control.done(half, first) or hv == 0 or done == control.max_iters:
            state, residual, done = state.withColumn("x", F.col("x") + alpha * F.col("d") * F.col("p")), half, done + 1
            break
        omega = ts / tt if tt else 0.0
        state = state.withColumns({"x": F.col("x") + alpha * F.col("d") * F.col("p") + omega * F.col("d") * F.col("s"), "r": F.col("s") - omega * F.col("t")})
        new, left = _sums(state, F.col("h") * F.col("r"), F.abs("r"))
        beta = (new / rho) * (alpha / omega) if rho and omega else 0.0
        state = state.withColumn("p", F.col("r") + beta * (F.col("p") - omega * F.col("v"))).drop("v", "s", "t")
        rho, residual, done = new, left / norm, done + 1
        if control.verbose:
            print(f"iteration {done}: residual {residual:.6g}")
        if control.done(residual, first) or omega == 0:
            break
    system.end()
    return _result(state, b.n, min(done, control.max_iters), residual, first, control)
