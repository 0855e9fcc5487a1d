"""Joins, scans, runs and sorts that the algebra is made of.

Scans and neighbours of an ordered frame are windows over blocks of ``block`` consecutive indices; what a block needs
from those before it comes from one row a block.  No window holds more than a block, or the list of blocks; that list
is itself scanned in blocks with ``levels`` above 2, as for more than block * block indices.  Sorts deal rows by range
of key and tie, so no key, however frequent, is a partition of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.conf import EngineConf, conf_of
from lattica.errors import InvalidSize, InvalidValue
from lattica.types import Vector

BLOCK = 1 << 16
UP = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)
SCANS = {"sum": (F.sum, lambda a, b: a + b, 0.0), "min": (F.min, F.least, float("inf")), "max": (F.max, F.greatest, float("-inf"))}


def zip_with(x: Vector, y: Vector, op: Callable[[Column, Column], Column]) -> Vector:
    """op(x, y) by index: an inner join where both are dense, else a full one with zeros for what is missing."""
    if x.n != y.n:
        raise InvalidSize(f"vectors of {x.n} and {y.n}")
    a, b = x.df.select("i", F.col("v").alias("_x")), y.df.select("i", F.col("v").alias("_y"))
    inner = x.dense and y.dense
    both = a.join(b, "i", "inner" if inner else "full")
    value = lambda c: F.col(c) if inner else F.coalesce(F.col(c), F.lit(0.0))
    return Vector(both.select("i", op(value("_x"), value("_y")).alias("v")), x.n, x.dense or y.dense)


def scan(df: DataFrame, op: str = "sum", inclusive: bool = True, keys: list[str] | None = None, order: str = "i", value: str = "v", block: int = BLOCK, name: str = "v", levels: int = 2) -> DataFrame:
    """Running sum, minimum or maximum along ``order``, within each key if keys are given.

    An exclusive scan starts at the operation's identity: 0, infinity or minus infinity.  Equal places in the order
    are not allowed.  All columns stay; ``name`` holds the result.
    """
    if op not in SCANS:
        raise InvalidValue(f"scan of {op}")
    agg, merge, identity = SCANS[op]
    keys = keys or []
    kind = dict(df.dtypes)[value]
    start = F.lit(identity) if op != "sum" or kind in ("double", "float") else F.lit(0).cast("bigint")
    own = df.withColumn("_block", F.floor(F.col(order) / block))
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    inside = F.coalesce(agg(value).over(local.rowsBetween(*(UP if inclusive else BEFORE))), start)
    blocks = own.groupBy(*keys, "_block").agg(agg(value).alias("_total"))
    if levels > 2:
        blocks = scan(blocks.withColumnRenamed("_block", "_at"), op, False, keys, "_at", "_total", block, "_earlier", levels - 1).select(*keys, F.col("_at").alias("_block"), F.col("_earlier").alias("_before"))
    else:
        earlier = F.coalesce(agg("_total").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(*BEFORE)), start)
        blocks = blocks.select(*keys, "_block", earlier.alias("_before"))
    few = not keys and block >= 1 << 10  # a row for so many of the frame's, which then need no sort to meet theirs
    out = own.withColumn("_inside", inside).join(F.broadcast(blocks) if few else blocks, [*keys, "_block"])
    return out.withColumn(name, merge(F.col("_before"), F.col("_inside"))).drop("_block", "_inside", "_before", "_total")


def neighbour(df: DataFrame, column: str, name: str, step: int = -1, order: str = "i", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """``column`` of the row before (step -1) or after (step 1) in the order; null at the end of the frame."""
    own = df.withColumn("_block", F.floor(F.col(order) / block))
    local = Window.partitionBy("_block").orderBy(order)
    beside = F.lag(column) if step < 0 else F.lead(column)
    edge = (F.max_by if step < 0 else F.min_by)(column, order)
    edges = own.groupBy("_block").agg(edge.alias("_edge"))
    if levels > 2:
        edges = neighbour(edges.withColumnRenamed("_block", "_number"), "_edge", "_further", step, "_number", block, levels - 1).select(F.col("_number").alias("_block"), F.col("_further").alias("_beyond"))
    else:
        edges = edges.select("_block", (F.lag("_edge") if step < 0 else F.lead("_edge")).over(Window.orderBy("_block")).alias("_beyond"))
    at_edge = beside.over(local).isNull() & ((F.row_number().over(local) == 1) if step < 0 else F.lead(order).over(local).isNull())
    out = own.withColumn("_beside", beside.over(local)).withColumn("_at_edge", at_edge).join(edges, "_block")
    return out.withColumn(name, F.when(F.col("_at_edge"), F.col("_beyond")).otherwise(F.col("_beside"))).drop("_block", "_beside", "_at_edge", "_beyond")


def key_change_flags(df: DataFrame, key: str = "key", order: str = "i", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """``flag`` 1 where the key differs from the one before it, 0 elsewhere and on the first row."""
    out = neighbour(df.withColumn("_here", F.lit(1)), key, "_last", -1, order, block, levels)
    out = neighbour(out, "_here", "_had", -1, order, block, levels)
    return out.withColumn("flag", F.when(F.col("_had").isNotNull() & ~F.col(key).eqNullSafe(F.col("_last")), 1).otherwise(0)).drop("_last", "_had", "_here")


def run_index(df: DataFrame, key: str = "key", order: str = "i", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """``run``: number of the run of equal keys a row lies in, from 0."""
    return scan(key_change_flags(df, key, order, block, levels), "sum", True, None, order, "flag", block, "run", levels).drop("flag")


def last_of_run(df: DataFrame, key: str = "key", order: str = "i", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """The last row of each run of equal keys."""
    out = neighbour(df.withColumn("_here", F.lit(1)), key, "_next", 1, order, block, levels)
    out = neighbour(out, "_here", "_has", 1, order, block, levels)
    return out.where(F.col("_has").isNull() | ~F.col(key).eqNullSafe(F.col("_next"))).drop("_next", "_has", "_here")


def reduce_by_key(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """One row for each key with the sum of its values; on sorted keys this is the sum of each run."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def levels_for(n: int, block: int = BLOCK) -> int:
    """Levels with which a scan of n indices has no window of more than ``block`` rows."""
    levels = 2
    while n > block**levels:
        levels += 1
    return levels


def sort_by_key(df: DataFrame, key: str, tie: str, descending: bool = False, name: str = "pos", conf: EngineConf | None = None, ordered: bool = True) -> DataFrame:
    """The frame in key order, ties by ``tie``, with each row's place from 0.

    Keys of any type that sorts, null keys last either way.  Rows are dealt by range of key and tie, sorted there,
    numbered and written, so that places hold whatever is computed anew; a row's place is the rows of the ranges before
    its own plus its number in it.  That takes one exchange of the rows; without ``ordered`` the result comes as it
    lies, with its places, else sorted by them once more.
    """
    order = [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = conf_of(df, conf).checkpoint(numbered.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))
    out = ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_place"))  # a row a range
    out = out.drop("_part", "_place", "_before")
    return out.orderBy(name) if ordered else out


def sort_coo(df: DataFrame) -> DataFrame:
    """Entries by row, then column."""
    return df.orderBy("i", "j")
