"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code-point order, null last, weigh ``weights`` in turn and share ``budget`` times all words; a target
stops at ``most`` times its source's size and the excess goes to the others by weight until none is above.  That
fixed point is min(cap, level * weight), found exactly by walking the sources in order of cap / weight.

A source's documents, shuffled by a hash, are cut into blocks of ``block`` words at most and nearly equal length.
Slot t of the mix takes one block.  The golden-ratio point of t, mapped through the cumulative shares of the slots
that the targets need, names its source; slots are ranked per source, and rank r takes block r modulo the source's
number of blocks.  A source gets as many slots as its target rounds to in blocks, one at least: slots beyond that stay empty, and the
few that a low-discrepancy sequence leaves out follow at the end.  A source so misses its target by half a block at most, and
no block, so no document, is used more than ``most`` times.

Any number of sources: sources are numbered in ranges, the level is found by sums, and points meet the spans of
sources in bins of the unit interval.  Documents are ordered in (source, hash slice) chunks and slots in runs of
``run`` numbers, with offsets from the chunks' totals; rows that repeat an id and a text are told apart by their rank
among themselves, so no slice holds more than its share.  The spans are broadcast only up to ``broadcast_rows`` rows.

Defined results: a null text has size 0; sizes of 0 are taken 0 times; a source without words has target 0; rows
that repeat an id, or have none, are separate; an empty table gives an empty mix; extra columns play no part.  Rows are told apart by their
place while read, so ``docs`` must give them in the same order each time, as a table does that is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fractional part in 64 bits: slot t lies at t * GOLDEN modulo 1.
GOLDEN = 0x9E3779B97F4A7C15
POINT_BITS = 52
#: Sources and slots that one task numbers.
SOURCES_A_TASK, SLOTS_A_TASK = 50_000, 1 << 22


def word_count(text: str) -> Column:
    """Words of a text as a 64-bit number, by the places where one begins; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def running(df: DataFrame, group: list[str], order: str, value: str, name: str, chunk: int) -> DataFrame:
    """The sum of ``value`` over the rows of the group that come before in a numbered order, by chunks of that many numbers."""
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_chunk").agg(F.sum(value).alias("_n"))
    start = totals.withColumn("_start", F.coalesce(F.sum("_n").over(upto(*group).orderBy("_chunk")), F.lit(0))).drop("_n")
    inside = rows.withColumn(name, F.coalesce(F.sum(value).over(upto(*group, "_chunk").orderBy(order)), F.lit(0)))
    return inside.join(start, [*group, "_chunk"]).withColumn(name, F.col(name) + F.col("_start")).drop("_chunk", "_start")


class SourceMix:
    """A schedule of equal-token blocks that brings every source near its target."""

    def __init__(self, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, block: int = 64, run: int = 1 << 16, seed: int = 17, slice_rows: int = 2000, broadcast_rows: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        if min(weights) <= 0 or budget <= 0 or min(most, block, run, slice_rows) < 1:
            raise ValueError("weights, budget, most, block, run and slice_rows are positive")
        self.weights, self.budget, self.most, self.block, self.run, self.seed = weights, budget, most, block, run, seed
        self.slice_rows, self.broadcast_rows = slice_rows, broadcast_rows
        self.id_col, self.text_col, self.source_col = id_col, text_col, source_col

    def sized(self, docs: DataFrame) -> DataFrame:
        """(_row, doc_id, source, size, order) of every row; order is its place in the shuffle."""
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(self.id_col).alias("doc_id"), F.col(self.source_col).cast("string").alias("source"), word_count(self.text_col).alias("size"), F.xxhash64(F.lit(self.seed), self.id_col, self.text_col, self.source_col).alias("_same"))
        # equal rows are ranked within their input partition (the upper bits of _row), then partition by partition
        rows = cut(rows.withColumn("_part", F.shiftright("_row", 33)), "sized")
        counts = rows.groupBy("_same", "_part").agg(F.count(F.lit(1)).alias("_n"))
        own = Window.partitionBy("_same").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(own), F.lit(0))).drop("_n")
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_same", "_part").orderBy("_row"))).join(start, ["_same", "_part"])
        return ranked.select("_row", "doc_id", "source", "size", F.xxhash64("_same", F.col("_rank") + F.col("_start")).alias("order"))

    def targets(self, sized: DataFrame) -> DataFrame:
        """One row per source: number, source, source_size, target, blocks it is cut into, and slots it is to get."""
        by_source = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
        order = [F.col("source").isNull(), F.col("source")]
        ranged = by_source.repartitionByRange(max(1, math.ceil(by_source.count() / SOURCES_A_TASK)), *order).withColumn("_part", F.spark_partition_id())
        ranged = cut(ranged, "ranged")
        numbered = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
        counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        numbered = numbered.join(counts, "_part").withColumn("number", (F.col("_in") + F.col("_start")).cast("long"))
        weight = F.element_at(F.array(*map(F.lit, self.weights)), (F.col("number") % len(self.weights)).cast("int") + 1).cast("double")
        numbered = cut(numbered.select("number", "source", "source_size", weight.alias("weight"), (self.most * F.col("source_size")).alias("cap")), "numbered")
        level = self._level(numbered)
        target = F.when(F.col("source_size") > 0, F.least(F.col("cap").cast("double"), level * F.col("weight"))).otherwise(0.0)
        out = numbered.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / self.block))
        need = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
        return out.withColumn("need", need).withColumn("slots", F.when(F.col("target") > 0, F.greatest(F.round("need"), F.lit(1.0))).otherwise(0.0).cast("long")).drop("weight", "cap")

    def _level(self, numbered: DataFrame) -> float:
        """The words a unit of weight gets: what capped sources leave is shared anew until no other is above its cap."""
        total = numbered.agg(F.sum("source_size").alias("size"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        budget, capped, level = min(self.budget * (total["size"] or 0), float(total["cap"] or 0)), -1, (0.0)
        while True:
            over = F.col("cap") <= level * F.col("weight")
            now = numbered.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
            if now["n"] == capped or not now["weight"]:
                return level if now["weight"] else float("inf")
            capped, level = now["n"], (budget - (now["cap"] or 0)) / now["weight"]

    def spans(self, targets: DataFrame) -> tuple[DataFrame, float]:
        """(number, lo, hi) of each source's part of the unit interval, and the slots needed in all."""
        total = targets.agg(F.sum("need")).first()[0] or 0.0
        lo = running(targets, [], "number", "need", "before", self.run).select("number", (F.col("before") / F.lit(total or 1.0)).alias("lo"))
        following = lo.select((F.col("number") - 1).alias("number"), F.col("lo").alias("hi"))
        return cut(lo.join(following, "number", "left").withColumn("hi", F.coalesce("hi", F.lit(2.0))).where("lo < hi"), "spans"), total

    def schedule(self, targets: DataFrame) -> DataFrame:
        """(slot, number, rank, block_no): the mix in order, one block a slot.  ``targets`` is read more than once."""
        spans, total = self.spans(targets)
        n, slots = spans.count(), math.ceil(total)
        spark = targets.sparkSession
        bins = max(1, min(4 * n, slots))
        of_bins = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.least(F.floor(F.least("hi", F.lit(1.0)) * bins), F.lit(bins - 1)))))
        of_bins = F.broadcast(of_bins) if bins + n <= self.broadcast_rows else of_bins
        slot = spark.range(0, slots, 1, max(spark.sparkContext.defaultParallelism, math.ceil(slots / SLOTS_A_TASK))).withColumnRenamed("id", "slot")
        step = (GOLDEN >> (64 - POINT_BITS)) | 1
        low, high = F.col("slot").bitwiseAND((1 << 11) - 1), F.shiftright("slot", 11).bitwiseAND((1 << 30) - 1)
        slot = slot.withColumn("point", _mod_product(low, high, step).cast("double") / float(1 << POINT_BITS))
        placed = slot.withColumn("bin", F.floor(F.col("point") * bins)).join(of_bins, "bin").where("lo <= point AND point < hi").select("slot", "number", F.lit(1).cast("long").alias("one"))
        ranked = running(cut(placed, "placed"), ["number"], "slot", "one", "rank", self.run)
        wanted = targets.select("number", "slots", "blocks")
        kept = ranked.join(wanted, "number").where("rank < slots").select("slot", "number", "rank", "blocks")
        # sources that the points have given too few slots
        counts = ranked.groupBy("number").agg(F.count(F.lit(1)).alias("got"))
        short = wanted.join(counts, "number", "left").withColumn("got", F.coalesce("got", F.lit(0))).withColumn("missing", F.col("slots") - F.col("got")).where("missing > 0")
        short = running(short, [], "number", "missing", "before", self.run)
        late = short.select("number", "blocks", "got", "before", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
        late = late.select((slots + F.col("before") + F.col("rank") - F.col("got")).alias("slot"), "number", "rank", "blocks")
        return kept.unionByName(late).select("slot", "number", "rank", (F.col("rank") % F.col("blocks")).alias("block_no"))

    def placed(self, sized: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
        """Documents with the words of their source before them in the shuffle, and their source's number."""
        slices = max(1, math.ceil(rows / self.slice_rows))
        own = sized.where("size > 0").withColumn("slice", F.floor((F.shiftrightunsigned("order", 24).cast("double") / float(1 << 40)) * slices).cast("long"))
        own = own.join(targets.select(F.col("source").alias("_s"), "number", "source_size", "blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        totals = own.groupBy("number", "slice").agg(F.sum("size").alias("n"))
        upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        before = totals.withColumn("before", F.coalesce(F.sum("n").over(upto("number").orderBy("slice")), F.lit(0))).drop("n")
        inside = F.coalesce(F.sum("size").over(upto("number", "slice").orderBy(F.shiftrightunsigned("order", 24), "order", "_row")), F.lit(0))
        return own.withColumn("inside", inside).join(before, ["number", "slice"]).withColumn("begin", F.col("before") + F.col("inside"))

    def takes(self, docs: DataFrame) -> DataFrame:
        """(_row, doc_id, size, source, source_size, target, taken) of every row; _row is its ``monotonically_increasing_id``."""
        sized = cut(self.sized(docs), "sized")
        targets = cut(self.targets(sized), "targets")
        uses = cut(self.schedule(targets).groupBy("number", "block_no").agg(F.count(F.lit(1)).alias("uses")), "uses")
        place = self.placed(sized, targets, sized.count())
        # the first ``longer`` blocks of a source hold a word more than the others
        place = place.withColumn("least", F.expr("source_size div blocks")).withColumn("longer", F.col("source_size") % F.col("blocks"))
        edge = F.col("longer") * (F.col("least") + 1)
        block_at = lambda p: F.when(p < edge, F.floor(p / (F.col("least") + 1))).otherwise(F.col("longer") + F.floor((p - edge) / F.col("least")))
        start = lambda k: k * F.col("least") + F.least(k, F.col("longer"))
        end = F.col("begin") + F.col("size")
        pieces = place.withColumn("block_no", F.explode(F.sequence(block_at(F.col("begin")), block_at(end - 1))))
        overlap = F.least(end, start(F.col("block_no") + 1)) - F.greatest("begin", start(F.col("block_no")))
        taken = pieces.select("_row", "number", "block_no", overlap.alias("overlap")).join(uses, ["number", "block_no"]).groupBy("_row").agg(F.sum(F.col("overlap") * F.col("uses")).alias("taken"))
        out = sized.join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).join(taken, "_row", "left")
        return out.select("_row", "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _mod_product(low: Column, high: Column, step: int) -> Column:
    """(high * 2^11 + low) * step modulo 2^52, each product below 2^63."""
    m = (1 << POINT_BITS) - 1
    a = low * F.lit(step)
    # high * step * 2^11 modulo 2^52: only step modulo 2^41 matters, split so that no product overflows
    narrow = step & ((1 << 41) - 1)
    upper, lower = narrow >> 20, narrow & ((1 << 20) - 1)
    b = high * F.lit(lower) + F.shiftleft((high * F.lit(upper)).bitwiseAND((1 << 21) - 1), 20)
    return (a.bitwiseAND(m) + F.shiftleft(b.bitwiseAND((1 << 41) - 1), 11)).bitwiseAND(m)
