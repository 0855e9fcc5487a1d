"""A matrix kept up to date from a stream of entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.tables import cut, delete, free


def accumulate(entries: DataFrame, i: str, j: str, v: Column | str) -> DataFrame:
    """(i, j, v): sums of the entries so far; write it in ``update`` or ``complete`` mode."""
    value = F.col(v) if isinstance(v, str) else v
    own = entries.select(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), value.cast("double").alias("v"))
    return own.groupBy("i", "j").agg(F.sum("v").alias("v"))


def accumulate_windows(entries: DataFrame, time: str, window: str, late: str, i: str, j: str, v: Column | str) -> DataFrame:
    """(begin, i, j, v): one matrix for each tumbling window; with ``start_final`` windows older than ``late`` are final and their state goes."""
    value = F.col(v) if isinstance(v, str) else v
    own = entries.withWatermark(time, late).select(F.window(time, window).alias("_w"), F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), value.cast("double").alias("v"))
    return own.groupBy("_w", "i", "j").agg(F.sum("v").alias("v")).select(F.col("_w.start").alias("begin"), "i", "j", "v")


def start(matrix: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run the accumulation over what the source has now; each micro-batch leaves the whole result as a table under ``path``.

    Results are written by the executors and never meet on the driver.  Of one batch that runs again the last table
    counts, and tables before it go.
    """

    def store(result: DataFrame, number: int) -> None:
        spark = result.sparkSession
        result.write.mode("overwrite").parquet(f"{path}/{number:012d}")
        if number:
            delete(spark, f"{path}/{number - 1:012d}")

    return matrix.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_final(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each window once, when the watermark has passed its end; its state goes then.

    Read the result with ``finals``.  What comes later than the watermark allows is left out.
    """
    return windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finals(spark: SparkSession, path: str) -> DataFrame:
    """The windows written so far, each whole."""
    return spark.read.parquet(path)


def start_merged(matrix: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run the accumulation so that each micro-batch writes just the entries it has changed, as a table of its own.

    A batch that runs again replaces its table.  Read the matrix with ``merged``; ``compact`` folds the tables into one.
    """

    def store(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/{number:012d}")

    return matrix.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _whole(spark: SparkSession, path: str) -> list[str]:
    """The tables under a path that were written whole, in name order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(x.toString() for x in done)


def merged(spark: SparkSession, path: str, keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Of each entry what the last batch that changed it has left."""
    held = [spark.read.parquet(p).withColumn("_batch", F.lit(int(p.rsplit("/", 1)[1]))) for p in _whole(spark, path)]
    every = reduce(DataFrame.unionByName, held)
    return every.groupBy(*keys).agg(F.max_by("v", "_batch").alias("v"))


def compact(spark: SparkSession, path: str, keys: tuple[str, ...] = ("i", "j")) -> None:
    """Fold all tables into that of the last batch; no stream may write them meanwhile."""
    before = _whole(spark, path)
    if len(before) > 1:
        whole = cut(merged(spark, path, keys), "merged")
        whole.write.mode("overwrite").parquet(before[-1])
        free(whole)
        for p in before[:-1]:
            delete(spark, p)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The result of the last micro-batch that was written whole."""
    return spark.read.parquet(_whole(spark, path)[-1])
