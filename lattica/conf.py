"""Settings of a session's engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lattica.tables import cut, free, stored

__version__ = (0, 2, 0, 0)


@dataclass(frozen=True)
class EngineConf:
    """``broadcast_bytes`` bounds what is broadcast, ``scan_block`` the rows of one window, ``extended_precision`` picks exact sums.

    ``buckets`` is the number of buckets of stored matrices and states, that of shuffle partitions unless it is given.

    Results are lazy plans; with ``eager`` products are computed and written when they are asked for.
    """

    spark: SparkSession
    extended_precision: bool = False
    broadcast_bytes: int = 64 << 20
    scan_block: int = 1 << 16
    eager: bool = False
    buckets: int | None = None

    def checkpoint(self, df: DataFrame) -> DataFrame:
        """The frame cut from its lineage, as a table in the shared folder of ``spark.checkpoint.dir``; a temporary one where none is set."""
        return cut(df, "state")

    def store(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """The frame as a table bucketed by keys, in the same folder."""
        return stored(df, name, list(keys), self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def free(self, df: DataFrame) -> None:
        """Delete what ``checkpoint`` has written for a frame, which can't be read any more."""
        free(df)

    def finish(self, df: DataFrame) -> DataFrame:
        return self.checkpoint(df) if self.eager else df


def conf_of(df: DataFrame, conf: EngineConf | None) -> EngineConf:
    return conf or EngineConf(df.sparkSession)
