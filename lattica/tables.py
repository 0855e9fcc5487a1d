"""Tables cut from their lineage: written as Parquet where all executors see them, read back, and freed."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables cut inside each open ``scratch``, innermost last.
_scratch: list[list[str]] = []
KEY = "spark.checkpoint.dir"
#: Catalog names of bucketed tables by the path they lie under.
_named: dict[str, str] = {}
#: What deletes a query's shuffle files at its end, and what it was before the first open ``swept`` of each session.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_sweeps: dict[int, list] = {}
_lock = threading.Lock()


def folder(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one of this machine only where none is named, as in tests."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{KEY} must name a folder that all executors share")
    made = spark.conf.get("spark.lattica.local.dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.lattica.local.dir", made)
    return f"file://{made}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table just written; a lost executor costs no recomputation before it."""
    path = new_path(df.sparkSession, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """The same rows as a table bucketed and sorted by ``keys``: joins and aggregations on them read it without an exchange.

    Tables with equal numbers of buckets meet bucket by bucket.  The session's catalog knows the table until it is freed.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if _scratch:
        _scratch[-1].append(path)
    _named[path] = "lattica_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(_named[path])
    return spark.table(_named[path])


def delete(spark: SparkSession, path: str) -> None:
    if path in _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end every table cut inside: what is to stay must have been written by then, other than by ``cut``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the queries run inside are deleted as each ends; what is to be read again must be cut.

    A frame made inside and run again later has its stages run anew.
    """
    key = spark._jsparkSession.hashCode()
    with _lock:
        if key not in _sweeps:
            _sweeps[key] = [spark.conf.get(SWEEP, "false"), 0]
            spark.conf.set(SWEEP, "true")
        _sweeps[key][1] += 1
    try:
        yield
    finally:
        with _lock:
            _sweeps[key][1] -= 1
            if not _sweeps[key][1]:
                spark.conf.set(SWEEP, _sweeps.pop(key)[0])


def free(df: DataFrame) -> None:
    """Delete the table that ``cut`` has written for this frame; frames that read other files stay as they are."""
    spark = df.sparkSession
    plain = lambda path: path.replace("file:///", "file:/")
    known = {plain(path): path for path in _named}
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain(path).startswith(plain(f"{folder(spark)}/lattica/")):
            delete(spark, known.get(plain(path), path))


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file on whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(content.encode()))
    stream.close()
