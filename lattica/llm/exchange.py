"""Exchange of hash sets between batches of documents through ordinary shuffles.

Batches are runs of consecutive rows of bounded size, each compressed, shuffled once and read by every pass.  A batch sends each distinct hash once, in packed blobs, to the bucket that owns it; the bucket answers
each batch.  A hash that a third of all documents hold thus costs one entry a batch, not one a document, no task
gathers the rows of a key, and neither a hot id nor a repeated row makes a batch larger.

A message costs its row besides its entries, and there are at most batches x buckets messages.  So that they stay in
proportion to the corpus, both grow with the square root of its bytes once a message would hold fewer than about
``MESSAGE_ENTRIES`` entries (from some 270 GB of text on; at 100 TB a batch has 80 MB and a bucket 320 MB).

Batches follow the order of rows in the input's partitions, so that order must be the same whenever a lost task runs
again.  That holds for tables as read; an input whose plan shuffles is written and read back first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import cut
from lattica.llm.tokens import pieces

U64 = np.uint64
LOW_BITS = 40
LOW = U64((1 << LOW_BITS) - 1)
#: Bytes of text in a batch and behind a bucket, rows in a batch, and bytes of text an entry of a message stands for, about.
BATCH_BYTES, BUCKET_BYTES, BATCH_ROWS, ENTRY_BYTES = 4 << 20, 16 << 20, 1 << 14, 4
MESSAGE_ENTRIES = 64
#: Bytes of a part of a batch: arrays from half a megabyte on take whole regions of a small heap.
PART_BYTES = 256 << 10
MIN_BUCKETS = 32
#: Batches and buckets that one task works through, one after the other.
TASK_BATCHES, TASK_BUCKETS = 8, 4


@dataclass(frozen=True)
class Plan:
    """How a corpus is dealt: bytes of a batch, number of buckets, and of partitions for either."""

    batch_bytes: int
    buckets: int
    batch_parts: int
    bucket_parts: int

    @classmethod
    def of(cls, text_bytes: int, shuffle_partitions: int) -> Plan:
        grown = max(1.0, math.sqrt(text_bytes * ENTRY_BYTES * MESSAGE_ENTRIES / (BATCH_BYTES * BUCKET_BYTES)))
        batch, bucket = int(BATCH_BYTES * grown), int(BUCKET_BYTES * grown)
        buckets = max(MIN_BUCKETS, math.ceil(text_bytes / bucket))
        few = max(1, min(shuffle_partitions, text_bytes >> 20))
        return cls(batch, buckets, max(few, math.ceil(text_bytes / batch / TASK_BATCHES)), max(min(few, buckets), math.ceil(buckets / TASK_BUCKETS)))

    def messages(self, text_bytes: int) -> int:
        """Most messages that one pass sends over a corpus of so many bytes."""
        return math.ceil(text_bytes / self.batch_bytes) * self.buckets


def plan(docs: DataFrame, text: str = "text") -> Plan:
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return Plan.of(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def stable(docs: DataFrame) -> DataFrame:
    """The same rows in an order that a task run again repeats."""
    return cut(docs, "stable") if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def runs(batches, how: Plan, text: str):
    """Numbers and tables of the batches that the rows of a task form, in order."""
    task, number = TaskContext.get().partitionId() << 32, 0
    held, size, n = [], 0, 0
    for piece in pieces(batches, text, min(1 << 20, how.batch_bytes // 4), BATCH_ROWS // 4):
        own = piece.column(text).nbytes
        if held and (size + own > how.batch_bytes or n + len(piece) > BATCH_ROWS):
            yield task + number, pa.Table.from_batches(held)
            held, size, n, number = [], 0, 0, number + 1
        held.append(piece)
        size, n = size + own, n + len(piece)
    if held:
        yield task + number, pa.Table.from_batches(held)


def batched(docs: DataFrame, how: Plan, text: str) -> DataFrame:
    """(_batch, part, rows): all columns of the documents in compressed batches, each in parts that the JVM holds with ease; see ``rows``."""

    def deal(batches):
        for number, table in runs(batches, how, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(table.combine_chunks())
            data = sink.getvalue().to_pybytes()
            parts = [data[at : at + PART_BYTES] for at in range(0, len(data), PART_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["_batch", "part", "rows"])

    return docs.mapInArrow(deal, "_batch long, part int, rows binary")


def dealt(docs: DataFrame, how: Plan, text: str) -> DataFrame:
    """The batches where their passes run."""
    return batched(docs, how, text).repartition(how.batch_parts, "_batch")


def rows(messages: pa.Table) -> pa.Table:
    """The documents of a batch, from its parts."""
    parts = messages.select(["part", "rows"]).sort_by("part").column("rows").to_pylist()
    return pa.ipc.open_stream(b"".join(parts)).read_all()


def _squeeze(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _spread(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=size), np.uint8)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Values as byte planes, which compress well, after the number of values and their width."""
    return len(values).to_bytes(8, "little") + bytes([width]) + _squeeze(np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def _values(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    if not n:
        return np.zeros(0, f"<u{width}")
    return np.ascontiguousarray(_spread(blob[9:], n * width).reshape(width, n).T).view(f"<u{width}").ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned values by their differences."""
    d = np.diff(values.astype(U64), prepend=U64(0))
    return _planes(d, 8 if d.size and d.max() >= 1 << 32 else 4)


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_values(blob).astype(U64), dtype=U64)


def pack_counts(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values."""
    return _planes(values, 4)


def pack_longs(values: np.ndarray) -> bytes:
    """Signed 64-bit values."""
    return _planes(values.view(U64), 8)


unpack_counts = _values


def unpack_longs(blob: bytes) -> np.ndarray:
    return _values(blob).view(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(LOW_BITS)) % U64(buckets)).astype(np.int32)
