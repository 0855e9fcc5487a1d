"""WARC archives as a PySpark Python data source, with revisit records for equal payloads.

``register`` makes the format ``warc`` known, ``load`` reads it.  Reading plans partitions of about
``partition_bytes``: small files together, compressed ones in ranges, of which each reads the gzip members that begin
in it, plain ones whole.  It takes over filters on the record type and on headers, parses the headers of a record
first and passes over the rest of one that is not wanted; ``payload=false`` passes over all payloads.  Compressed
archives hold one gzip member a record with its length in an extra field, so unwanted ones are not inflated beyond
their headers.  Members without the field, which may hold any number of records, are inflated chunk by chunk, and an
unwanted block is passed over in such chunks.  Writing rolls files at ``file_bytes`` and names each attempt's files
afresh; the driver commits each write by a manifest of its own, and readers of a folder with manifests see no others.

Files are reached by pyarrow's file systems, on whatever store they know.  The module refers to no other of the
package, so that it travels to Spark's planner by value.

Defined results: null payloads are written as empty; null ids and addresses are headers left out, read as null;
line breaks in header values are percent-encoded; a header that a record lacks is null and matches no filter but
``IS NULL``; a folder without archives, and an archive of an empty table, give an empty table; a file cut short
yields its whole records; extra columns of pages play no part.
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, payload_length long, payload binary, headers map<string,string>"
WRITTEN = ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to", "payload_length", "payload")
#: Header names of the format, by column.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Each commit leaves a manifest of its own, so that writers at one time don't undo one another's.
MANIFEST = "_committed-"
HEAD_BYTES = 2048
#: Fixed value: how a gzip member begins.
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"


def store(path: str):
    """File system and path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def encode(record: dict) -> bytes:
    """A record in bytes: an HTTP response with its body, or of a revisit its head alone."""
    body = record["payload"] or b""
    length = record["payload_length"] if record["payload_length"] is not None else len(body)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (body if record["record_type"] != "revisit" else b"")
    digest = record["payload_digest"] and "sha1:" + b32encode(bytes.fromhex(record["payload_digest"])).decode()
    values = {HEADERS[k]: record[k] for k in ("record_type", "record_id", "target_uri", "date", "refers_to")} | {HEADERS["payload_digest"]: digest}
    if record["record_type"] == "revisit":
        values["WARC-Profile"] = PROFILE
    values |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in values.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END + block + END


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length and that of its content in the extra field ``sl``."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    raw = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(raw) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + raw + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def parse_head(data: bytes) -> dict[str, str]:
    """Headers of a record by lower-case name; lines that go on are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def columns_of(head: dict[str, str]) -> dict:
    row = {k: head.get(v.lower()) for k, v in HEADERS.items()}
    for k in ("record_id", "refers_to"):
        row[k] = row[k].strip("<>") if row[k] else row[k]
    digest = row["payload_digest"]
    if digest:
        kind, _, value = digest.rpartition(":")
        row["payload_digest"] = b32decode(value.upper()).hex() if len(value) == 32 and kind in ("sha1", "") else value.lower()
    return row | {"content_length": int(head["content-length"]) if head.get("content-length", "").isdigit() else None}


class Records:
    """The records of one file: heads first, blocks of the wanted ones only."""

    def __init__(self, file, size: int, begin: int = 0, end: int | None = None):
        self.file, self.size, self.begin, self.end = file, size, begin, size if end is None else end

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        """Headers of each record, with a function of it, to be called before the next is asked for.

        The function returns the block, or with ``keep=False`` passes over it; None of a record cut short.
        """
        self.file.seek(0)
        zipped = self.file.read(2) == MAGIC[:2]
        at = self.begin if not self.begin else self._member(self.begin)
        while at < self.end:
            step = self._zipped(at) if zipped else self._plain(at)
            if step is None:
                return
            if step == "stream":
                yield from self._stream(at)
                return
            head, block, at = step
            yield head, block

    def _member(self, at: int) -> int:
        """Where the first member begins at a place or after it that holds a record; the range's end if none does."""
        while at < self.end:
            data = self._read(at, 1 << 20)
            found = data.find(MAGIC)
            while found >= 0 and at + found < self.end:
                head = data[found : found + HEAD_BYTES] if found + HEAD_BYTES <= len(data) else self._read(at + found, HEAD_BYTES)
                try:
                    if zlib.decompressobj(31).decompress(head, 16).startswith(b"WARC/"):
                        return at + found
                except zlib.error:
                    pass
                found = data.find(MAGIC, found + 1)
            if len(data) < 1 << 20:
                break
            at += len(data) - len(MAGIC) + 1
        return self.end

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _plain(self, at: int):
        data, want = b"", HEAD_BYTES
        while END not in data:
            data = self._read(at, want)
            if END not in data and at + want >= self.size:
                return None
            want *= 2
        head = data[: data.index(END)]
        begin = at + len(head) + 4
        fields = parse_head(head)
        n = int(fields.get("content-length", 0))
        return (fields, lambda keep=True: self._read(begin, n) if keep else b"", begin + n + 4) if begin + n <= self.size else None

    def _zipped(self, at: int):
        start = self._read(at, HEAD_BYTES)
        size = skip = None
        if len(start) >= 24 and start[3] & 4:
            size = int.from_bytes(start[16:20], "little") if start[12:14] == b"sl" else None
            skip = 12 + int.from_bytes(start[10:12], "little")
        if size is None or at + size > self.size:
            return "stream" if size is None else None
        z = zlib.decompressobj(-15)
        data, done = z.decompress(start[skip:size]), min(len(start), size)
        while END not in data and done < size:
            more = self._read(at + done, min(HEAD_BYTES, size - done))
            data, done = data + z.decompress(more), done + len(more)
        if END not in data:
            return None
        fields = parse_head(data[: data.index(END)])

        def block(keep: bool = True) -> bytes:
            if not keep:
                return b""
            whole = data + z.decompress(self._read(at + done, size - done - 8)) if done < size - 8 else data
            begin = whole.index(END) + 4
            return whole[begin : begin + int(fields.get("content-length", 0))]

        return fields, block, at + size

    def _stream(self, at: int):
        """Records of members that don't tell their length, any number in each: inflated in turn, unwanted blocks in passing."""
        inflated = Inflated(self.file, at, self.end)
        while (head := inflated.head()) is not None:
            fields = parse_head(head)
            size, passed = int(fields.get("content-length", 0)), []

            def block(keep: bool = True, size: int = size, passed: list = passed) -> bytes | None:
                passed.append(True)
                return inflated.take(size) if keep else b"" if inflated.skip(size) else None

            yield fields, block
            if not passed:
                block(keep=False)
            inflated.skip(len(END))


class Inflated:
    """What consecutive gzip members hold, read on and never kept: at most a chunk, or the record that is asked for."""

    def __init__(self, file, at: int, end: int, chunk: int = 1 << 16):
        self.file, self.at, self.end, self.chunk, self.left, self.z, self.held = file, at, end, chunk, b"", None, bytearray()

    def _more(self) -> bool:
        """Append what a chunk of the file inflates to; False at the end of the file, or of the members that begin in the range."""
        if not self.left:
            self.file.seek(self.at)
            self.left = self.file.read(self.chunk)
            self.at += len(self.left)
            if not self.left:
                return False
        if self.z is None:
            if self.at - len(self.left) >= self.end:
                return False  # a member that another range owns
            if not self.left.startswith(b"\x1f") and not self.left.strip(b"\0"):
                self.left = b""  # padding after the last member
                return True
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(self.left, self.chunk)
        self.left = self.z.unconsumed_tail
        if self.z.eof:
            self.left, self.z = self.z.unused_data, None
        return True

    def head(self) -> bytes | None:
        """The next record's head, or None where no whole one follows."""
        seen = 0
        while (end := self.held.find(END, max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self._more():
                return None
        head = bytes(self.held[:end])
        del self.held[: end + 4]
        return head

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            if not self._more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> bool:
        """Pass over n bytes; False if there are fewer."""
        while n > 0:
            if not self.held and not self._more():
                return False
            step = min(n, len(self.held))
            del self.held[:step]
            n -= step
        return True


def _manifests(where, path: str) -> list[str]:
    from pyarrow import fs

    there = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [i.path for i in there if i.path.rsplit("/", 1)[-1].startswith(MANIFEST)]


def split_http(head: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Body of the block's HTTP message, and the length its head names; of other blocks all."""
    if "application/http" not in head.get("content-type", "") or END not in block:
        return block, len(block)
    first, _, body = block.partition(END)
    named = parse_head(first).get("content-length", "")
    return body, int(named) if named.isdigit() else len(body)


@dataclass
class Files(D.InputPartition):
    """Files with the range of each whose members are to be read."""

    parts: list[tuple[str, int, int]] = field(default_factory=list)

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(parts)
        self.parts = parts


@dataclass
class Written(D.WriterCommitMessage):
    names: list[str]


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = type(f).__name__
            if name in HEADERS and kind in ("EqualTo", "In", "StringStartsWith", "StringEndsWith", "StringContains", "IsNotNull", "IsNull"):
                self.tests.append((name, kind, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        does = {"EqualTo": lambda x, v: x == v, "In": lambda x, v: x in v, "StringStartsWith": lambda x, v: x.startswith(v), "StringEndsWith": lambda x, v: x.endswith(v), "StringContains": lambda x, v: v in x, "IsNotNull": lambda x, v: True}
        return all((row[name] is None) if kind == "IsNull" else row[name] is not None and does[kind](row[name], value) for name, kind, value in self.tests)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        where, path = store(self.path)
        if where.get_file_info(path).type == fs.FileType.File:
            return [Files([part]) for part in self._parts(path, where.get_file_info(path).size)]
        found = {i.path: i.size for i in where.get_file_info(fs.FileSelector(path, recursive=True)) if i.path.endswith((".warc", ".warc.gz"))}
        if manifests := _manifests(where, path):
            names = set()
            for m in manifests:
                with where.open_input_stream(m) as f:
                    names |= set(json.loads(f.read()))
            found = {p: n for p, n in found.items() if p.rsplit("/", 1)[-1] in names}
        groups, room = [], 0
        for part in (part for p in sorted(found) for part in self._parts(p, found[p])):
            if room < part[2] - part[1] or not groups:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(part)
            room -= part[2] - part[1]
        return [Files(g) for g in groups] or [Files([])]

    def _parts(self, path: str, size: int) -> list[tuple[str, int, int]]:
        """Ranges of a compressed file; a plain one is a single range, as nothing there tells a record from a payload's text."""
        step = self.partition_bytes if path.endswith(".gz") else max(size, 1)
        return [(path, at, min(at + step, size)) for at in range(0, size, step)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        rows, size = [], 0
        for path, begin, end in partition.parts:
            with where.open_input_file(path) as f:
                for head, block in Records(f, f.size(), begin, end):
                    row = columns_of(head)
                    if not self.wanted(row):
                        continue
                    row |= {"payload": None, "payload_length": None, "headers": head}
                    data = block(keep=self.payload)
                    if data is None:
                        break
                    if self.payload:
                        body, row["payload_length"] = split_http(head, data)
                        row["payload"] = None if row["record_type"] == "revisit" else body
                        size += len(body)
                    rows.append(row)
                    if len(rows) >= 2000 or size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.zipped, self.file_bytes = options.get("compression", "gzip") == "gzip", int(options.get("file_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        names, out, left = [], None, 0
        for data in iterator:
            for record in data.select([c for c in WRITTEN if c in data.schema.names]).to_pylist():
                if out is None or left <= 0:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped)
                    out, left = where.open_output_stream(f"{path}/{names[-1]}", compression=None), self.file_bytes
                raw = encode(dict.fromkeys(WRITTEN) | record)
                raw = member(raw) if self.zipped else raw
                out.write(raw)
                left -= len(raw)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        before = _manifests(where, path) if self.overwrite else []
        with where.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for m in before:
            where.delete_file(m)

    def abort(self, messages: list[Written | None]) -> None:
        where, path = store(self.path)
        for m in messages:
            for n in m.names if m else ():
                where.delete_file(f"{path}/{n}")


class WarcDataSource(D.DataSource):
    """Reads and writes folders of WARC files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """All records of an archive that have a type, as the format demands.

    Spark 4.1 keeps the filters last pushed down with a loaded frame, and a later query of that frame without any
    filter would meet them again; the condition on the type makes every query push its own.
    """
    register(spark)
    return spark.read.format("warc").options(**options).load(path).where(F.col("record_type").isNotNull())


#: Bytes of a group of equal payloads in a broadcast, about.
GROUP_BYTES = 128


class PageArchive:
    """Pages as WARC records; of equal payloads of at least ``min_bytes`` all but the largest id become revisits.

    Of rows that repeat the largest id, the first in the table is the response.  Rows are told apart by their place,
    so ``pages`` must give them in the same order each time, as a table does that is read.
    """

    URN = "urn:x-page:"

    def __init__(self, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", broadcast_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
        self.min_bytes, self.date, self.broadcast_bytes, self.id_col, self.url_col, self.html_col = min_bytes, date, broadcast_bytes, id_col, url_col, html_col

    def records(self, pages: DataFrame, cut) -> DataFrame:
        """The records to write; ``cut`` stores the small table of payload groups."""
        own = pages.select(F.col(self.id_col).cast("long").alias("page_id"), F.col(self.url_col).alias("target_uri"), F.coalesce(self.html_col, F.lit("")).alias("html"), F.monotonically_increasing_id().alias("_place"))
        own = own.withColumns({"payload_length": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html")})
        place = F.struct("page_id", (-F.col("_place")).alias("p"))
        groups = own.where(F.col("payload_length") >= self.min_bytes).groupBy("payload_digest").agg(F.max(place).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top.page_id IS NOT NULL")
        of = cut(groups.select("payload_digest", F.col("top.page_id").alias("first"), (-F.col("top.p")).alias("first_place")), "payloads")
        if of.count() * GROUP_BYTES <= self.broadcast_bytes:  # no payload moves
            joined = own.join(F.broadcast(of), "payload_digest", "left")
        else:  # digests meet their groups without payloads, which then meet the places of the copies, so no digest gathers them
            copies = own.where(F.col("payload_length") >= self.min_bytes).select("_place", "payload_digest").join(of, "payload_digest").select("_place", "first", "first_place")
            joined = own.join(copies, "_place", "left")
        again = F.col("first").isNotNull() & (F.col("_place") != F.col("first_place"))
        urn = lambda c: F.concat(F.lit(f"<{self.URN}"), F.col(c).cast("string"), F.lit(">"))
        return joined.select(urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(self.date).alias("date"), "payload_digest", F.when(again, urn("first")).alias("refers_to"), "payload_length", F.when(~again, F.encode("html", "UTF-8")).alias("payload"))

    def write(self, pages: DataFrame, path: str, cut, **options) -> None:
        register(pages.sparkSession)
        self.records(pages, cut).write.format("warc").options(**options).mode("append").save(path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of the page records of an archive.

        Lengths and digests of responses are those of the payload as read, of revisits those that they state.
        """
        rows = load(spark, path).where(F.col("record_type").isin("response", "revisit"))
        page = lambda c: F.expr(f"try_cast(nullif(substring({c}, {len(self.URN) + 1}), '') AS BIGINT)")
        return rows.select(page("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"), F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
