"""Matrix Market coordinate files as a Python data source.

``spark.dataSource.register(MtxDataSource)`` makes the format ``mtx``: (i, j, v), 0-based.  The driver reads the head
of each file; partitions are byte ranges of the entry lines, parsed in blocks of 1 MB into Arrow batches.  Symmetric files
are expanded, with changed sign for skew-symmetric ones; explicit zeros are kept unless ``zeros=false``; pattern
files hold ones, or seeded random values with ``pattern=rand``.  Comparisons of i, j and v with numbers are pushed into
the reader.

Written matrices are folders named ``.mtx`` of files that each have a head of their own, with the whole shape and the
file's own number of entries.  Tasks write beside the folder's files; the commit moves what they wrote, and deletes
what other attempts have left.  Readers take such a folder for one matrix.  A comment in each head tells the rows and
columns its entries span, and files that a pushed condition excludes are not opened again.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lattica.errors import InvalidFile, InvalidFileFormat
from lattica.types import CooMatrix, CsrMatrix

SCHEMA = "i bigint, j bigint, v double"
BANNER = "%%MatrixMarket"
#: Words of the banner.
FIELDS, SYMMETRIES = ("real", "integer", "pattern"), ("general", "symmetric", "skew-symmetric", "hermitian")
RANGE_BYTES = 32 << 20
#: Bytes of a range that are parsed, and entries that are written, at once.
BLOCK_BYTES, BLOCK_LINES = 1 << 20, 1 << 16
#: Entries of a written file, at most, and where files lie until they are committed.
FILE_ENTRIES, STAGED = 1 << 20, "_staged"
#: What a comment with the spans of a file's lines begins with; rows and columns in it count from 0.
SPANS = b"%spans "


@dataclass(frozen=True)
class MtxHeader:
    """Shape and kind of a file; ``nnz`` counts a symmetric file's entries twice, as the bound it is.

    ``spans`` are the first and last row and the first and last column of its lines, if a comment tells them.
    """

    m: int
    n: int
    nnz: int
    field: str
    symmetry: str
    begin: int
    spans: tuple[int, int, int, int] | None = None

    @property
    def sign(self) -> int:
        return {"general": 0, "skew-symmetric": -1}.get(self.symmetry, 1)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_header(path: str) -> MtxHeader:
    """The head of a file: banner, comments, size line."""
    from pyarrow import fs

    if not path.endswith(".mtx"):
        raise InvalidFile(f"{path}: not named .mtx")
    where, own = _store(path)
    if where.get_file_info(own).type != fs.FileType.File:
        raise InvalidFile(f"{path}: no such file")
    with where.open_input_file(own) as f:
        return _header(f, path)


def _header(f, path: str) -> MtxHeader:
    data, lines = b"", []
    while True:
        more = f.read(1 << 16)
        data += more
        lines = data.split(b"\n")
        whole = lines if not more else lines[:-1]
        size = next((k for k, x in enumerate(whole) if k and x.strip() and not x.lstrip().startswith(b"%")), None)
        if size is not None or not more:
            break
    words = lines[0].decode("utf-8", "replace").split()
    if len(words) != 5 or words[0] != BANNER:
        raise InvalidFileFormat(f"{path}: no banner of five words")
    kind, layout, field, symmetry = (w.lower() for w in words[1:])
    symmetry = "skew-symmetric" if symmetry == "skew" else symmetry
    if kind != "matrix" or layout != "coordinate" or field not in FIELDS or symmetry not in SYMMETRIES:
        raise InvalidFileFormat(f"{path}: {' '.join(words[1:])} is not supported")
    numbers = lines[size].split() if size is not None else []
    if len(numbers) != 3 or not all(x.isdigit() for x in numbers):
        raise InvalidFileFormat(f"{path}: no size line of three numbers")
    m, n, nnz = map(int, numbers)
    told = next((x[len(SPANS) :].split() for x in lines[1:size] if x.startswith(SPANS)), ())
    spans = tuple(int(x) for x in told) if len(told) == 4 and all(x.isdigit() for x in told) else None
    return MtxHeader(m, n, nnz * (1 if symmetry == "general" else 2), field, symmetry, min(sum(len(x) + 1 for x in lines[: size + 1]), len(data)), spans)


def _lines(f, begin: int, end: int, body: int) -> Iterator[bytes]:
    """The lines that begin in a range of bytes, whole, in blocks; a line that began before belongs to the range before."""
    at, rest, whole = max(begin - 1, 0), b"", begin == 0
    f.seek(at)
    while at < end and (data := f.read(min(BLOCK_BYTES, end - at))):
        at += len(data)
        rest += data
        if not whole:
            cut = rest.find(b"\n") if begin > body else 0
            rest, whole = rest[cut + 1 :] if cut >= 0 else b"", cut >= 0
        cut = rest.rfind(b"\n") + 1
        if whole and cut:
            yield rest[:cut]
            rest = rest[cut:]
    if whole and rest:
        while more := f.read(4096):
            cut = more.find(b"\n")
            rest += more if cut < 0 else more[: cut + 1]
            if cut >= 0:
                break
        yield rest


class Range(D.InputPartition):
    def __init__(self, path: str, begin: int, end: int, header: MtxHeader):
        super().__init__((path, begin, end, header))


class MtxReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.zeros = options["path"], options.get("zeros", "true").lower() != "false"
        self.pattern, self.seed = options.get("pattern", "one"), int(options.get("seed", 42))
        self.range_bytes, self.where, self.skipped = int(options.get("range_bytes", RANGE_BYTES)), [], 0

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Comparisons with numbers are judged as entries are read; all others are left to Spark."""
        kinds = {D.EqualTo: "equal", D.GreaterThan: "greater", D.GreaterThanOrEqual: "greater_equal", D.LessThan: "less", D.LessThanOrEqual: "less_equal"}
        for f in filters:
            name = kinds.get(type(f))
            # NaN is the largest value to Spark and none to numpy, so conditions on v count as numpy has them only where NaN fails both
            if name and len(f.attribute) == 1 and type(f.value) in (int, float) and (f.attribute[0] != "v" or name.startswith(("less", "equal")) and f.value == f.value):
                self.where.append((f.attribute[0], name, f.value))
            elif not (isinstance(f, D.IsNotNull) and len(f.attribute) == 1):  # no column holds nulls
                yield f

    def _excluded(self, head: MtxHeader) -> bool:
        """Whether no line of a file, nor its mirror image, can meet the conditions."""
        if head.spans is None:
            return False
        i, j = head.spans[:2], head.spans[2:]
        ways = [{"i": i, "j": j}] + ([{"i": j, "j": i}] if head.sign else [])
        able = {"equal": lambda lo, hi, x: lo <= x <= hi, "greater": lambda lo, hi, x: hi > x, "greater_equal": lambda lo, hi, x: hi >= x, "less": lambda lo, hi, x: lo < x, "less_equal": lambda lo, hi, x: lo <= x}
        return not any(all(able[name](*way[c], x) for c, name, x in self.where if c in way) for way in ways)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        where, own = _store(self.path)
        info = where.get_file_info(own)
        if info.type == fs.FileType.Directory:
            found = _files(where, own)
        elif info.type == fs.FileType.File:
            found = [info]
        else:
            raise InvalidFile(f"{self.path}: no such file")
        out = []
        for i in sorted(found, key=lambda i: i.path):
            if not i.path.endswith(".mtx"):
                raise InvalidFile(f"{i.path}: not named .mtx")
            with where.open_input_file(i.path) as f:
                head = _header(f, i.path)
            if self._excluded(head):
                self.skipped += 1
                continue
            out += [Range(i.path, at, min(at + self.range_bytes, i.size), head) for at in range(head.begin, i.size, self.range_bytes)]
        return out or [Range("", 0, 0, MtxHeader(0, 0, 0, "real", "general", 0))]

    def read(self, partition: Range):
        import numpy as np
        import pyarrow as pa

        path, begin, end, head = partition.value
        if begin >= end:
            return
        where, _ = _store(self.path)
        width, drawn = 2 if head.field == "pattern" else 3, np.random.default_rng((self.seed, begin))
        with where.open_input_file(path) as f:
            for data in _lines(f, begin, end, head.begin):
                lines = [x for x in data.split(b"\n") if x.strip() and not x.lstrip().startswith(b"%")]
                cells = np.array([x.split()[:width] for x in lines], dtype=np.bytes_).reshape(-1, width)
                i, j = cells[:, 0].astype(np.int64) - 1, cells[:, 1].astype(np.int64) - 1
                if width == 3:
                    v = cells[:, 2].astype(np.float64)
                else:
                    v = np.ones(len(i)) if self.pattern == "one" else drawn.random(len(i))
                keep = slice(None) if self.zeros else v != 0
                i, j, v = i[keep], j[keep], v[keep]
                if head.sign:
                    off = i != j
                    i, j, v = np.concatenate((i, j[off])), np.concatenate((j, i[off])), np.concatenate((v, head.sign * v[off]))
                if self.where:
                    columns = {"i": i, "j": j, "v": v}
                    ok = np.logical_and.reduce([getattr(np, name)(columns[c], x) for c, name, x in self.where])
                    i, j, v = i[ok], j[ok], v[ok]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])


@dataclass
class Written(D.WriterCommitMessage):
    names: list[str]


class MtxWriter(D.DataSourceArrowWriter):
    """Options: ``m``, ``n``, ``field``, ``symmetry``, ``file_entries``."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.attempt = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.m, self.n, self.field, self.symmetry = int(options["m"]), int(options["n"]), options.get("field", "real"), options.get("symmetry", "general")
        self.file_entries = int(options.get("file_entries", FILE_ENTRIES))
        if not self.path.endswith(".mtx"):
            raise InvalidFile(f"{self.path}: not named .mtx")
        if self.field not in FIELDS or self.symmetry not in SYMMETRIES:
            raise InvalidFileFormat(f"{self.path}: {self.field} {self.symmetry} is not supported")

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa

        where, path = _store(self.path)
        where.create_dir(f"{path}/{STAGED}-{self.attempt}", recursive=True)
        names, held, n = [], [], 0
        for batch in iterator:
            for at in range(0, len(batch), self.file_entries):
                piece = batch.slice(at, self.file_entries)
                if n + len(piece) > self.file_entries:
                    names.append(self._file(where, path, pa.Table.from_batches(held)))
                    held, n = [], 0
                held.append(piece)
                n += len(piece)
        if n:
            names.append(self._file(where, path, pa.Table.from_batches(held)))
        return Written(names)

    def _head(self, entries: int, spans: tuple[int, ...] = ()) -> bytes:
        told = SPANS.decode() + " ".join(map(str, spans)) + "\n" if spans else ""
        return f"{BANNER} matrix coordinate {self.field} {self.symmetry}\n{told}{self.m} {self.n} {entries}\n".encode()

    def _file(self, where, path: str, table) -> str:
        import pyarrow as pa
        import pyarrow.compute as pc

        text = lambda c: c.cast(pa.large_string())
        name = f"part-{uuid.uuid4().hex}.mtx"
        with where.open_output_stream(f"{path}/{STAGED}-{self.attempt}/{name}", compression=None) as f:
            f.write(self._head(len(table), tuple(x for c in "ij" for x in pc.min_max(table.column(c)).as_py().values())))
            for at in range(0, len(table), BLOCK_LINES):
                piece = table.slice(at, BLOCK_LINES).combine_chunks()
                columns = [text(pc.add(piece.column(c).combine_chunks().cast(pa.int64()), 1)) for c in "ij"]
                if self.field != "pattern":
                    v = piece.column("v").combine_chunks()
                    columns.append(text(v.cast(pa.int64()) if self.field == "integer" else v.cast(pa.float64())))
                lines = pc.binary_join_element_wise(*columns[:-1], pc.binary_join_element_wise(columns[-1], pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())), pa.scalar(" ", pa.large_string()))
                f.write(lines.buffers()[2] or b"")
        return name

    def commit(self, messages: list[Written | None]) -> None:
        where, path = _store(self.path)
        where.create_dir(f"{path}/{STAGED}-{self.attempt}", recursive=True)
        names = [n for m in messages if m for n in m.names]
        if not names:  # a matrix without entries has a head all the same
            names = [f"part-{uuid.uuid4().hex}.mtx"]
            with where.open_output_stream(f"{path}/{STAGED}-{self.attempt}/{names[0]}", compression=None) as f:
                f.write(self._head(0))
        before = [i.path for i in _files(where, path)] if self.overwrite else []
        for name in names:
            where.move(f"{path}/{STAGED}-{self.attempt}/{name}", f"{path}/{name}")
        for name in before:
            where.delete_file(name)
        where.delete_dir(f"{path}/{STAGED}-{self.attempt}")

    def abort(self, messages: list[Written | None]) -> None:
        where, path = _store(self.path)
        where.delete_dir(f"{path}/{STAGED}-{self.attempt}")


class MtxDataSource(D.DataSource):
    """Matrix Market coordinate files."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MtxReader:
        return MtxReader(self.options)

    def writer(self, schema, overwrite: bool) -> MtxWriter:
        return MtxWriter(self.options, overwrite)


def _files(where, folder: str) -> list:
    """The committed files named .mtx in a folder and the folders below it."""
    from pyarrow import fs

    found = where.get_file_info(fs.FileSelector(folder, recursive=True))
    return [i for i in found if i.type == fs.FileType.File and i.path.endswith(".mtx") and f"/{STAGED}-" not in i.path]


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for module in (sys.modules[__name__], sys.modules["lattica.errors"]):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(MtxDataSource)


def list_matrices(path: str) -> dict[str, MtxHeader]:
    """The heads of a file, or of all matrices in a folder and the folders below it, by path in name order.

    Files of a folder that is named .mtx itself are parts of one matrix, which has the folder's path and the sum of
    their entries.
    """
    from pyarrow import fs

    where, own = _store(path)
    kind = where.get_file_info(own).type
    if kind == fs.FileType.File:
        return {path: read_header(path)}
    if kind != fs.FileType.Directory:
        raise InvalidFile(f"{path}: no such file")
    scheme = path[: path.index(own)] if own in path else "file://"
    out: dict[str, MtxHeader] = {}
    for p in (f"{scheme}{i.path}" for i in sorted(_files(where, own), key=lambda i: i.path)):
        head, folder = read_header(p), p.rsplit("/", 1)[0]
        name = folder if folder.endswith(".mtx") else p
        before = out.get(name)
        if before and (before.m, before.n, before.field, before.symmetry) != (head.m, head.n, head.field, head.symmetry):
            raise InvalidFileFormat(f"{p}: unlike the other parts of {name}")
        out[name] = replace(head, nnz=head.nnz + (before.nnz if before else 0))
    return out


def read_folder(spark: SparkSession, path: str, zeros: bool = True, pattern: str = "one", seed: int = 42, dup: str = "keep") -> dict[str, CooMatrix]:
    """Every matrix of a folder, by path; each a plan that reads nothing until it is used."""
    return {p: read_coo(spark, p, zeros, pattern, seed, dup) for p in list_matrices(path)}


def read_coo(spark: SparkSession, path: str, zeros: bool = True, pattern: str = "one", seed: int = 42, dup: str = "keep") -> CooMatrix:
    """The entries of one file or written folder; equal coordinates stay apart unless ``dup='sum'``.

    Spark 4.1 keeps the filters last pushed down with a loaded frame; the condition makes every query push its own.
    """
    head = _head_of(path)
    register(spark)
    df = spark.read.format("mtx").options(zeros=str(zeros).lower(), pattern=pattern, seed=seed).load(path).where("i >= 0")
    return CooMatrix.from_entries(df, "i", "j", "v", head.m, head.n, dup)


def _head_of(path: str) -> MtxHeader:
    """The head of a file, or of the matrix that a written folder holds."""
    from pyarrow import fs

    where, own = _store(path.rstrip("/"))
    if where.get_file_info(own).type != fs.FileType.Directory:
        return read_header(path)
    heads = list_matrices(path.rstrip("/"))
    if len(heads) != 1:
        raise InvalidFile(f"{path}: {len(heads)} matrices")
    return next(iter(heads.values()))


def save(a: CooMatrix, path: str, field: str = "real", symmetry: str = "general", mode: str = "append", ranged: bool = False, **options) -> None:
    """Write a matrix as a folder named .mtx that ``read_coo`` and ``read_folder`` take for one matrix.

    With ``ranged`` each file holds a range of rows, so that conditions on rows leave the other files unread.

    Of a symmetric matrix the entries on and below the diagonal are written, of a skew-symmetric one those below it.
    Integer fields cut values to whole numbers; patterns leave them out.
    """
    register(a.df.sparkSession)
    own = {"general": "true", "skew-symmetric": "i > j"}.get(symmetry, "i >= j")
    held = a.df.where(own).select("i", "j", "v")
    held = held.repartitionByRange("i", "j").sortWithinPartitions("i", "j") if ranged else held
    held.write.format("mtx").options(m=a.m, n=a.n, field=field, symmetry=symmetry, **options).mode(mode).save(path)


def read_csr(spark: SparkSession, path: str, zeros: bool = True, pattern: str = "one", seed: int = 42) -> CsrMatrix:
    from lattica.operators.convert import coo2csr

    return coo2csr(read_coo(spark, path, zeros, pattern, seed, dup="keep"))


def write_mtx(a: CooMatrix, path: str) -> None:
    """A folder of one head and many entry parts, in Spark's text format; ``cat`` in name order gives one file."""
    lines = a.df.select(F.format_string("%d %d %s", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("string")).alias("value"))
    a.df.sparkSession.createDataFrame([(f"{BANNER} matrix coordinate real general\n{a.m} {a.n} {a.df.count()}",)], "value string").coalesce(1).write.text(f"{path}/0-head")
    lines.write.text(f"{path}/1-entries")
