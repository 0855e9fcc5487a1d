"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes holds rows with a sign: +1 for a document (or a revised count of it) that now counts, -1 for one
that no longer does.  A batch is added up by (source, lang, tokenizer) before it is stored, so the store grows by
the groups it touches, not by documents, and totals are the sums of the stored deltas: inserts, deletes and
revisions in any order give the totals of the documents that remain.

Commits are idempotent: a batch is written under a fresh name and then claimed by one small file named after its
batch id, which the store creates only if it is not there.  Readers see claimed batches alone, so a batch that is
retried, run twice or half written counts once or not at all; a claim that a crash left without its content is
written anew by the retry.  ``compact`` folds the claimed batches into one snapshot that names the batch ids it
holds; those stay known, so that they cannot be applied again.

Texts are counted once: ``counted`` gives a narrow table of counts by document and version of its text, from which
any number of batches are made.

Defined results: null sources, languages and texts are values of their own, a null text counting 0 tokens; groups
whose documents all went are left out of the totals; an empty batch commits and changes nothing; repeated rows
count as often as they come; extra columns play no part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SNAPSHOT = "snapshot"
#: Where a store keeps its claims, and the mark that closes it.
CLAIMS, CLOSED = "claims", "closed"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
Counter = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quarter_tokens(text: Column) -> Column:
    """A token for each four bytes begun: the usual estimate without a vocabulary."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def bpe_tokens(spark: SparkSession, vocabulary: str, pattern: str) -> Counter:
    """Tokens of a byte-level BPE whose ranks the file ``vocabulary`` holds (base64 token and rank a line).

    The driver reads the file, of a few megabytes, and broadcasts the ranks.
    """
    import base64

    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def count(texts):
        import pyarrow as pa
        import tiktoken

        coder = tiktoken.Encoding("rollup", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for part in texts:
            yield pa.array([len(coder.encode_ordinary(t)) if t else 0 for t in part.to_pylist()], pa.int64())

    import pyarrow
    from collections.abc import Iterator

    count.__annotations__ = {"texts": Iterator[pyarrow.Array], "return": Iterator[pyarrow.Array]}
    return lambda text: F.arrow_udf(count, "long")(text)


class StoreClosed(Exception):
    """The store is compacted into another one, which takes its batches from then on."""


class TokenRollup:
    """A store of committed deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, counters: dict[str, Counter]):
        self.spark, self.path, self.counters = spark, path.rstrip("/"), counters
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def counted(self, docs: DataFrame, id_col: str = "doc_id", **versions: Column | str) -> DataFrame:
        """(_id, source, lang, and a list of counts for each version): ``versions`` are texts, the column ``text`` if none is named."""
        counts = lambda text: F.array(*(F.struct(F.lit(name).alias("tokenizer"), count(F.col(text) if isinstance(text, str) else text).alias("tokens")) for name, count in self.counters.items()))
        own = [counts(text).alias(name) for name, text in (versions or {"text": "text"}).items()]
        return docs.select(F.col(id_col).alias("_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *own)

    def changes(self, counted: DataFrame, sign: int, version: str = "text", among: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
        """Signed rows (source, lang, tokenizer, docs, tokens) for documents: one for each tokenizer version.

        ``among`` restricts them to the ids it holds.
        """
        rows = counted if among is None else counted.join(among.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
        return rows.select("source", "lang", F.explode(version).alias("c")).select("source", "lang", "c.tokenizer", F.lit(sign).cast("long").alias("docs"), (sign * F.col("c.tokens")).alias("tokens"))

    def revision(self, counted: DataFrame, before: str, after: str, among: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
        """Signed rows that replace one version of documents by another."""
        return self.changes(counted, -1, before, among, id_col).unionByName(self.changes(counted, 1, after, among, id_col))

    def _name(self, batch_id: str) -> str:
        return self.spark._jvm.java.util.UUID.nameUUIDFromBytes(bytearray(batch_id.encode())).toString()

    def _content(self, name: str, folder: str = CLAIMS) -> dict[str, str] | None:
        """What a claim holds: nothing if it is not there, or was left half written."""
        path = self._path(f"{self.path}/{folder}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _claims(self) -> dict[str, str]:
        """Batch ids committed since the last compaction, and those its snapshot names, with the folder that holds each."""
        if not self._fs.exists(self._path(f"{self.path}/claims")):
            return {}
        out = {}
        for (text,) in self.spark.read.text(f"{self.path}/claims", wholetext=True).collect():
            try:
                out |= json.loads(text)
            except ValueError:
                continue
        return out

    def _claim(self, name: str, content: dict[str, str], folder: str = CLAIMS) -> bool:
        """Create a claim unless a whole one is there; False if it is."""
        path, exists = self._path(f"{self.path}/{folder}/{name}"), "FileAlreadyExists"
        try:
            stream = self._fs.create(path, False)
        except Exception as e:  # the store's own refusal decides, not a look beforehand
            if exists not in str(e):
                raise
            if self._content(name, folder) is not None:
                return False
            stream = self._fs.create(path, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def _refuse_closed(self) -> None:
        told = self._content(CLOSED, CLOSED)
        if told is not None:
            raise StoreClosed(f"{self.path} is compacted into {told['next']}: apply the batch there, which takes it once")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False, and nothing changes, if its id has been committed before.

        Raises ``StoreClosed`` if a compaction has begun before the batch was committed, or while it was.  The batch is
        then to be applied to the store that the error names, which knows whether it has it already.
        """
        self._refuse_closed()
        if self._content(self._name(batch_id)) is not None or batch_id in (self._content(SNAPSHOT) or {}):
            return False
        place = f"deltas/{uuid.uuid4().hex}"
        added = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        added.where("docs <> 0 OR tokens <> 0").write.parquet(f"{self.path}/{place}")
        done = self._claim(self._name(batch_id), {batch_id: place})
        self._refuse_closed()  # a compaction may or may not have seen the claim
        return done

    def deltas(self, claims: dict[str, str] | None = None) -> DataFrame:
        """The rows of all committed batches, or of those that ``claims`` names."""
        places = sorted({p for p in (self._claims() if claims is None else claims).values() if p})
        reader = self.spark.read.schema(DELTA)
        return reader.parquet(*(f"{self.path}/{p}" for p in places)) if places else self.spark.createDataFrame([], DELTA)

    def totals(self, claims: dict[str, str] | None = None) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of the documents that remain."""
        return self.deltas(claims).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> TokenRollup:
        """A store in a fresh folder whose one snapshot stands for all batches committed here, their ids kept.

        This store is closed first, so a batch whose commit meets the compaction is sent on to the new store.  Its
        snapshot holds just the batches that it names.  A compaction that broke off is taken up by the next one.
        """
        self._claim(CLOSED, {"next": f"{self.path}-{uuid.uuid4().hex[:8]}"}, CLOSED)
        new = TokenRollup(self.spark, self._content(CLOSED, CLOSED)["next"], self.counters)
        if new._content(SNAPSHOT) is None:
            claims, place = self._claims(), f"deltas/snapshot-{uuid.uuid4().hex[:8]}"
            self.totals(claims).write.parquet(f"{new.path}/{place}")
            new._claim(SNAPSHOT, dict.fromkeys(claims, place))
        return new
