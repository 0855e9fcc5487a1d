"""Stupid-backoff language-model scores of documents, from n-gram count tables partitioned by hash.

Every document is scored by the counts of all other documents: a word after a context scores count(context word) /
count(context) at the longest context whose n-gram others have, times ``alpha`` for each step backed off; the last
resort is max(count(word), 1) / words of others.  A document's score is the sum of the logarithms.

The n-grams of a batch of documents (see ``exchange``) travel distinct and with counts to the bucket of their hash,
where the count table of that hash range forms, and the totals travel back to join the batch's exploded n-grams.
N-grams of three words and more travel only where both shorter ones inside occur in other documents: if two
documents share the longer one, both send it, and if not, it counts nothing.

Defined results: null texts and texts without words score 0 with 0 words; rows that repeat an id are separate
documents; a lone document meets no counts; an empty table gives an empty result; extra columns play no part.
N-grams are told apart by 52 bits of a hash and its bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import exchange as X
from lattica.llm.shared import cut
from lattica.llm.substring_dedup import _groups, _runs
from lattica.llm.tokens import U64, Words, mix, rolling, window_starts, words

#: Bits of a hash that travel; its bucket, drawn from all 64, tells the rest.
KEY = U64((1 << 52) - 1)
ASKED = "_bucket int, _batch long, size int, keys binary, counts binary"
TOLD = "_batch long, _from int, size int, totals binary"


class Grams:
    """The n-grams of one size at some places of a batch: distinct ones with counts, and what their own documents hold."""

    def __init__(self, w: Words, size: int, at: np.ndarray, buckets: int):
        self.size, self.at = size, at
        h = (mix(w.hash ^ U64(0x2545F4914F6CDD1D)) if size == 1 else rolling(w.hash, size))[at]
        order = np.argsort(h, kind="stable")
        doc = (np.searchsorted(w.first, at, side="right") - 1)[order]
        h = h[order]
        b = _groups(h) if len(h) else np.zeros(1, np.int64)
        own = _groups(h, doc) if len(h) else np.zeros(1, np.int64)
        self.own = np.zeros(len(at), np.int64)
        self.own[order] = np.repeat(np.diff(own), np.diff(own))
        keys, counts = h[b[:-1]], np.diff(b)
        owner = X.bucket_of(mix(keys ^ U64(0xBF58476D1CE4E5B9)), buckets)
        keys = keys & KEY
        by = np.lexsort((keys, owner))
        self.keys, self.counts, self.owner = keys[by], counts[by], owner[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.which = np.zeros(len(at), np.int64)
        self.which[order] = np.repeat(place, np.diff(b))

    def rows(self) -> list[tuple]:
        return [(int(self.owner[i]), self.size, X.pack(self.keys[i:j]), X.pack_counts(self.counts[i:j])) for i, j in _runs(self.owner)]

    def others(self, told: list[dict]) -> np.ndarray:
        """At each place, how often other documents have its n-gram."""
        mine = sorted((t["_from"], t["totals"]) for t in told if t["size"] == self.size)
        beyond = np.concatenate([X.unpack_counts(t) for _, t in mine] or [np.zeros(0, np.uint32)]).astype(np.int64)
        return (beyond + self.counts)[self.which] - self.own


class StupidBackoff:
    """Scores under a model of ``order`` words whose counts are those of all other documents."""

    def __init__(self, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text"):
        if order < 2 or not 0 < alpha <= 1:
            raise ValueError("order is at least 2 and alpha lies in (0, 1]")
        self.order, self.alpha, self.id_col, self.text_col = order, alpha, id_col, text_col

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, score, n_full) of every row; n_full counts the words scored without backing off."""
        order, alpha, id_col, text_col = self.order, self.alpha, self.id_col, self.text_col
        how = X.plan(docs, text_col)
        buckets, dealt = how.buckets, X.dealt(X.stable(docs.select(id_col, text_col)), how, text_col)

        def known(w: Words, told: list[dict], upto: int) -> dict[int, np.ndarray]:
            """Counts of others by size and starting word, -1 where no n-gram starts or both shorter ones aren't shared."""
            out: dict[int, np.ndarray] = {}
            for size in range(1, upto + 1):
                grams = Grams(w, size, places(w, size, out), buckets)
                out[size] = np.full(len(w.hash) + 1, -1)
                out[size][grams.at] = grams.others(told)
            return out

        def places(w: Words, size: int, counts: dict[int, np.ndarray]) -> np.ndarray:
            at = window_starts(w.first, size)
            return at if size < 3 else at[(counts[size - 1][at] > 0) & (counts[size - 1][at + 1] > 0)]

        def ask(sizes: range):
            def run(batch: int, w: Words, told: list[dict]) -> pa.Table:
                counts = known(w, told, sizes[0] - 1)
                rows = [r for size in sizes for r in Grams(w, size, places(w, size, counts), buckets).rows()]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                out = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("_bucket", "size", "keys", "counts"), kinds, strict=True))}
                return pa.table({"_bucket": out["_bucket"], "_batch": pa.array([batch] * len(rows), pa.int64()), "size": out["size"], "keys": out["keys"], "counts": out["counts"]})

            return run

        def count(key: tuple, asked: pa.Table) -> pa.Table:
            blobs = [X.unpack(b) for b in asked.column("keys").to_pylist()]
            counts = [X.unpack_counts(b) for b in asked.column("counts").to_pylist()]
            n = [len(b) for b in blobs]
            keys, counts = np.concatenate(blobs), np.concatenate(counts).astype(np.int64)
            by = np.argsort(keys)
            b = _groups(keys[by])
            total = np.empty(len(keys), np.int64)
            total[by] = np.repeat(np.add.reduceat(counts[by], b[:-1]), np.diff(b))
            beyond, at = np.minimum(total - counts, 2**32 - 1), np.cumsum([0, *n])  # of other batches: mostly none
            told = [X.pack_counts(beyond[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            return pa.table({"_batch": asked.column("_batch"), "_from": pa.array([key[0].as_py()] * len(n), pa.int32()), "size": asked.column("size"), "totals": pa.array(told, pa.binary())})

        def first(key: tuple, batch: pa.Table) -> pa.Table:
            return ask(range(1, 3))(key[0].as_py(), words(X.rows(batch).column(text_col)), [])

        def later(size: int):
            def run(key: tuple, batch: pa.Table, told: pa.Table) -> pa.Table:
                return ask(range(size, size + 1))(key[0].as_py(), words(X.rows(batch).column(text_col)), told.to_pylist())

            return run

        def judge(key: tuple, batch: pa.Table, told: pa.Table) -> pa.Table:
            docs = X.rows(batch)
            w = words(docs.column(text_col))
            counts = known(w, told.to_pylist(), order)
            doc, n = w.doc_of(), len(w.hash)
            place = np.arange(n) - w.first[doc]
            value, level = np.zeros(n), np.zeros(n, np.int64)
            for size in range(order, 1, -1):
                open_ = np.flatnonzero((level == 0) & (place >= size - 1))
                seen = counts[size][open_ - size + 1]
                hit, seen = open_[seen > 0], seen[seen > 0]
                value[hit], level[hit] = np.log(seen / counts[size - 1][hit - size + 1]), size
            rest = level == 0
            value[rest], level[rest] = np.log(np.maximum(counts[1][:n][rest], 1)), 1
            full = np.minimum(place + 1, order)
            value += (full - level) * np.log(alpha)
            add = lambda x: np.bincount(doc, x, minlength=len(w.first) - 1)
            ends = {"part": add(value), "n_words": w.lengths.astype(np.int64), "n_last": add(rest).astype(np.int64), "n_full": add(level == full).astype(np.int64)}
            return pa.table({"doc_id": docs.column(id_col), **{k: pa.array(v) for k, v in ends.items()}})

        met = lambda asked: asked.repartition(how.bucket_parts, "_bucket").groupBy("_bucket").applyInArrow(count, TOLD).repartition(how.batch_parts, "_batch")
        told = met(dealt.groupBy("_batch").applyInArrow(first, ASKED))
        for size in range(3, order + 1):
            asked = dealt.groupBy("_batch").cogroup(told.groupBy("_batch")).applyInArrow(later(size), ASKED)
            told = told.unionByName(met(asked))  # one plan: its shuffles are written once and read again
        kind = docs.schema[id_col].dataType.simpleString()
        judged = cut(dealt.groupBy("_batch").cogroup(told.groupBy("_batch")).applyInArrow(judge, f"doc_id {kind}, part double, n_words long, n_last long, n_full long"), "scores")
        total = judged.agg(F.sum("n_words")).first()[0] or 0
        others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
        return judged.select("doc_id", "n_words", (F.col("part") - F.col("n_last") * F.log(others)).alias("score"), "n_full")

    def score_rows(self, docs: DataFrame) -> DataFrame:
        """The same result with a row for each n-gram, in DataFrame functions alone.

        Counts of each size are a table by hash of the n-gram, the documents' exploded n-grams join them and their
        own counts, and each document is a sum.  For corpora whose disk holds some forty times their size; see README.
        """
        order, words = self.order, F.regexp_extract_all(F.coalesce(self.text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
        rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(self.id_col).alias("doc_id"), words.alias("ws")), "words")
        gram = lambda i, k: F.when(i >= k, F.xxhash64(F.slice("ws", i - k + 1, k), F.lit(k)))
        places = rows.select("_row", "ws", F.explode(F.sequence(F.lit(1), F.size("ws"))).alias("i")).where(F.size("ws") > 0)
        places = places.select("_row", "i", *(gram(F.col("i"), F.lit(k)).alias(f"g{k}") for k in range(1, order + 1)))
        for k in range(1, order + 1):
            own = places.where(f"g{k} IS NOT NULL").groupBy("_row", f"g{k}").agg(F.count(F.lit(1)).alias("own"))
            every = own.groupBy(f"g{k}").agg(F.sum("own").alias("every"))
            others = own.join(every, f"g{k}").select("_row", f"g{k}", (F.col("every") - F.col("own")).alias(f"n{k}"))
            places = cut(places.join(others, ["_row", f"g{k}"], "left"), "places")
        before = places.select("_row", (F.col("i") + 1).alias("i"), *(F.col(f"n{k}").alias(f"c{k}") for k in range(1, order)))
        both = places.join(before, ["_row", "i"], "left")
        total = places.count()
        words_of = rows.select("_row", "doc_id", F.size("ws").cast("long").alias("n_words"))
        level = F.coalesce(*(F.when(F.col(f"n{k}") > 0, k) for k in range(order, 1, -1)), F.lit(1))
        value = F.coalesce(*(F.when(F.col(f"n{k}") > 0, F.log(F.col(f"n{k}") / F.col(f"c{k - 1}"))) for k in range(order, 1, -1)), F.log(F.greatest("n1", F.lit(1)).cast("double")))
        full = F.least("i", F.lit(order))
        sums = both.groupBy("_row").agg(F.sum(value + (full - level) * F.lit(float(np.log(self.alpha)))).alias("part"), F.count_if(level == 1).alias("last"), F.count_if(level == full).alias("n_full"))
        others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
        out = words_of.join(sums, "_row", "left")
        return out.select("doc_id", "n_words", F.coalesce(F.col("part") - F.col("last") * F.log(others), F.lit(0.0)).alias("score"), F.coalesce("n_full", F.lit(0)).alias("n_full"))
