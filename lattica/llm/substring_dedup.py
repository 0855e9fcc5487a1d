"""Substring deduplication with fixed-block anchors.

Any run of ``2 * block - 1`` words contains one whole block that starts at a multiple of ``block`` in its own
document.  So the index holds the non-overlapping blocks of every document, every rolling window of ``block``
words probes it, and where a probe meets a block of another document the hit is extended: the windows of
``window`` words around it are compared by 128-bit hashes, and neighbouring equal windows merge into maximal
exact repeats.

Three passes read the documents in batches (see ``exchange``): the first sends each batch's distinct block and
probe hashes to their buckets, the second sends the windows around hits, the third removes what a smaller id
already has.  The texts are shuffled once and read thrice.

Defined results: null text is a text without words; texts shorter than a window keep all words; rows with equal
ids do not cover one another; a null id counts as larger than any other; an empty table gives an empty result;
input columns named like a result column give way to it.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.llm import exchange as X
from lattica.llm.tokens import U64, Words, rolling, window_starts, words

NO_ID = np.iinfo(np.int64).max
SPAN = pa.struct([("first_word", pa.int64()), ("past_word", pa.int64())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("past_word", T.LongType())]))),
])


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return table.column(id_col).cast(pa.int64()).fill_null(NO_ID).combine_chunks().to_numpy(zero_copy_only=False)


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    return (X.bucket_of(h, buckets).astype(U64) << U64(X.LOW_BITS)) | (h & X.LOW)


def _anchors(w: Words, block: int, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, keys and alignment of the rolling windows of documents long enough to matter."""
    at = window_starts(w.first, block)
    doc = np.searchsorted(w.first, at, side="right") - 1
    enough = w.lengths[doc] >= window
    at, doc = at[enough], doc[enough]
    return at, _keys(rolling(w.hash, block)[at], buckets), (at - w.first[doc]) % block == 0


def _found(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value, -1 where it isn't there."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[i] == wanted, i, -1)


def _groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal rows, the end included."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _smallest(ids: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the columns, borders of the groups in that order, and each group's smallest id."""
    order = np.lexsort(columns[::-1])
    borders = _groups(*[c[order] for c in columns]) if len(order) else np.zeros(1, np.int64)
    return order, borders, np.minimum.reduceat(ids[order], borders[:-1]) if len(order) else ids[:0]


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of each run of sorted keys that one bucket owns."""
    owner = (keys >> U64(X.LOW_BITS)).astype(np.int64)
    b = _groups(owner) if len(owner) else np.zeros(1, np.int64)
    return [(int(owner[i]), int(i), int(j)) for i, j in zip(b[:-1], b[1:], strict=True)]


class SubstringDedup:
    """Removes words of runs of at least ``window`` words that also occur in a document with a smaller id."""

    def __init__(self, window: int = 13, id_col: str = "doc_id", text_col: str = "text"):
        if window < 3 or window % 2 == 0:
            raise ValueError("window is an odd number of words, 3 at least: twice the block, less one")
        self.window, self.block, self.id_col, self.text_col = window, (window + 1) // 2, id_col, text_col

    def transform(self, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """One row per input row: the columns in ``carry`` (the id if none are given) and those of RESULT."""
        carry = [c for c in (carry or [self.id_col]) if c not in RESULT.names]
        keep = list(dict.fromkeys([*carry, self.id_col, self.text_col]))
        how = X.plan(docs, self.text_col)
        buckets, dealt = how.buckets, X.dealt(X.stable(docs.select(*keep)), how, self.text_col)
        window, block, id_col, text_col = self.window, self.block, self.id_col, self.text_col

        def index_and_probes(key: tuple, batch: pa.Table) -> pa.Table:
            _, keys, aligned = _anchors(words(X.rows(batch).column(text_col)), block, window, buckets)
            index = np.unique(keys[aligned])
            probes = np.setdiff1d(np.unique(keys[~aligned]), index, assume_unique=True)
            rows = [(o, True, X.pack(index[i:j] & X.LOW)) for o, i, j in _by_bucket(index, buckets)] + [(o, False, X.pack(probes[i:j] & X.LOW)) for o, i, j in _by_bucket(probes, buckets)]
            return pa.table({"_bucket": pa.array([r[0] for r in rows], pa.int32()), "_batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "aligned": pa.array([r[1] for r in rows], pa.bool_()), "blob": pa.array([r[2] for r in rows], pa.binary())})

        def meet(key: tuple, sent: pa.Table) -> pa.Table:
            blobs = [X.unpack(b) for b in sent.column("blob").to_pylist()]
            n = [len(b) for b in blobs]
            low = np.concatenate(blobs)
            aligned = np.repeat(sent.column("aligned").to_numpy(), n)
            batch = np.repeat(sent.column("_batch").to_numpy(), n)
            order = np.argsort(low)
            low, aligned, batch = low[order], aligned[order], batch[order]
            b = _groups(low)
            size = np.diff(b)
            blocks = np.repeat(np.add.reduceat(aligned.astype(np.int64), b[:-1]), size)
            hit = (blocks > aligned) | (aligned & (np.repeat(size, size) > 1))
            return _answers(batch[hit], (U64(key[0].as_py()) << U64(X.LOW_BITS)) | low[hit])

        def extend(key: tuple, batch: pa.Table, hits: pa.Table) -> pa.Table:
            docs = X.rows(batch)
            w = words(docs.column(text_col), wide=True)
            at, keys, aligned = _anchors(w, block, window, buckets)
            doc = np.searchsorted(w.first, at, side="right") - 1
            flag = _found(np.sort(np.concatenate([X.unpack(b) for b in hits.column("blob").to_pylist()] or [np.zeros(0, U64)])), keys) >= 0
            order = np.argsort(keys, kind="stable")
            b = _groups(keys[order]) if len(order) else np.zeros(1, np.int64)
            if len(order):
                low, high, some = np.minimum.reduceat(doc[order], b[:-1]), np.maximum.reduceat(doc[order], b[:-1]), np.logical_or.reduceat(aligned[order], b[:-1])
                flag[order] |= np.repeat((low < high) & some, np.diff(b))
            hot = np.zeros(len(w.hash) + 1, np.int64)
            hot[at[flag] + 1] = 1
            hot = np.cumsum(hot)
            starts = window_starts(w.first, window)
            starts = starts[hot[starts + window - block + 1] > hot[starts]]
            a, c = rolling(w.hash, window)[starts], rolling(w.hash2, window, 1)[starts]
            owner = X.bucket_of(a, buckets).astype(U64)
            ids = _ids(docs, id_col)[np.searchsorted(w.first, starts, side="right") - 1]
            order, b, least = _smallest(ids, owner, a, c)
            first = order[b[:-1]]
            rows = [(int(owner[first[i]]), a[first[i:j]], c[first[i:j]], least[i:j]) for i, j in _runs(owner[first])]
            return pa.table({"_bucket": pa.array([r[0] for r in rows], pa.int32()), "_batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "a": pa.array([X.pack(r[1]) for r in rows], pa.binary()), "c": pa.array([r[2].tobytes() for r in rows], pa.binary()), "least": pa.array([X.pack_longs(r[3]) for r in rows], pa.binary())})

        def smallest(key: tuple, sent: pa.Table) -> pa.Table:
            a = np.concatenate([X.unpack(b) for b in sent.column("a").to_pylist()])
            c = np.concatenate([np.frombuffer(b, U64) for b in sent.column("c").to_pylist()])
            least = [X.unpack_longs(b) for b in sent.column("least").to_pylist()]
            batch = np.repeat(sent.column("_batch").to_numpy(), [len(x) for x in least])
            least = np.concatenate(least)
            order, b, low = _smallest(least, a, c)
            covered = order[least[order] > np.repeat(low, np.diff(b))]
            covered = covered[np.argsort(batch[covered], kind="stable")]
            rows = [(int(batch[covered[i]]), X.pack(a[covered[i:j]]), c[covered[i:j]].tobytes()) for i, j in _runs(batch[covered])]
            return pa.table({"_batch": pa.array([r[0] for r in rows], pa.int64()), "a": pa.array([r[1] for r in rows], pa.binary()), "c": pa.array([r[2] for r in rows], pa.binary())})

        def remove(key: tuple, batch: pa.Table, covered: pa.Table) -> pa.Table:
            docs = X.rows(batch)
            w = words(docs.column(text_col), wide=True)
            starts = window_starts(w.first, window)
            a, c = rolling(w.hash, window)[starts], rolling(w.hash2, window, 1)[starts]
            ids = _ids(docs, id_col)[np.searchsorted(w.first, starts, side="right") - 1]
            order, b, least = _smallest(ids, a, c)
            gone = np.zeros(len(starts), bool)
            gone[order] = ids[order] > np.repeat(least, np.diff(b))
            ra = np.concatenate([X.unpack(x) for x in covered.column("a").to_pylist()] or [np.zeros(0, U64)])
            rc = np.concatenate([np.frombuffer(x, U64) for x in covered.column("c").to_pylist()] or [np.zeros(0, U64)])
            by = np.lexsort((rc, ra))
            i = _found(ra[by], a)
            gone |= (i >= 0) & (rc[by][i] == c) if len(by) else False
            change = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(change, starts[gone], 1)
            np.add.at(change, starts[gone] + window, -1)
            return _result(docs, carry, w, np.cumsum(change[:-1]) > 0)

        to_buckets = lambda sent: sent.repartition(how.bucket_parts, "_bucket").groupBy("_bucket")
        to_batches = lambda told: dealt.groupBy("_batch").cogroup(told.repartition(how.batch_parts, "_batch").groupBy("_batch"))
        sent = dealt.groupBy("_batch").applyInArrow(index_and_probes, "_bucket int, _batch long, aligned boolean, blob binary")
        hits = to_buckets(sent).applyInArrow(meet, "_batch long, blob binary")
        near = to_batches(hits).applyInArrow(extend, "_bucket int, _batch long, a binary, c binary, least binary")
        covered = to_buckets(near).applyInArrow(smallest, "_batch long, a binary, c binary")
        schema = T.StructType([docs.schema[c] for c in carry] + RESULT.fields)
        return to_batches(covered).applyInArrow(remove, schema)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    b = _groups(values) if len(values) else np.zeros(1, np.int64)
    return list(zip(b[:-1].tolist(), b[1:].tolist(), strict=True))


def _answers(batch: np.ndarray, keys: np.ndarray) -> pa.Table:
    order = np.lexsort((keys, batch))
    batch, keys = batch[order], keys[order]
    runs = _runs(batch)
    return pa.table({"_batch": pa.array([int(batch[i]) for i, _ in runs], pa.int64()), "blob": pa.array([X.pack(keys[i:j]) for i, j in runs], pa.binary())})


def _result(docs: pa.Table, carry: list[str], w: Words, gone: np.ndarray) -> pa.Table:
    total = np.concatenate(([0], np.cumsum(gone)))
    removed = total[w.first[1:]] - total[w.first[:-1]]
    texts = []
    raw = memoryview(w.data)
    for d, n in enumerate(removed.tolist()):
        i, j = w.first[d], w.first[d + 1]
        own = bytes(raw[w.start[i] : w.end[j - 1]]).split() if j > i else []
        texts.append(b" ".join(compress(own, ~gone[i:j]) if n else own).decode())
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    border = np.zeros(len(gone) + 1, bool)
    border[w.first] = True
    opens = np.flatnonzero((edge == 1) | (border & np.append(gone, False) & np.concatenate(([False], gone))))
    shuts = np.flatnonzero((edge == -1) | (border & np.append(gone, False) & np.concatenate(([False], gone))))
    base = w.first[np.searchsorted(w.first, opens, side="right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(opens - base), pa.array(shuts - base)], fields=list(SPAN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, w.first).astype(np.int32)), spans)
    out = {c: docs.column(c) for c in carry}
    return pa.table(out | {"n_words": pa.array(w.lengths.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_text": pa.array(texts, pa.string()), "removed": lists})
