"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct shingles of ``size`` lower-cased (A-Z) words; with fewer words the whole
sequence is its only shingle.  Two documents link when intersection / union reaches ``percent`` / 100.

Equal sets collapse to their smallest id first.  Shingles are ordered by document frequency, rarest first.  With
overlap at least t, the first ``n - t + l`` shingles of two linked documents share at least l of them, for any l.
That overlap follows from both sizes, so a pair of like sizes needs shorter prefixes than either alone.
Each document chooses the l, up to ``levels``, of least estimated cost: the entries of the lists that its longer
prefix opens to documents of its size, plus verification of at most ``entries / l`` candidates.  A pair must share ``min(l, l')`` shingles
of the prefixes of that level, however it met, before its whole sets are compared.  Shingles no other document has
are never listed: they cannot match.

Lists are joined in three steps, so that a group of thousands of near copies costs links in proportion to its size:
first every document of a list meets only two centres, the list's smallest id and one that a hash picks (a batch's
own centres first, which then meet the list's).  Then, in lists that the components of the verified links leave
apart, each document meets one of another component, drawn anew in each turn; turns go on while they find links,
lessen the pairs that the last step would meet by a quarter, and there are more of these than postings.  Last, all
pairs of different components meet under the multi-match condition.  That join is on shingle and size band: of a
pair, the larger document looks for smaller ones in the bands its prefix reaches, and only documents whose shingle
lies early enough for a partner of at least their own size are found there.  Pairs left out lie in one component
already, so components are exact.  Documents that stay apart still meet pair by pair: a group of many that share
most shingles and link with none costs their square.  That serves ``classes`` alone; ``linked`` gives every link:
all pairs of every list meet, in the same join.

Defined results: texts null or without words are empty sets and link with nothing; rows without an id take no part
and get no component; rows with one id are one node; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import exchange as X
from lattica.llm.components import components
from lattica.llm.shared import cut
from lattica.llm.substring_dedup import _by_bucket, _found, _groups, _keys, _runs
from lattica.llm.tokens import U64, mix, rolling, window_starts, words

#: Sizes of one band differ by less than this factor.
BAND = 1.05
#: Postings in a cell, and the share of the pairs apart that a turn may leave for another to follow.
CELL, LEFT = 8, 0.75


def shingle_sets(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the borders of the texts."""
    w = words(texts, lower=True)
    at = window_starts(w.first, size)
    docs, hashes = [np.searchsorted(w.first, at, side="right") - 1], [rolling(w.hash, size)[at]]
    n = w.lengths
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        docs.append(short)
        hashes.append(rolling(w.hash, k)[w.first[short]])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = _groups(doc, h)[:-1] if len(h) else np.zeros(0, np.int64)
    return h[first], np.searchsorted(doc[first], np.arange(len(n) + 1))


class NgramJaccardJoin:
    """Near duplicates by exact Jaccard similarity of word shingles."""

    def __init__(self, size: int = 5, percent: int = 75, levels: int = 4, id_col: str = "doc_id", text_col: str = "text"):
        if not 1 <= percent <= 100 or size < 1 or levels < 1:
            raise ValueError("percent lies in 1..100, size and levels are at least 1")
        self.size, self.percent, self.levels, self.id_col, self.text_col = size, percent, levels, id_col, text_col

    def _read(self, docs: DataFrame) -> tuple[DataFrame, X.Plan]:
        own = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), F.col(self.text_col).alias("text"))
        return X.stable(own), X.plan(own)

    def sets(self, docs: DataFrame, how: X.Plan) -> DataFrame:
        """(doc_id, n_shingles, d1, d2, _batch, _row) of every row: the size of its set, a 128-bit digest of it, its place."""
        size = self.size

        def sign(batches):
            for number, table in X.runs(batches, how, "text"):
                h, first = shingle_sets(table.column("text"), size)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(salt)), dtype=U64))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                    d1, d2 = (s[first[1:]] - s[first[:-1]] for s in sums)
                n = len(table)
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.diff(first).astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array([number] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32))], names=["doc_id", "n_shingles", "d1", "d2", "_batch", "_row"])

        return docs.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, _batch long, _row int")

    def _listed(self, docs: DataFrame, how: X.Plan, reps: DataFrame) -> DataFrame:
        """Rows of four kinds: P postings of prefixes, S whole sets of documents that have any with their prefixes, G a batch's centres of a list, L its pairs with them."""
        size, percent, levels, buckets = self.size, self.percent, self.levels, how.buckets
        dealt = X.dealt(docs, how, "text")
        reps = reps.select("_batch", "_row")

        def own_sets(batch: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            table = X.rows(batch).take(pa.array(np.sort(rows)))
            h, first = shingle_sets(table.column("text"), size)
            return table.column("doc_id").to_numpy(), h, first

        def send(key: tuple, docs: pa.Table, reps: pa.Table) -> pa.Table:
            _, h, _ = own_sets(docs, reps.column("_row").to_numpy())
            keys, counts = np.unique(_keys(h, buckets), return_counts=True)
            rows = [(o, X.pack(keys[i:j] & X.LOW), X.pack_counts(counts[i:j])) for o, i, j in _by_bucket(keys, buckets)]
            return pa.table({"_bucket": pa.array([r[0] for r in rows], pa.int32()), "_batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

        def count(key: tuple, sent: pa.Table) -> pa.Table:
            blobs = [X.unpack(b) for b in sent.column("keys").to_pylist()]
            low, counts = np.concatenate(blobs), np.concatenate([X.unpack_counts(b) for b in sent.column("counts").to_pylist()])
            batch = np.repeat(sent.column("_batch").to_numpy(), [len(b) for b in blobs])
            order = np.argsort(low)
            low, batch = low[order], batch[order]
            b = _groups(low)
            total = np.repeat(np.add.reduceat(counts[order].astype(np.int64), b[:-1]), np.diff(b))
            shared = total > 1
            low, batch, total = low[shared], batch[shared], np.minimum(total[shared], 2**32 - 1)
            by = np.argsort(batch, kind="stable")
            low, batch, total = low[by] | (U64(key[0].as_py()) << U64(X.LOW_BITS)), batch[by], total[by]
            runs = _runs(batch)
            return pa.table({"_batch": pa.array([int(batch[i]) for i, _ in runs], pa.int64()), "keys": pa.array([X.pack(low[i:j]) for i, j in runs], pa.binary()), "counts": pa.array([X.pack_counts(total[i:j]) for i, j in runs], pa.binary())})

        def prefixes(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
            known = notes.filter(pc.is_valid(notes.column("keys")))
            shared = np.concatenate([X.unpack(b) for b in known.column("keys").to_pylist()] or [np.zeros(0, U64)])
            freq = np.concatenate([X.unpack_counts(b) for b in known.column("counts").to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
            by = np.argsort(shared)
            shared, freq = shared[by], freq[by]
            ids, h, first = own_sets(docs, notes.column("_row").drop_null().to_numpy())
            keys, n = _keys(h, buckets), np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            i = _found(shared, keys)
            listed = np.flatnonzero(i >= 0)
            doc, keys, df = doc[listed], keys[listed], freq[i[listed]] if len(freq) else np.zeros(0, np.int64)
            order = np.lexsort((keys, df, doc))
            doc, keys, df = doc[order], keys[order], df[order]
            begin = np.searchsorted(doc, np.arange(len(n) + 1))
            alone = n - np.diff(begin)
            t, like = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
            position = np.arange(len(doc)) - begin[doc] + alone[doc]
            level = np.maximum(1, position - (n - t)[doc] + 1)
            opened = np.concatenate(([0], np.cumsum(df - 1)))
            best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
            for lv in range(1, levels + 1):
                end = np.clip(begin[:-1] + n - like + lv - alone, begin[:-1], begin[1:])
                entries = opened[end] - opened[begin[:-1]]
                cost = entries + entries / lv * (n / 32)
                better = (cost < best) & (t >= lv)
                best, chosen = np.where(better, cost, best), np.where(better, lv, chosen)
            keep = level <= chosen[doc]
            doc, keys, position = doc[keep], keys[keep], position[keep]
            some = np.unique(doc)  # postings are in order of documents
            spans = list(zip(np.searchsorted(doc, some).tolist(), np.searchsorted(doc, some, side="right").tolist(), strict=True))
            order = np.lexsort((ids[doc], keys))
            b = _groups(keys[order]) if len(order) else np.zeros(1, np.int64)
            lo = ids[doc[order[b[:-1]]]] if len(order) else ids[:0]
            drawn = mix(ids[doc[order]].view(U64) ^ keys[order]) | U64(1)
            drawn[ids[doc[order]] == np.repeat(lo, np.diff(b))] = 0  # another than the smallest, if there is one
            other = ids[doc[order[np.lexsort((drawn, keys[order]))[b[1:] - 1]]]] if len(order) else ids[:0]
            local = [(ids[doc[order]], np.repeat(x, np.diff(b))) for x in (lo, other)]
            pairs = np.unique(np.concatenate([np.stack((np.minimum(x, y), np.maximum(x, y)), 1)[x != y] for x, y in local]), axis=0) if len(order) else np.zeros((0, 2), np.int64)
            m = [len(keys), len(some), len(b) - 1, len(pairs)]
            at = np.cumsum([0, *m])
            column = lambda kind, *parts: pa.concat_arrays([next((pa.array(p, kind) for k, p in parts if k == q), pa.nulls(m[q], kind)) for q in range(4)])
            return pa.table({
                "kind": pa.array(np.repeat(["P", "S", "G", "L"], m)),
                "key": column(pa.int64(), (0, keys.view(np.int64)), (2, keys[order[b[:-1]]].view(np.int64))),
                "a": column(pa.int64(), (0, ids[doc]), (1, ids[some]), (2, lo), (3, pairs[:, 0])),
                "b": column(pa.int64(), (2, other), (3, pairs[:, 1])),
                "n": column(pa.int32(), (0, n[doc].astype(np.int32))),
                "rest": column(pa.int32(), (0, (n[doc] - position).astype(np.int32)), (1, (n[some] - alone[some]).astype(np.int32))),
                "chosen": column(pa.int32(), (0, chosen[doc].astype(np.int32)), (1, chosen[some].astype(np.int32))),
                "hashes": column(pa.list_(pa.int64()), (1, [h[first[d] : first[d + 1]].view(np.int64) for d in some])),
                "prefix": column(pa.list_(pa.int64()), (1, [keys[i:j].view(np.int64) for i, j in spans])),
            })

        reps = reps.repartition(how.batch_parts, "_batch")
        sent = dealt.groupBy("_batch").cogroup(reps.groupBy("_batch")).applyInArrow(send, "_bucket int, _batch long, keys binary, counts binary")
        shared = sent.repartition(how.bucket_parts, "_bucket").groupBy("_bucket").applyInArrow(count, "_batch long, keys binary, counts binary").repartition(how.batch_parts, "_batch")
        notes = reps.withColumns({"keys": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}).unionByName(shared.withColumn("_row", F.lit(None).cast("int")))
        return dealt.groupBy("_batch").cogroup(notes.groupBy("_batch")).applyInArrow(prefixes, "kind string, key long, a long, b long, n int, rest int, chosen int, hashes array<long>, prefix array<long>")

    @staticmethod
    def _sets(listed: DataFrame) -> DataFrame:
        """Whole sets with their prefixes, rarest shingle first: ``rest`` shingles follow from the first one on, and one less from each next."""
        return listed.where("kind = 'S'").select("a", "hashes", "prefix", "rest", "chosen")

    def _candidates(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) with their sets, the level they need, and how many shingles of the prefixes of that level they share."""
        left, right = (sets.select(F.col("a").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("hashes", "prefix", "rest", "chosen"))) for k in "ab")
        level, n = F.least("chosen_a", "chosen_b"), F.size("hashes_a") + F.size("hashes_b")
        least = F.ceil(self.percent * n / (100 + self.percent)) - level + 1
        of = lambda side: F.slice(f"prefix_{side}", F.lit(1), F.greatest(F.col(f"rest_{side}") - least + 1, F.lit(0)).cast("int"))
        return pairs.join(left, "a").join(right, "b").withColumns({"need": level, "shared": F.size(F.array_intersect(of("a"), of("b")))})

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that share shingles enough of their prefixes, and whose whole sets are similar enough."""
        both = F.size(F.array_intersect("hashes_a", "hashes_b"))
        similar = 100 * both >= self.percent * (F.size("hashes_a") + F.size("hashes_b") - both)
        return self._candidates(pairs, sets).where(F.when(F.col("shared") >= F.col("need"), similar).otherwise(False)).select("a", "b")

    def _sides(self, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings that a larger partner may find, by their band, and those that look for smaller ones, by each band they reach.

        A pair needs an overlap of percent / (100 + percent) of both sizes together; a shingle with ``rest`` shingles
        from it on lies in the prefix of level l when rest + l - 1 reaches that overlap.  So ``reach`` is the largest
        partner that a posting can serve.
        """
        p = self.percent
        reach = F.floor((100 + p) * (F.col("rest") + F.col("chosen") - 1) / p) - F.col("n")
        band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")
        least = F.ceil(p * F.col("n") / 100)
        able = postings.withColumn("reach", reach)
        small = able.where("reach >= n").withColumn("band", band(F.col("n")))
        return small, able.where(F.col("reach") >= least).withColumn("band", F.explode(F.sequence(band(least), band(F.least("n", "reach")))))

    def _matches(self, postings: DataFrame, apart: bool) -> DataFrame:
        """Pairs (a, b) that share as many shingles of both prefixes as their level asks for; ``apart``: of unlike root only."""
        p = self.percent
        small, large = self._sides(postings)
        small = _side(small, "b").withColumnRenamed("band_b", "band")
        both = _side(large, "a").withColumnRenamed("band_a", "band").join(small, ["key", "band"])
        both = both.where((F.col("n_b") < F.col("n_a")) | (F.col("n_b") == F.col("n_a")) & (F.col("doc_b") < F.col("doc_a"))).where(100 * F.col("n_b") >= p * F.col("n_a"))
        if apart:
            both = both.where("root_a <> root_b")
        level = F.least("chosen_a", "chosen_b")
        both = both.where(p * (F.col("n_a") + F.col("n_b")) <= (100 + p) * (F.least("rest_a", "rest_b") + level - 1))
        pairs = both.groupBy(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(level).alias("need"))
        return pairs.where("shared >= need AND a < b").select("a", "b")

    def links(self, docs: DataFrame, how: X.Plan, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) between representatives that leave no component apart: first ones with their components, and more."""
        listed = cut(self._listed(docs, how, reps), "prefixes")
        sets = self._sets(listed)
        centres = listed.where("kind = 'G'").select("key", "a", "b")
        drawn = F.greatest(*(F.struct(F.xxhash64("key", x).alias("h"), F.col(x).alias("x")) for x in "ab"))
        lists = centres.groupBy("key").agg(F.min("a").alias("lo"), F.max(F.greatest("a", "b")).alias("hi"), F.max(drawn).alias("p")).where("lo < hi")
        lists = lists.select("key", "lo", F.when(F.col("p.x") != F.col("lo"), F.col("p.x")).otherwise(F.col("hi")).alias("other"))
        met = centres.join(lists, "key").select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in ("lo", "other")))).alias("p")).select("p.*")
        met = met.unionByName(listed.where("kind = 'L'").select("a", "b"))
        stars = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        label = components(self._verified(stars, sets))
        lists = self._open(listed.where("kind = 'P'").select("key", F.col("a").alias("doc"), "n", "rest", "chosen"), label)
        n, apart = self._apart(lists)
        for turn in itertools.count():
            if apart <= n:
                break
            found = cut(self._verified(self._met(lists, turn), sets), "met")
            if found.isEmpty():
                break
            label = components(found, label)
            lists, before = self._open(lists.drop("root", "size"), label), apart
            n, apart = self._apart(lists)
            if apart > LEFT * before:
                break
        return label, self._verified(self._matches(lists, apart=True), sets)

    def _open(self, postings: DataFrame, label: DataFrame) -> DataFrame:
        """The postings with their roots and the sizes of their lists, of lists that hold several roots."""
        placed = postings.join(label.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("key", "size")
        return cut(placed.join(split, "key"), "open")

    def _apart(self, lists: DataFrame) -> tuple[int, float]:
        """The number of postings, and that of pairs of unlike root and fitting bands over all lists."""
        small, large = self._sides(lists)
        ways = small.select("key", "band", "root", F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(large.select("key", "band", "root", F.lit(0).alias("s"), F.lit(1).alias("l")))
        own = ways.groupBy("key", "band", "root").agg(F.sum("s").cast("double").alias("s"), F.sum("l").cast("double").alias("l"))
        pairs = own.groupBy("key", "band").agg((F.sum("s") * F.sum("l") - F.sum(F.col("s") * F.col("l"))).alias("pairs"))
        return lists.count(), pairs.agg(F.sum("pairs")).first()[0] or 0.0

    def _met(self, lists: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of unlike root and sizes that may link, at most one for each posting.

        Lists are dealt anew in each turn into cells of about ``CELL`` postings; each posting meets that of the
        smallest root in its cell, those of this root that of the largest.
        """
        cell = F.pmod(F.xxhash64("key", "doc", F.lit(turn)), F.ceil(F.col("size") / CELL))
        dealt = lists.select("key", cell.alias("cell"), "root", "doc", "n")
        one = F.struct("root", "doc", "n")
        ends = dealt.groupBy("key", "cell").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.root < hi.root")
        other = F.when(F.col("root") == F.col("lo.root"), F.col("hi")).otherwise(F.col("lo"))
        met = dealt.join(ends, ["key", "cell"]).select("doc", "n", other.alias("o"))
        met = met.where(100 * F.least("n", "o.n") >= self.percent * F.greatest("n", "o.n"))
        return met.select(F.least("doc", "o.doc").alias("a"), F.greatest("doc", "o.doc").alias("b")).distinct()

    def all_links(self, docs: DataFrame, how: X.Plan, reps: DataFrame) -> DataFrame:
        """Every link (a, b), a < b, between distinct sets, named by their representatives.

        All pairs of each list meet under the multi-match condition, also those that lie in one component already.
        """
        listed = cut(self._listed(docs, how, reps), "prefixes")
        postings = listed.where("kind = 'P'").select("key", F.col("a").alias("doc"), "n", "rest", "chosen")
        return self._verified(cut(self._matches(postings, apart=False), "candidates"), self._sets(listed)).distinct()

    def _members(self, signed: DataFrame, reps: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, rep) of every row: the smallest id with the same set; none for empty sets and null ids."""
        rep = F.when(F.col("doc_id").isNotNull(), F.col("rep"))
        return signed.join(reps, ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", rep.alias("rep"))

    def linked(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The join's whole result: every link between representatives, and (doc_id, n_shingles, rep, n_links) of every row.

        Documents link when they have one representative, or two that link; n_links counts the others a document
        links with.
        """
        docs, how = self._read(docs)
        signed, reps = self._signed(docs, how)
        members = cut(self._members(signed, reps), "members")
        links = cut(self.all_links(docs, how, reps), "all_links")
        own = members.where("rep IS NOT NULL").select("doc_id", "rep").distinct().groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(own.select(F.col("rep").alias("b"), "own"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("own").alias("others"))
        counted = own.join(others, "rep", "left").select("rep", (F.col("own") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return links, members.join(counted, "rep", "left").select("doc_id", "n_shingles", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def _signed(self, docs: DataFrame, how: X.Plan) -> tuple[DataFrame, DataFrame]:
        """Every row's set by digest, and each distinct set's representative with its place."""
        signed = cut(self.sets(docs, how), "sets")
        first = F.min(F.struct(F.col("doc_id").alias("rep"), "_batch", "_row")).alias("r")
        return signed, cut(signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(first).select("n_shingles", "d1", "d2", "r.*"), "reps")

    def classes(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links."""
        docs, how = self._read(docs)
        signed, reps = self._signed(docs, how)
        same = ["n_shingles", "d1", "d2"]
        first, more = self.links(docs, how, reps)
        label = components(more, first)
        placed = cut(reps.join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("root")), "classes")
        out = signed.join(placed, same, "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def _side(df: DataFrame, side: str) -> DataFrame:
    """The frame with every column but the key named for one side of a self-join."""
    return df.select("key", *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "key"))
