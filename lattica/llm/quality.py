"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

    z = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,    score = 1 / (1 + exp(-z))

Every pair of features interacts through vectors of ``rank`` numbers; the pairs are never listed, since their sum is
half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a document is scored in time linear in its features.

Features of a text are its distinct words and the distinct shapes of its words (runs of lower-case letters, capitals,
digits and of each other character), both hashed, weighted so that each kind has length 1, and some statistics of its
structure, each as the bin its value lies in: shares of capitals, digits, punctuation, other bytes, white space and
words that end in neither letter nor digit, length of words and of lines, shares of different words, different pairs
of words and of the most frequent word, and the text's length.  Metadata columns are numbers and enter by the bin of
their logarithm.  Words and shapes enter the model if their shares of good and of bad documents differ by ``min_z``
standard errors: rarer ones would only let it learn single documents by heart.

The loss is logistic, and both classes weigh the same in it however many rows each has.  The fit sees at most
``max_rows`` labelled rows, those with the smallest hash of id and text, equal rows once; Spark extracts and counts
their features, numpy fits on the driver.  Scoring sees every whole text, in one pass without a shuffle.

Defined results: null and empty texts have bins but no words; null, negative and not finite metadata have a bin of
their own; rows without an id, without a label, or whose labels disagree are never learnt from; where all labels are
one every score is their share; a model can be fitted again, and then knows nothing of the first fit; an empty table
gives an empty result; an input column with the name of the score gives way, other extra columns play no part.  Rows
are told apart by their place while fitting, so ``docs`` must give them in the same order each time, as a table does
that is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import cut
from lattica.llm.tokens import U64, Words, cuts, mix, pieces, text_bytes, words

#: Statistics of a text, in the order of ``_statistics``, and the bins of each.
STATISTICS = ("capitals", "digits", "punctuation", "other", "space", "marked", "word", "line", "different", "pairs", "frequent", "bytes")
BINS = 16
LETTER, CAPITAL, DIGIT, SPACE = 1, 2, 3, 32
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = LETTER
_KIND[65:91], _KIND[48:58] = CAPITAL, DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each stretch between two borders holds."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[off[1:]] - total[off[:-1]]


def _shapes(w: Words, kind: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its kinds of characters in order, each run of a kind once."""
    if not len(w.start):
        return np.zeros(0, U64)
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    new[w.start] = True
    run = np.cumsum(new)
    at = np.flatnonzero(new)
    word = np.searchsorted(w.start, at, side="right") - 1
    inside = (word >= 0) & (at < w.end[word])
    at, word = at[inside], word[inside]
    with np.errstate(over="ignore"):
        part = mix(kind[at].astype(U64) + (run[at] - run[w.start[word]]).astype(U64) * U64(256) + U64(1))
        total = np.concatenate(([U64(0)], np.cumsum(part, dtype=U64)))
        first = np.searchsorted(word, np.arange(len(w.start) + 1))
        return mix(total[first[1:]] - total[first[:-1]])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each document, in order of documents, and how often each occurs."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


class DocumentFeatures:
    """Features of texts as rows, columns and values, ordered by row."""

    def __init__(self, bits: int = 18, meta: int = 1):
        self.bits, self.meta = bits, meta
        self.width = (1 << bits) + (len(STATISTICS) + meta) * (BINS + 1)

    def __call__(self, texts: pa.ChunkedArray | pa.Array, meta: list[np.ndarray], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """``meta``: the metadata columns, NaN for null; ``among``: a flag for each column, of which only flagged ones are returned."""
        w = words(texts)
        n, doc = len(w.first) - 1, w.doc_of()
        kind = _KIND[w.data]
        rows, cols, values = [], [], []
        held = {}
        for name, h, salt in (("word", w.hash, 0), ("shape", _shapes(w, kind), 0x5DEECE66D)):
            row, own, times = _distinct(doc, h)
            held[name] = row, times
            many = np.bincount(row, minlength=n)
            rows.append(row)
            cols.append((mix(own ^ U64(salt)) >> U64(64 - self.bits)).astype(np.int64))
            values.append(1 / np.sqrt(many[row]))
        binned = [*self._statistics(texts, w, doc, kind, held["word"], n), *(np.log2(np.where(m >= 0, m, np.nan) + 1) / 2 for m in meta)]
        for k, x in enumerate(binned):
            ok = np.isfinite(x)
            rows.append(np.arange(n))
            cols.append((1 << self.bits) + k * (BINS + 1) + np.where(ok, np.clip(np.where(ok, x, 0), 0, BINS - 1), BINS).astype(np.int64))
            values.append(np.full(n, 0.5))
        row, col, value = (np.concatenate(x) for x in (rows, cols, values))
        if among is not None:
            keep = among[col]
            row, col, value = row[keep], col[keep], value[keep]
        order = np.argsort(row, kind="stable")
        return row[order], col[order], value[order], n

    @staticmethod
    def _statistics(texts, w: Words, doc: np.ndarray, kind: np.ndarray, distinct: tuple, n: int) -> list[np.ndarray]:
        """Each statistic scaled so that its bins are whole numbers."""
        _, off = text_bytes(texts)
        size, count = np.diff(off), w.lengths
        of = lambda flags: _sums(flags, off)
        letters, capitals = of(kind == LETTER), of(kind == CAPITAL)
        with np.errstate(over="ignore"):
            pair = w.hash[:-1] * U64(3) + w.hash[1:]
        inside = doc[:-1] == doc[1:]
        pairs, _, _ = _distinct(doc[:-1][inside], pair[inside])
        row, times = distinct
        top = np.zeros(n, np.int64)
        np.maximum.at(top, row, times)
        last = kind[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
        shares = (
            _share(capitals, letters + capitals), _share(of(kind == DIGIT), size), _share(of(((kind > DIGIT) & (kind < 127)) & (kind != SPACE)), size), _share(of(w.data >= 128), size), _share(of(kind == SPACE), size),
            _share(np.bincount(doc, (last > DIGIT).astype(float), minlength=n), count),
        )
        spread = [np.sqrt(s) * (BINS - 1) for s in shares]
        spread += [np.log2(_share(size, count) + 1) * 2, np.log2(_share(count, of(w.data == 10) + 1) + 1) * 1.5]
        spread += [s * (BINS - 1) for s in (_share(np.bincount(row, minlength=n), count), _share(np.bincount(pairs, minlength=n), np.maximum(count - 1, 0)), np.sqrt(_share(top, count)))]
        return [*spread, np.log2(size + 1) * 0.75]


def margins(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, w: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
    """z of each document, by the sum-of-squares identity."""
    out = bias + np.bincount(row, w[col] * value, minlength=n)
    for f in range(v.shape[1]):
        x = v[col, f] * value
        out += 0.5 * (np.bincount(row, x, minlength=n) ** 2 - np.bincount(row, x * x, minlength=n))
    return out


def gradients(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, share: float, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives by w, v and bias of the mean logistic loss in which both classes weigh the same; ``share`` of all rows are good."""
    n, width = len(y), len(w)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    slope = weight * (_sigmoid(margins(row, col, value, n, w, v, bias)) - y) / max(n, 1)
    gw = np.bincount(col, slope[row] * value, minlength=width)
    gv = np.zeros_like(v)
    own = np.bincount(col, slope[row] * value * value, minlength=width)
    for f in range(v.shape[1]):
        total = np.bincount(row, v[col, f] * value, minlength=n)
        gv[:, f] = np.bincount(col, slope[row] * value * total[row], minlength=width) - own * v[:, f]
    return gw, gv, float(slope.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(first: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, rank: int = 8, steps: int = 600, rate: float = 0.02, batch: int = 512, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, vectors and bias by Adam steps over mini-batches; document d owns features ``first[d]:first[d + 1]``."""
    rng = np.random.default_rng(seed)
    share = float(y.mean())
    held = [np.zeros(width), rng.normal(0, 0.05, (width, rank)), np.zeros(())]
    mean, square = [np.zeros_like(h) for h in held], [np.zeros_like(h) for h in held]
    t = 0
    while t < steps:
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            if t == steps:
                break
            own = order[at : at + batch]
            size = first[own + 1] - first[own]
            pick = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            g = gradients(np.repeat(np.arange(len(own)), size), col[pick], value[pick], y[own], share, held[0], held[1], float(held[2]))
            t += 1
            for k, (h, d) in enumerate(zip(held, g, strict=True)):
                d = d + l2 * h if k < 2 else d
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * d, 0.999 * square[k] + 0.001 * d * d
                held[k] = h - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return held[0], held[1], float(held[2])


class QualityMachine:
    """Fits on labelled documents, scores any documents; 1 is good."""

    def __init__(self, rank: int = 8, max_rows: int = 20_000, bits: int = 18, min_z: float = 6.0, meta_cols: tuple[str, ...] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text", **fitting):
        if rank < 0 or max_rows < 1:
            raise ValueError("rank is not negative, max_rows at least 1")
        self.rank, self.max_rows, self.min_z, self.meta_cols, self.id_col, self.text_col, self.fitting = rank, max_rows, min_z, tuple(meta_cols), id_col, text_col, fitting
        self.features = DocumentFeatures(bits, len(self.meta_cols))
        self.model: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None = None

    def _meta(self) -> list:
        return [F.col(c).cast("double").alias(f"_m{k}") for k, c in enumerate(self.meta_cols)]

    def sample(self, docs: DataFrame, labels: DataFrame, label_col: str, learn: object) -> DataFrame:
        """(_place, _y, c, x): features of at most ``max_rows`` labelled rows."""
        ids, features, meta = F.col(self.id_col), self.features, [f"_m{k}" for k in range(len(self.meta_cols))]
        rows = docs.select(ids.alias("_id"), F.col(self.text_col).alias("_text"), *self._meta(), (ids.isNotNull() if learn is None else ids.isNotNull() & learn).alias("_may"), F.monotonically_increasing_id().alias("_place"))
        marks = labels.where(ids.isNotNull() & F.col(label_col).isNotNull()).groupBy(ids.alias("_id")).agg(F.max(label_col).cast("int").alias("_y"), F.min(label_col).cast("int").alias("_least")).where("_y = _least")
        kinds = rows.where("_may").groupBy("_id", F.xxhash64(F.lit(13), "_id", "_text").alias("_k")).agg(F.min("_place").alias("_place"))
        picked = cut(kinds.join(marks.select("_id", "_y"), "_id").select("_k", "_place", "_y").orderBy("_k", "_place").limit(self.max_rows).select("_place", "_y"), "picked")

        def extract(batches):
            for b in pieces(batches, "_text"):
                row, col, value, n = features(b.column("_text"), [_numbers(b.column(m)) for m in meta])
                first = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("_place"), b.column("_y"), pa.ListArray.from_arrays(first, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(first, pa.array(value.astype(np.float32)))], names=["_place", "_y", "c", "x"])

        chosen = rows.join(F.broadcast(picked), "_place").select("_place", "_y", "_text", *meta)  # max_rows rows
        return cut(chosen.mapInArrow(extract, "_place long, _y int, c array<int>, x array<float>"), "sample")

    def fit(self, docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn: object = None) -> QualityMachine:
        """``learn``: a condition on the documents that may be learnt from."""
        sample = self.sample(docs, labels, label_col, learn)
        known = self._telling(sample)

        def keep(batches):
            for b in batches:
                lists = b.column("c")
                row, col, value = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), b.column("x").flatten().to_numpy()
                i = np.searchsorted(known, col)
                here = known[np.minimum(i, len(known) - 1)] == col
                first = pa.array(np.searchsorted(row[here], np.arange(len(b) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("_place"), b.column("_y"), pa.ListArray.from_arrays(first, pa.array(i[here].astype(np.int32))), pa.ListArray.from_arrays(first, pa.array(value[here]))], names=["_place", "_y", "c", "x"])

        got = sample.mapInArrow(keep, sample.schema).toArrow().combine_chunks().sort_by("_place")  # max_rows rows, known columns
        y = got.column("_y").to_numpy().astype(float)
        if not len(y) or y.min() == y.max():
            share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
            self.model = known, np.zeros(len(known)), np.zeros((len(known), 0)), float(np.log(share / (1 - share)))
            return self
        cols, values = got.column("c").combine_chunks(), got.column("x").combine_chunks()
        first = np.concatenate(([0], np.cumsum(cols.value_lengths().to_numpy()))).astype(np.int64)
        self.model = known, *fit_machine(first, cols.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), y, len(known), self.rank, **self.fitting)
        return self

    def _telling(self, sample: DataFrame) -> np.ndarray:
        """The columns that the model has: all bins, and the words and shapes whose shares differ enough, as Spark counts them."""
        bins = np.arange(1 << self.features.bits, self.features.width)
        size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("good")).first()
        good, bad = size["good"], size["n"] - size["good"]
        if not good or not bad:
            return bins
        counts = sample.select("_y", F.explode(F.array_distinct("c")).alias("c")).where(F.col("c") < 1 << self.features.bits).groupBy("c").agg(F.sum("_y").alias("good"), F.count(F.lit(1)).alias("n"))
        pooled = F.col("n") / F.lit(float(good + bad))
        error = F.sqrt(pooled * (1 - pooled) * (1 / good + 1 / bad))
        gap = F.col("good") / F.lit(float(good)) - (F.col("n") - F.col("good")) / F.lit(float(bad))
        found = counts.where((error > 0) & (F.abs(gap) >= self.min_z * error)).select("c").toArrow()  # 2 ** bits at most
        return np.concatenate((np.sort(found.column("c").to_numpy()).astype(np.int64), bins))

    def transform(self, docs: DataFrame, score_col: str = "score") -> DataFrame:
        """The input with a score of 0 to 1 for each row."""
        if self.model is None:
            raise ValueError("fit first")
        docs = docs.drop(score_col)
        held = docs.sparkSession.sparkContext.broadcast(self.model)
        features = self.features

        def score(columns):
            known, w, v, bias = held.value
            place = np.full(features.width, -1, np.int64)
            place[known] = np.arange(len(known))
            for texts, *meta, _ in columns:  # the last one keeps them a tuple
                out = [np.zeros(0)]
                for i, j in cuts(texts):
                    row, col, value, n = features(texts.slice(i, j - i), [_numbers(m.slice(i, j - i)) for m in meta], place >= 0)
                    out.append(_sigmoid(margins(row, place[col], value, n, w, v, bias)))
                yield pa.array(np.concatenate(out))

        score.__annotations__ = {"columns": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        texts = F.coalesce(F.col(self.text_col), F.lit(""))
        return docs.withColumn(score_col, F.arrow_udf(score, "double")(texts, *(F.col(c).cast("double") for c in self.meta_cols), F.lit(0.0)))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(float("nan")).to_numpy(zero_copy_only=False)
