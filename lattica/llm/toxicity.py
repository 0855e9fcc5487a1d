"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; other rows, whatever they are, are the unlabelled set.  A linear model over
hashed words and word beginnings minimises the non-negative estimate of the classification risk,

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

with the sigmoid loss; where the bracket turns negative, the step runs against its gradient instead.  The class
prior is the share of confirmed rows among the labelled ones, or a parameter.  The sigmoid loss leaves margins small,
so they are then multiplied by ``sharpness``, and the bias is set so that the scores of the unlabelled average the prior.

The fit sees at most ``max_positive`` positive rows and, as the unlabelled set, at most ``max_unlabelled`` rows of the
whole, confirmed or not, those with the smallest hash of id and text, equal rows once; scoring sees every whole text.  Features of a
text are its distinct words (A-Z lowered, ASCII punctuation dropped), their first ``stem`` bytes, and those that at
least 2 or 3 of its distinct words share, as abuse is often compounded; all as far as their share among the positives
differs from that among the unlabelled by ``min_z`` standard errors: rarer ones would only let the model learn single
documents by heart.  Only text enters a score.

Defined results: null and empty texts have no features and score as the bias alone says; rows without an id are
never learnt from; without positives every score is the prior; a model can be fitted again, and then knows nothing of
the first fit; extra columns play no part.  Rows are told apart by their place while fitting, so ``docs`` must give
them in the same order each time, as a table does that is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import cut
from lattica.llm.tokens import U64, as_array, cuts, mix, pieces, words

_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[48:58] = _ASCII_WORD[65:91] = _ASCII_WORD[97:123] = True
_ASCII_WORD[128:] = True
SPACE = 32


class Features:
    """Hashed features of texts: rows and columns, ordered by row, and the number of texts."""

    def __init__(self, bits: int = 20, stem: int = 5, families: tuple[int, ...] = (2, 3)):
        self.bits, self.stem, self.families = bits, stem, families

    def __call__(self, texts: pa.ChunkedArray | pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """``among``: a flag for each column; only the flagged ones are returned."""
        arr = as_array(texts)
        cleaned = _clean(arr)
        w = words(cleaned, lower=True)
        shift = U64(64 - self.bits)
        with np.errstate(over="ignore"):
            salt = mix(w.doc_of().astype(U64) + U64(1))
            one = np.unique(w.hash ^ salt, return_index=True)[1]  # each word of a text once
            doc, head = w.doc_of()[one], mix(_heads(w, self.stem)[one] ^ U64(0xA5A5A5A5A5A5A5A5))
            _, stem, held = np.unique(head ^ salt[one], return_index=True, return_counts=True)
        row, ids = [doc, doc[stem]], [w.hash[one], head[stem]]
        for k in self.families:
            many = stem[held >= k]
            row.append(doc[many])
            ids.append(mix(head[many] + U64(k)))
        row, ids = np.concatenate(row), (np.concatenate(ids) >> shift).astype(np.int64)
        if among is not None:
            row, ids = row[among[ids]], ids[among[ids]]
        cell = np.unique((row << self.bits) | ids)
        return cell >> self.bits, cell & ((1 << self.bits) - 1), len(arr)


def _clean(arr: pa.Array) -> pa.Array:
    """The texts with every ASCII byte that is neither letter nor digit turned into a space."""
    _, offsets, data = arr.buffers()
    if data is None or not len(arr):
        return arr
    raw = np.frombuffer(data, np.uint8)
    out = np.where(_ASCII_WORD[raw], raw, np.uint8(SPACE))
    return pa.Array.from_buffers(arr.type, len(arr), [None, offsets, pa.py_buffer(out)], offset=arr.offset)


def _heads(w, n: int) -> np.ndarray:
    """The first n bytes of each word as a number; shorter words fill up with zeros."""
    out = np.zeros(len(w.start), U64)
    for k in range(n):
        at = w.start + k
        inside = at < w.end
        byte = np.where(inside, w.data[np.minimum(at, max(len(w.data) - 1, 0))], 0) if len(w.data) else np.zeros(0)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        out = (out << U64(8)) | byte.astype(U64)
    return out


def _known(known: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features among the known ones, by their number there."""
    if not len(known):
        return row[:0], col[:0]
    i = np.minimum(np.searchsorted(known, col), len(known) - 1)
    here = known[i] == col
    return row[here], i[here]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The non-negative risk of margins of positives and unlabelled rows, and the bracket that it cuts off at 0.

    The loss of a margin z for a label y is the sigmoid of -y z.
    """
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    bracket = mean(_sigmoid(zu)) - prior * mean(_sigmoid(zp))
    return prior * mean(_sigmoid(-zp)) + max(0.0, bracket), bracket


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by the margins of what a step descends: the risk, or minus the bracket where that is negative."""
    sp, su = prior * _sigmoid(zp) * _sigmoid(-zp) / max(len(zp), 1), _sigmoid(zu) * _sigmoid(-zu) / max(len(zu), 1)
    return (-2 * sp, su) if risk(zp, zu, prior)[1] >= 0 else (sp, -su)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, width: int, steps: int = 1500, rate: float = 0.02, batch: int = 2048, l2: float = 3e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam steps over mini-batches of feature lists."""
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    rounds, t = max(1, -(-len(unl) // batch)), 0
    take = min(len(pos), max(batch // 4, -(-len(pos) // rounds)))

    def stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(c) for c in rows]), np.concatenate([np.zeros(0, np.int64), *rows])

    while t < steps:
        order_u, order_p = rng.permutation(len(unl)), rng.permutation(len(pos))
        for s in range(rounds):
            pi, ui = order_p[np.arange(s * take, (s + 1) * take) % len(pos)], order_u[s * batch : (s + 1) * batch]
            (rows_p, cols_p), (rows_u, cols_u) = stack([pos[i] for i in pi]), stack([unl[i] for i in ui])
            zp = np.bincount(rows_p, w[cols_p], minlength=len(pi)) + w[width]
            zu = np.bincount(rows_u, w[cols_u], minlength=len(ui)) + w[width]
            gp, gu = slopes(zp, zu, prior)
            g = np.bincount(cols_p, gp[rows_p], minlength=width + 1) + np.bincount(cols_u, gu[rows_u], minlength=width + 1) + l2 * w
            g[width] += gp.sum() + gu.sum() - l2 * w[width]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:width], float(w[width])


def calibrated(margins: np.ndarray, bias: float, prior: float) -> float:
    """The bias near the given one with which the scores of the unlabelled average the prior."""
    lo, hi = bias - 50, bias + 50
    for _ in range(60 if len(margins) else 0):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _sigmoid(margins + mid).mean() < prior else (lo, mid)
    return (lo + hi) / 2


class PuToxicity:
    """Fits on documents joined with confirmed labels, scores any documents."""

    def __init__(self, prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 12000, bits: int = 20, stem: int = 5, min_z: float = 5.0, sharpness: float = 2.0, id_col: str = "doc_id", text_col: str = "text"):
        self.min_z, self.sharpness, self.prior, self.max_positive, self.max_unlabelled = min_z, sharpness, prior, max_positive, max_unlabelled
        self.features, self.id_col, self.text_col = Features(bits, stem), id_col, text_col
        self.weights: np.ndarray | None = None
        self.known = np.zeros(0, np.int64)
        self.bias, self.fitted_prior = 0.0, 0.5

    def fit(self, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", learn: object = None) -> PuToxicity:
        """``learn``: a condition on the id for rows that may be learnt from; labels are those of ``label_col`` = 1."""
        ids = F.col(self.id_col)
        rows = docs.where(ids.isNotNull()) if learn is None else docs.where(ids.isNotNull() & learn)
        marks = labels.where(F.col(self.id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(self.id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        if learn is not None:
            marks = marks.join(rows.select(ids.alias("_id")).distinct(), "_id", "left_semi")
        seen = marks.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).first()
        # a row counts once however often it repeats: the first of its kind stands for all
        held = rows.select(ids.alias("_id"), F.col(self.text_col).alias("_text"), F.monotonically_increasing_id().alias("_place"))
        kinds = held.groupBy("_id", F.xxhash64(F.lit(11), "_id", "_text").alias("_k")).agg(F.min("_place").alias("_place"))
        chosen = lambda own, most, s: own.select("_place", "_k").orderBy("_k", "_place").limit(most).select("_place", F.lit(s).alias("_s"))
        positive = chosen(kinds.join(marks.where("_y = 1"), "_id"), self.max_positive, 1)
        every = chosen(kinds, self.max_unlabelled, 0)
        features = self.features

        def sparse(batches):
            for b in pieces(batches, "_text"):
                row, col, n = features(b.column("_text"))
                first = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("_place"), b.column("_s"), pa.ListArray.from_arrays(first, pa.array(col.astype(np.int32)))], names=["_place", "_s", "c"])

        picked = cut(positive.unionByName(every), "picked")
        sample = cut(held.join(F.broadcast(picked), "_place").select("_place", "_s", "_text").mapInArrow(sparse, "_place long, _s int, c array<int>"), "sample")
        size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_s"), F.lit(0)).alias("pos")).first()
        self.known = self._telling(sample, size["pos"], size["n"] - size["pos"])
        known = self.known

        def keep(batches):
            for b in batches:
                lists = b.column("c")
                row, col = _known(known, np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int64))
                first = pa.array(np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("_place"), b.column("_s"), pa.ListArray.from_arrays(first, pa.array(col.astype(np.int32)))], names=["_place", "_s", "c"])

        got = sample.mapInArrow(keep, sample.schema).toArrow().sort_by([("_s", "ascending"), ("_place", "ascending")])  # max_positive + max_unlabelled rows at most
        self.fitted_prior = self.prior if self.prior is not None else min(max((seen["pos"] or 0) / max(seen["n"], 1), 1e-3), 0.9)
        pos, unl = ([np.array(c, np.int64) for c in got.filter(pc.equal(got.column("_s"), want)).column("c").to_pylist()] for want in (1, 0))
        if pos:
            weights, bias = fit_nnpu(pos, unl, self.fitted_prior, len(known))
            self.weights, bias = weights * self.sharpness, bias * self.sharpness
            self.bias = calibrated(np.array([self.weights[c].sum() for c in unl]), bias, self.fitted_prior)
        else:
            self.weights, self.bias = np.zeros(len(known)), float(np.log(self.fitted_prior / (1 - self.fitted_prior)))
        return self

    def _telling(self, sample: DataFrame, n_pos: int, n_unl: int) -> np.ndarray:
        """Columns whose shares among positives and unlabelled differ by ``min_z`` standard errors, counted by Spark."""
        if not n_pos or not n_unl:
            return np.zeros(0, np.int64)
        counts = sample.select("_s", F.explode("c").alias("c")).groupBy("c").agg(F.sum("_s").alias("pos"), F.count(F.lit(1)).alias("n"))
        pooled = F.col("n") / F.lit(float(n_pos + n_unl))
        error = F.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl))
        gap = F.col("pos") / F.lit(float(n_pos)) - (F.col("n") - F.col("pos")) / F.lit(float(n_unl))
        rows = counts.where((error > 0) & (F.abs(gap) >= self.min_z * error)).select("c").toArrow()  # 2 ** bits at most
        return np.sort(rows.column("c").to_numpy()).astype(np.int64)

    def transform(self, docs: DataFrame, score_col: str = "score") -> DataFrame:
        """The input with a score of 0 to 1 for each row; an input column of that name gives way."""
        if self.weights is None:
            raise ValueError("fit first")
        docs = docs.drop(score_col)
        held = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias, self.known))
        features, text_col = self.features, self.text_col

        def score(texts):
            weights, bias, known = held.value
            among = np.zeros(1 << features.bits, bool)
            among[known] = True
            for batch in texts:
                out = []
                for i, j in cuts(batch):
                    row, col, n = features(batch.slice(i, j - i), among)
                    row, col = _known(known, row, col)
                    z = np.bincount(row, weights[col], minlength=n) + bias
                    out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                yield pa.array(np.concatenate(out) if out else np.zeros(0))

        score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return docs.withColumn(score_col, F.arrow_udf(score, "double")(F.col(text_col)))
