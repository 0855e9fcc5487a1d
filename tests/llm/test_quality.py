"""The factorisation machine against pairs listed one by one, its features against plain Python, and held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm.quality import BINS, STATISTICS, DocumentFeatures, QualityMachine, fit_machine, gradients, margins
from lattica.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def problem(seed=3, n=9, width=12, rank=3):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(width, rng.integers(0, 6), replace=False)) for _ in range(n)]
    row, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    return row, col, rng.normal(size=len(col)), n, rng.normal(size=width), rng.normal(size=(width, rank)), 0.3


def test_margins_are_those_of_all_pairs():
    row, col, value, n, w, v, bias = problem()
    for d, z in enumerate(margins(row, col, value, n, w, v, bias)):
        own = [(int(c), float(x)) for r, c, x in zip(row, col, value, strict=True) if r == d]
        want = bias + sum(w[c] * x for c, x in own) + sum(float(v[a] @ v[b]) * x * y for i, (a, x) in enumerate(own) for b, y in own[i + 1 :])
        assert z == pytest.approx(want)


def test_gradients_are_those_of_the_loss():
    row, col, value, n, w, v, bias = problem()
    y = np.array([0, 1, 1, 0, 1, 1, 1, 0, 1.0])

    def loss(w, v, bias):
        p = [1 / (1 + math.exp(-z)) for z in margins(row, col, value, n, w, v, bias)]
        return sum(-(0.5 / 0.7 if t else 0.5 / 0.3) * math.log(q if t else 1 - q) for q, t in zip(p, y, strict=True)) / n

    gw, gv, gb = gradients(row, col, value, y, 0.7, w, v, bias)
    step = 1e-6
    for i in np.ndindex(w.shape):
        e = np.zeros_like(w)
        e[i] = step
        assert gw[i] == pytest.approx((loss(w + e, v, bias) - loss(w - e, v, bias)) / (2 * step), abs=1e-6)
    for i in np.ndindex(v.shape):
        e = np.zeros_like(v)
        e[i] = step
        assert gv[i] == pytest.approx((loss(w, v + e, bias) - loss(w, v - e, bias)) / (2 * step), abs=1e-6)
    assert gb == pytest.approx((loss(w, v, bias + step) - loss(w, v, bias - step)) / (2 * step), abs=1e-6)


def test_pairs_tell_what_single_features_cannot():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(600)]
    y = np.array([float((0 in r) == (1 in r)) for r in rows])
    first, col = np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.concatenate(rows)
    for rank, least, most in ((4, 0.99, 1.0), (0, 0.0, 0.8)):
        w, v, bias = fit_machine(first, col, np.ones(len(col)), y, 4, rank=rank, steps=800)
        z = margins(np.repeat(np.arange(600), np.diff(first)), col, np.ones(len(col)), 600, w, v, bias)
        assert least <= ((z > 0) == (y > 0)).mean() <= most


def shape(word: bytes) -> str:
    kinds = ["a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)


def test_features_against_plain_python():
    rng = random.Random(2)
    pool = ["the", "The", "THE", "x1", "été", "a&&&", "a&", "b&&", "!!", "1999", "it's", "«ja»"]
    texts = [None, "", " \n ", *(rng.choice([" ", "\n", "\t "]).join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(40))]
    f = DocumentFeatures(bits=30, meta=1)
    meta = np.array([float("nan") if k % 5 == 0 else -1.0 if k % 5 == 1 else float("inf") if k % 5 == 2 else 3.0**k for k in range(len(texts))])
    row, col, value, n = f(pa.array(texts, pa.string()), [meta])
    assert n == len(texts) and (np.diff(row) >= 0).all()
    seen = {}
    for d, text in enumerate(texts):
        data = (text or "").encode()
        ws = WORD.findall(data)
        own = {int(c): float(x) for r, c, x in zip(row, col, value, strict=True) if r == d}
        hashed = {c: x for c, x in own.items() if c < 1 << 30}
        kinds, words = {shape(w) for w in ws}, set(ws)
        assert len(hashed) == len(kinds) + len(words)
        assert Counter(round(x, 9) for x in hashed.values()) == Counter(round(len(x) ** -0.5, 9) for x in (words, kinds) for _ in x)
        assert seen.setdefault(frozenset(words), set(hashed)) == set(hashed)
        share = lambda a, b: a / b if b else 0.0
        count = lambda test: sum(map(test, data))
        kind = [shape(bytes([b])) for b in data]
        space = lambda b: b in b" \t\n\v\f\r"
        letters, capitals = kind.count("a"), kind.count("A")
        shares = [share(capitals, letters + capitals), share(kind.count("0"), len(data)), share(count(lambda b: b < 127 and not chr(b).isalnum() and not space(b)), len(data)), share(count(lambda b: b >= 128), len(data)), share(count(space), len(data)), share(sum(shape(w)[-1] not in "aA0" for w in ws), len(ws))]
        pairs = list(zip(ws, ws[1:], strict=False))
        want = [math.sqrt(s) * (BINS - 1) for s in shares] + [2 * math.log2(share(len(data), len(ws)) + 1), 1.5 * math.log2(len(ws) / (data.count(b"\n") + 1) + 1)]
        want += [s * (BINS - 1) for s in (share(len(words), len(ws)), share(len(set(pairs)), len(pairs)), math.sqrt(share(max(Counter(ws).values(), default=0), len(ws))))]
        want += [0.75 * math.log2(len(data) + 1)]
        bins = [min(int(x), BINS - 1) for x in want] + [BINS if not 0 <= meta[d] < math.inf else min(int(math.log2(meta[d] + 1) / 2), BINS - 1)]
        assert len(want) == len(STATISTICS)
        assert {c for c in own if c >= 1 << 30} == {(1 << 30) + k * (BINS + 1) + b for k, b in enumerate(bins)}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_rows(spark, folder):
    scored = QUERIES["op13_quality"](spark, folder)
    assert scored.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in scored.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert sum(y == p for y, p in held) >= 0.95 * len(held)


def test_odd_rows_and_bounds(spark):
    good, bad = "all is well and reads well here", "WIN!! CASH!! NOW!! WIN!!"
    rows = [(k, f"{good if k % 4 else bad} {'w' * (k % 7 + 1)}", "s", 30 + k, "mine", 0.5) for k in range(160)]
    rows += [(None, good, None, None, None, None), (500, None, None, None, None, None), (501, "", None, -4, None, None), (502, " \n", None, 3, None, None), (7, rows[7][1], None, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _text string, score double").coalesce(2)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(160)] + [(3, 0), (None, 1), (9, None), (999, 1)], "doc_id long, quality int")
    model = QualityMachine(steps=60, min_z=2.0, max_rows=100).fit(docs, labels)
    out = model.transform(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.collect()
    assert len(got) == len(rows)
    assert all((r.score > 0.5) == (r.text or "").startswith("all") for r in got if (r.text or "").strip())
    assert len({round(r.score, 12) for r in got if r.doc_id in (7,) and r.n_chars is not None}) == 2  # metadata is an input
    assert model.sample(docs, labels, "quality", None).count() == 100
    rows_seen = {r["_place"] for r in model.sample(docs, labels, "quality", F.col("doc_id") < 50).collect()}
    assert 0 < len(rows_seen) < 50  # 3, whose labels disagree, is not among them
    one = model.fit(docs, labels.where("quality = 1 AND doc_id <> 3")).transform(docs).select("score").distinct().collect()
    assert len(one) == 1 and one[0][0] > 0.999
    assert QualityMachine().fit(docs.where("doc_id < 0"), labels).transform(docs.where("doc_id < 0")).collect() == []
    assert QualityMachine(meta_cols=()).fit(docs, labels).transform(docs.drop("n_chars")).count() == len(rows)
    with pytest.raises(ValueError):
        QualityMachine().transform(docs)
