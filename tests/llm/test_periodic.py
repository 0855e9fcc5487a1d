"""Periodic runs against brute force, and the query against its contract in plain Python."""

import hashlib
import random
import re
import time
import zlib

import pyarrow as pa
import pytest

from lattica.llm.periodic import PeriodicRuns, Rolling, Suffixes, find_runs
from lattica.llm.queries import QUERIES
from lattica.llm.tokens import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(ws, min_length, min_exponent):
    """(start, length, period) of every run, by its definition."""
    out = []
    for q in range(1, len(ws) // min_exponent + 1):
        x = 0
        while x + q < len(ws):
            y = x
            while y + q < len(ws) and ws[y] == ws[y + q]:
                y += 1
            own = ws[x : y + q]
            if len(own) >= max(min_length, min_exponent * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((x, len(own), q))
            x = max(x + 1, y)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(ws, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for x, w in enumerate(ws) if x not in gone)


def of(texts, min_length, min_exponent):
    w = words(pa.array(texts, pa.string()))
    found = find_runs(w, min_length, min_exponent)
    return [[(s - b, e - s, p) for s, e, p in found.tolist() if b <= s < c] for b, c in zip(w.first.tolist(), w.first.tolist()[1:], strict=False)]


@pytest.mark.parametrize(("min_length", "min_exponent"), [(2, 2), (6, 4), (3, 3), (9, 2)])
def test_runs_against_brute_force(min_length, min_exponent):
    rng = random.Random(min_length * 10 + min_exponent)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(6)):
            own = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randrange(70))]
            if own and rng.random() < 0.5:
                a = rng.randrange(len(own))
                p = 1 + rng.randrange(max(1, (len(own) - a) // 2))
                own = [own[a + (i - a) % p] if i >= a else x for i, x in enumerate(own)]
            texts.append(own)
        assert of([" ".join(t) for t in texts], min_length, min_exponent) == [brute(t, min_length, min_exponent) for t in texts]


@pytest.mark.parametrize("kind", ["one word", "Fibonacci", "Thue-Morse", "squares"])
def test_texts_that_compare_at_length(kind):
    a, b, morse = "a", "b", "a"
    while len(a) < 900:
        a, b = a + b, a
    while len(morse) < 700:
        morse += morse.translate(str.maketrans("ab", "ba"))
    text = {"one word": "a" * 900, "Fibonacci": a, "Thue-Morse": morse, "squares": "abcab" * 90 + "c" + "abcab" * 70}[kind]
    began = time.perf_counter()
    assert of([" ".join(text)], 2, 2)[0] == brute(text, 2, 2)
    assert time.perf_counter() - began < 60


def test_words_decide_where_hashes_fail(monkeypatch):
    texts = ["a b c d e f a b c d e f", "x " * 9, "p q p q p r p q p q p q p q", "m n o m n o m n o m n o k"]
    want = [brute(t.split(), 2, 2) for t in texts]
    w = words(pa.array(texts, pa.string()))
    w.hash = w.hash % 3  # most words share a hash with another one
    found = find_runs(w, 2, 2)
    assert [(s, e - s, p) for s, e, p in found.tolist()] == [(s + int(b), n, p) for b, runs in zip(w.first, want, strict=False) for s, n, p in runs]
    monkeypatch.setattr(Rolling, "same", lambda self, a, b, n: True)  # every comparison of hashes says yes: the words are asked
    import numpy as np

    codes = np.array([0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 6, -1])
    assert Suffixes(codes, np.array([12]), Rolling(np.arange(13))).common(0, 6) == 5


def test_columns_and_odd_rows(spark):
    texts = ["go " * 10, "go  go\tgo\ngo go go", None, "", " \n ", "a b a b a b a b a b c", "a b a b a b a b a b c", "x y " * 7, "w" * 100_000 + " " + "z " * 50_000]
    rows = [(k if k != 1 else None, t, "x", 5) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n long")
    got = PeriodicRuns().transform(docs, carry=["doc_id", "n", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = WORD.findall(r.text or "")
        runs = [(0, 10, 1)] if r.text == texts[0] else [(1, 50_000, 1)] if len(ws) > 10_000 else brute(ws, 6, 4)
        assert (r.n_words, [tuple(x) for x in r.runs], r.kept_text) == (len(ws), runs, collapse(ws, runs))
    assert PeriodicRuns().transform(docs.where("n < 0")).collect() == []
    with pytest.raises(ValueError):
        PeriodicRuns(min_exponent=1)


def test_query_of_whole_texts(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([0, 1, 2, 5, 9, 40, 90])))) for k in range(1500)] + [(1500, None), (None, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    sha, some = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for d, text in rows:
        ws, h = WORD.findall(text or ""), zlib.crc32(str(d).encode()) if d is not None else 1
        g = h // 10
        if h % 10 == 0 and ws:
            a = g % len(ws)
            p = 1 + (len(ws) - a) // (3 + g % 8)
            ws = [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]
        runs = brute(ws, 6, 4)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        some += bool(runs)
        want = (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapse(ws, runs)))
        assert tuple(got[d]) == want
    assert some > 10
