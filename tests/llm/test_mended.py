"""Faults found in review, each with the case that showed it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm.decontaminate import Decontaminator
from lattica.llm.ngram_jaccard import NgramJaccardJoin
from lattica.llm.token_rollup import StoreClosed, TokenRollup, word_tokens
from lattica.llm.topk import ExactTopK
from lattica.llm.toxicity import risk, slopes


def test_a_batch_that_meets_a_compaction_counts_once(spark, tmp_path, monkeypatch):
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup", {"words": word_tokens})
    row = lambda n: spark.createDataFrame([("s", "en", "words", n, 10 * n)], "source string, lang string, tokenizer string, docs long, tokens long")
    read = lambda store: [tuple(r)[3:] for r in store.totals().collect()]
    assert rollup.apply("first", row(1))
    claims = TokenRollup._claims

    def meanwhile(self):
        seen = claims(self)
        monkeypatch.setattr(TokenRollup, "_claims", claims)
        place = "deltas/late"  # a batch that had written its rows commits just after the claims are read
        row(1).write.parquet(f"{self.path}/{place}")
        assert self._claim(self._name("late"), {"late": place})
        with pytest.raises(StoreClosed):
            self._refuse_closed()
        return seen

    monkeypatch.setattr(TokenRollup, "_claims", meanwhile)
    new = rollup.compact()
    assert read(new) == [(1, 10)]
    assert new.apply("late", row(1)) and not new.apply("late", row(1)) and not new.apply("first", row(1))
    assert read(new) == [(2, 20)]
    with pytest.raises(StoreClosed, match=new.path):
        rollup.apply("more", row(1))
    again = rollup.compact()  # another compaction ends in the same store
    assert again.path == new.path and read(again) == [(2, 20)]


def test_scores_have_64_bits(spark):
    most = math.sqrt(2.0**62 / 2) - 1
    edge = math.floor(most) - 1
    rows = [(1, [1e20, 0.0]), (2, [-1e300, 0.0]), (3, [float(edge), float(edge)]), (4, [-float(edge), -float(edge)]), (5, [1.0, 2.0]), (6, [2.0 * edge, 1.0]), (7, [1e16, 1e-300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[:4] for r in ExactTopK(k=9, scale=1).transform(frame, frame).collect()]
    own = {d: [math.floor(x) for x in v] for d, v in rows if all(abs(x) < most for x in v)}
    assert set(own) == {3, 4, 5}
    want = []
    for q, v in own.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), d) for d, w in own.items() if d != q)
        want += [(q, k + 1, d, -s) for k, (s, d) in enumerate(best)]
    assert sorted(got) == sorted(want) and max(abs(s) for *_, s in want) > 2**61


def test_benchmark_parts_are_bounded(spark):
    item = "one passage that all of these two hundred equal rows hold word for word"
    rows = [(1, item)] * 200 + [(k, f"{item} {k}") for k in range(2, 60)] + [(99, "long " * 900)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    operator = Decontaminator(broadcast_bytes=2000)
    sizes = [[len(r.text) + 16 for r in part.collect()] for part in operator.parts(items)]
    assert all(sum(s) <= 2000 or len(s) == 1 for s in sizes) and sum(map(len, sizes)) == len(rows)
    docs = spark.createDataFrame([(5, f"so {item} it says"), (6, "nothing of it")], "doc_id long, text string")
    key = lambda leaks: sorted((r.doc_id, r.item_id, r.covered_words) for r in leaks.collect())
    assert key(operator.leaks(docs, items)) == key(Decontaminator().leaks(docs, items)) and len(key(operator.leaks(docs, items))) == 258


def test_every_verified_pair_shares_prefixes(spark, monkeypatch):
    rng, seen = random.Random(12), []
    base, rows = [f"b{k}" for k in range(90)], []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randrange(14)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(60)}"
        rows.append((k, " ".join(own)))
    whole = NgramJaccardJoin._candidates

    def kept(self, pairs, sets):
        out = whole(self, pairs, sets)
        seen.extend(out.collect())
        return out

    monkeypatch.setattr(NgramJaccardJoin, "_candidates", kept)
    NgramJaccardJoin().classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(seen) > 200
    spared = links = 0
    for r in seen:
        a, b, level = set(r.hashes_a), set(r.hashes_b), min(r.chosen_a, r.chosen_b)
        overlap = -(-75 * (len(a) + len(b)) // 175)
        prefix = [{x for k, x in enumerate(own) if rest - k + level - 1 >= overlap} for own, rest in ((r.prefix_a, r.rest_a), (r.prefix_b, r.rest_b))]
        assert (r.need, r.shared) == (level, len(prefix[0] & prefix[1]))
        linked = 100 * len(a & b) >= 75 * len(a | b)
        assert not linked or r.shared >= r.need  # what shares too few can't link
        spared, links = spared + (r.shared < r.need), links + linked
    assert spared > 0 and links > 50


def test_risk_and_its_slopes():
    rng = np.random.default_rng(5)
    for prior, shift in ((0.1, 0.0), (0.6, -2.0), (0.9, -3.0)):
        zp, zu = rng.normal(1, 1, 7), rng.normal(shift, 1, 11)
        s = lambda z: 1 / (1 + math.exp(-z))
        bracket = lambda zp, zu: sum(map(s, zu)) / len(zu) - prior * sum(map(s, zp)) / len(zp)
        whole = lambda zp, zu: prior * sum(s(-z) for z in zp) / len(zp) + max(0.0, bracket(zp, zu))
        value, inner = risk(zp, zu, prior)
        assert value == pytest.approx(whole(zp, zu)) and inner == pytest.approx(bracket(zp, zu))
        descended = whole if inner >= 0 else lambda zp, zu: -bracket(zp, zu)
        for own, z, k in ((slopes(zp, zu, prior)[0], zp, 0), (slopes(zp, zu, prior)[1], zu, 1)):
            for i in range(len(z)):
                e = np.zeros_like(z)
                e[i] = 1e-6
                up, down = ((zp + e, zu), (zp - e, zu)) if k == 0 else ((zp, zu + e), (zp, zu - e))
                assert own[i] == pytest.approx((descended(*up) - descended(*down)) / 2e-6, abs=1e-6)
    assert risk(zp, zu, 0.9)[1] < 0, "the case that is cut off at 0 is among them"


def test_pipeline_keeps_columns_of_its_own_names(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(k, " ".join(f"p{rng.randrange(3000)}" for _ in range(40)), "en", f"s{k % 2}", 5, f"row {k}", float(k), "x") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, _score double, _ROW_ string")
    for name, frame in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, str(tmp_path))
        assert out.columns == docs.columns + (["target", "taken"] if name == "mixing" else [])
        assert {(r.doc_id, r["_row"], r["_score"]) for r in out.collect()} <= {(r[0], r[5], r[6]) for r in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.col("_row"), F.col("_score"))
    assert {tuple(r) for r in got.collect()} <= {(r[0], r[5], r[6]) for r in rows} and got.count() > 6


def test_copies_meet_without_their_payloads(spark, tmp_path):
    from lattica.llm import warc
    from lattica.llm.shared import cut

    rows = [(k, f"http://h/{k}", "x" * 1500 if k % 3 == 0 else "y" * (900 + k) + str(k % 5)) for k in range(40)] + [(39, "http://h/again", "x" * 1500), (None, None, "x" * 1500), (90, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = []
    for most in (1 << 20, 0):
        archive = warc.PageArchive(broadcast_bytes=most)
        archive.write(pages, f"file://{tmp_path}/{most}", cut)
        got.append(sorted(map(str, archive.read(spark, f"file://{tmp_path}/{most}").collect())))
    assert got[0] == got[1] and sum("'revisit'" in r for r in got[0]) == 15
    plan = warc.PageArchive(broadcast_bytes=0).records(pages, cut)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (_place" in plan
