"""Text operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.decontaminate import Decontaminator, tile
from lattica.llm.lm_score import StupidBackoff
from lattica.llm.mix import SourceMix
from lattica.llm.ngram_jaccard import NgramJaccardJoin
from lattica.llm.substring_dedup import SubstringDedup
from lattica.llm.token_rollup import TokenRollup, bpe_tokens, quarter_tokens, word_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, _batch string"


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "x y", "a b"]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base, texts = line(60), line(150), []
    for k in range(60):
        own = line(rng.choice([0, 1, 3, 4, 5, 12, 13, 14, 30, 90]))
        if k % 4 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[rng.randrange(20) :]
        if k % 5 == 1:
            own = list(base)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(len(own))] = "edit"
        texts.append(rng.choice([" ", "\n", " \t"]).join(own))
    texts += [None, "", " \n ", texts[1], texts[1], "Zebra " * 3000, " ".join(base).upper()]
    rows = [(k * 3, t, "en", None if k % 9 == 0 else f"s{k % 4}", 1, "x", "y", "z") for k, t in enumerate(texts)]
    return rows + [(None, texts[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def test_substring_dedup(docs, none):
    got = SubstringDedup(13).transform(docs, carry=["doc_id", "text", "n_words"])
    assert got.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text", "removed"]
    words = [(r[0], WORD.findall(r[1] or "")) for r in corpus()]
    key = lambda d: (d is None, d)
    least = {}
    for d, w in sorted(words, key=lambda r: (r[0] is None, r[0] or 0)):
        for s in range(len(w) - 12):
            least.setdefault(tuple(w[s : s + 13]), key(d))
    want = []
    for d, w in words:
        gone = {p for s in range(len(w) - 12) if least[tuple(w[s : s + 13])] != key(d) for p in range(s, s + 13)}
        want.append((str(d), len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone), sorted(gone)))
    rows = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_text, [p for a, b in r.removed for p in range(a, b)]) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    assert sum(r[2] for r in rows) > 500
    assert SubstringDedup(13).transform(none).count() == 0


def brute_classes(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("levels", [1, 4])
def test_ngram_jaccard(docs, none, levels):
    want = brute_classes([r for r in corpus() if r[0] is not None])
    got = NgramJaccardJoin(levels=levels).classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert len(set(c for _, c in want.values())) < len(want) - 5
    if levels == 4:
        assert NgramJaccardJoin().classes(none).count() == 0


def test_ngram_jaccard_of_many_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(own)))
    got = NgramJaccardJoin().classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_classes(rows)


def test_near_copies_that_miss_their_centres_meet_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base, rows, met = [f"b{k}" for k in range(150)], [], []
    for k in range(400):
        own, at = list(base), rng.randrange(150)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            own[(at + rng.randrange(60)) % 150] = f"e{rng.randrange(2000)}"
        rows.append((k, " ".join(own)))
    matches = NgramJaccardJoin._matches

    def counted(self, postings, apart):
        pairs = matches(self, postings, apart)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(NgramJaccardJoin, "_matches", counted)
    got = NgramJaccardJoin().classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_classes(rows)
    assert met[0] < len(rows) * (len(rows) - 1) / 20, "a tenth of all pairs"


def test_every_link_is_found(spark):
    rng = random.Random(9)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(120):
        own = list(base)
        for _ in range(rng.randrange(7)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(own)))
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, "a lone line"), (203, ""), (204, None), (None, rows[3][1])]
    sets = {d: {tuple(w[p : p + 5]) for p in range(max(len(w) - 4, min(len(w), 1)))} for d, t in rows if d is not None for w in [(t or "").lower().split()]}
    like = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    rep = {d: min(e for e in sets if sets[e] == sets[d]) if sets[d] else None for d in sets}
    links, counts = NgramJaccardJoin().linked(spark.createDataFrame(rows, "doc_id long, text string"))
    first = sorted({r for r in rep.values() if r is not None})
    want = {(a, b) for a in first for b in first if a < b and like(sets[a], sets[b])}
    assert len(want) > 300 and sorted(tuple(r) for r in links.select("a", "b").collect()) == sorted(want)
    got = {r.doc_id: (r.n_shingles, r.rep, r.n_links) for r in counts.collect()}
    assert got.pop(None)[1:] == (None, 0)
    assert got == {d: (len(sets[d]), rep[d], sum(1 for e in sets if e != d and like(sets[d], sets[e]))) for d in sets}


def test_components(spark):
    links = [(k, k + 1) for k in range(20)] + [(31, 30), (30, 31), (33, 30), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(21), 0) | dict.fromkeys((30, 31, 33), 30)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, none):
    items = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "one two three", None, "", "w1 w2 never seen anywhere at all"]
    bench = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    w = items[0].split()
    planted = [(9001, "intro " + " ".join(w) + " outro"), (9002, " ".join(w[6:]).upper() + " between " + " ".join(w[:6])), (9003, " ".join(w[:5])), (9004, "say ONE two three now"), (None, items[0])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = [sorted((str(r.doc_id), r.item_id, r.covered_words, r.n_tiles) for r in Decontaminator(broadcast_bytes=b).leaks(both, bench).collect()) for b in (1 << 20, 100)]
    assert found[0] == found[1] == sorted([("9001", 0, 12, 1), ("9002", 0, 12, 2), ("9004", 1, 3, 1), ("None", 0, 12, 1)])
    assert Decontaminator().leaks(none, bench).count() == 0
    assert Decontaminator().leaks(both, bench.where("1 = 0")).count() == 0


def test_tiles_take_the_longest_first():
    import numpy as np

    number = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert tile(number("abcdXefgh"), number("efghabcd"), 3) == [(5, 0, 4), (0, 4, 4)]
    assert tile(number("ababab"), number("abab"), 2) == [(0, 0, 4)]
    assert tile(number("xyz"), number(""), 2) == []


def brute_tiles(x, y, shortest):
    """Greedy string tiling by comparing all places."""
    shortest = max(1, min(shortest, len(y)))
    free_x, free_y, tiles = [True] * len(x), [True] * len(y), []
    while True:
        best, found = shortest - 1, []
        for j in range(len(y)):
            for i in range(len(x)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and free_x[i + n] and free_y[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= shortest:
                    found.append((i, j, n))
        for i, j, n in found:
            if all(free_x[i : i + n]) and all(free_y[j : j + n]):
                free_x[i : i + n] = free_y[j : j + n] = [False] * n
                tiles.append((i, j, n))
        if not found:
            return tiles


def test_tiles_against_brute_force():
    import time

    import numpy as np

    rng = random.Random(12)
    for k in range(150):
        x, y = ([rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(40))] for _ in range(2))
        assert tile(np.array(x, np.uint64), np.array(y, np.uint64), 1 + k % 4) == brute_tiles(x, y, 1 + k % 4)
    begun = time.process_time()
    assert tile(np.zeros(20_000, np.uint64), np.zeros(200, np.uint64), 5) == [(0, 0, 200)]
    assert len(tile(np.arange(20_000, dtype=np.uint64) % 7, np.arange(200, dtype=np.uint64) % 5, 3)) > 10
    assert time.process_time() - begun < 1


def test_leaks_against_brute_force(spark):
    rng = random.Random(13)
    line = lambda n: [f"v{rng.randrange(40)}" for _ in range(n)]
    items = [(k, " ".join(line(rng.randrange(1, 30)))) for k in range(25)] + [(90, "Common opening words here then " + " ".join(line(9))), (91, "common opening words HERE then " + " ".join(line(30)))]
    docs = [(k, " ".join(line(20) + rng.choice(items)[1].split()[rng.randrange(6) :] + line(20))) for k in range(60)] + [(60, "x common opening words here then x"), (60, "again " + items[3][1]), (61, "w " * 5000)]
    want = []
    for d, text in docs:
        for i, item in items:
            x, y = text.lower().split(), item.lower().split()
            near = {tuple(x[p : p + min(5, len(y))]) for p in range(len(x))} & {tuple(y[p : p + min(5, len(y))]) for p in range(len(y) - min(5, len(y)) + 1)}
            tiles = brute_tiles(x, y, 5) if near else []
            covered = sum(n for _, _, n in tiles)
            if tiles and covered >= 0.5 * len(y):
                want.append((d, i, len(y), covered, len(tiles)))
    for most in (1 << 20, 300):
        got = Decontaminator(broadcast_bytes=most).leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted((r.doc_id, r.item_id, r.item_words, r.covered_words, r.n_tiles) for r in got.collect()) == sorted(want)
    assert len(want) > 30


def test_messages_stay_in_proportion():
    from lattica.llm.exchange import Plan

    for tera in (0.001, 0.01, 0.1, 1, 10, 100):
        size = int(tera * 1e12)
        how = Plan.of(size, 200)
        entries = size / 4
        assert entries / how.messages(size) > 60  # so a message's own row weighs little beside them
        assert size / how.batch_bytes / how.batch_parts <= 8.01 and how.buckets / how.bucket_parts <= 4.01
        assert how.batch_bytes <= 100 << 20


def test_batches_are_bounded_by_rows_and_bytes(spark):
    from lattica.llm import exchange as X

    def seen(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        how = X.Plan(1 << 16, 4, 2, 2)
        def count(key, batch):
            table = X.rows(batch)
            return __import__("pyarrow").table({"n": [table.num_rows], "b": [table.column("text").nbytes]})

        read = X.dealt(docs, how, "text").groupBy("_batch").applyInArrow(count, "n long, b long")
        return [(r.n, r.b) for r in read.collect()]

    same = seen([(None, "the same words " * 20)] * 2000)  # one id, one text: batches like any other
    assert sum(n for n, _ in same) == 2000 and max(b for _, b in same) <= 1 << 16
    counts = [len(seen([(k, f"text {k} " * 60) for k in range(n)])) for n in (1000, 4000)]
    assert 3.3 < counts[1] / counts[0] < 4.7
    odd = " ".join(str(k * 7919) for k in range(300_000))  # of several parts even when compressed
    assert max(b for _, b in seen([(1, odd), (2, None), (3, "")])) > len(odd)


def test_mix_against_brute_force(docs):
    import math
    from collections import Counter

    from lattica.llm import mix as M

    mix = SourceMix(block=4, run=16, slice_rows=5)
    sized = mix.sized(docs).cache()
    targets = sorted(mix.targets(sized).collect(), key=lambda t: t.number)
    step, points = (M.GOLDEN >> (64 - M.POINT_BITS)) | 1, []
    total, edges = sum(t.need for t in targets), [0.0]
    for t in targets:
        edges.append(edges[-1] + t.need)
    for slot in range(math.ceil(total)):
        p = (slot * step % (1 << M.POINT_BITS)) / (1 << M.POINT_BITS)
        points.append(max(t.number for t in targets if t.need > 0 and edges[t.number] / total <= p))
    got = Counter(points)
    uses = {}
    for t in targets:
        for rank in range(t.slots):  # those beyond the points given are made up
            uses[t.number, rank % t.blocks] = uses.get((t.number, rank % t.blocks), 0) + 1
    assert {n: got[n] for n in got} == pytest.approx({t.number: t.need for t in targets if t.need > 0}, abs=3)
    want, number = {}, {t.source: t for t in targets}
    begin = Counter()
    for r in sorted((r for r in sized.collect() if r["size"]), key=lambda r: ((r.order % (1 << 64)) >> 24, r.order)):
        t = number[r.source]
        least, longer = divmod(t.source_size, t.blocks)
        starts = [k * least + min(k, longer) for k in range(t.blocks + 1)]
        at = begin[r.source]
        want[r._row] = sum(uses.get((t.number, k), 0) for w in range(at, at + r["size"]) for k in range(t.blocks) if starts[k] <= w < starts[k + 1])
        begin[r.source] += r["size"]
    assert {r._row: r.taken for r in mix.takes(docs).collect() if r["size"]} == want


def test_source_mix(docs, none):
    rows = SourceMix(block=8).takes(docs).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    names = sorted(by, key=lambda s: (s is None, s))
    sizes = {s: sum(r.size for r in by[s]) for s in names}
    free, targets = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}
    while True:
        rest, weight = 1.5 * sum(sizes.values()) - sum(targets.values()), sum(free.values())
        over = [s for s in free if rest * free[s] / weight > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            targets[s] = 2 * sizes[s]
            del free[s]
    targets |= {s: rest * free[s] / weight for s in free}
    for s in names:
        assert {r.source_size for r in by[s]} == {sizes[s]}
        assert by[s][0].target == pytest.approx(targets[s])
        assert sum(r.taken for r in by[s]) == pytest.approx(targets[s], abs=4)
    again = SourceMix(block=8, slice_rows=7, broadcast_rows=0).takes(docs.repartition(2)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in rows) == sorted((str(r.doc_id), r.taken) for r in again)
    assert SourceMix().takes(none).count() == 0


def test_mix_of_many_tiny_sources_and_repeated_rows(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 130)), f"s{k // 2:05d}") for k in range(12_000)]
    rows += [(None, "same words again", None)] * 3000 + [(7, None, "empty"), (8, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    got = SourceMix().takes(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and len(sizes) == 6002 and taken["empty"] == target["empty"] == 0
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert max(abs(taken[s] - target[s]) for s in sizes) <= 33  # half a block
    full = [s for s in sizes if target[s] == 2 * sizes[s]]
    assert len(full) > 1000 and all(taken[s] == 2 * sizes[s] for s in full)


def test_schedule_is_even(docs):
    mix = SourceMix(block=4, run=16)
    targets = mix.targets(mix.sized(docs.where("source IS NOT NULL"))).cache()
    rows, own = mix.schedule(targets).orderBy("slot").collect(), {t.number: t for t in targets.collect()}
    total, ranks = sum(t.need for t in own.values()), {}
    for k, r in enumerate(rows):
        assert r.rank == ranks.get(r.number, 0) and r.block_no == r.rank % own[r.number].blocks
        ranks[r.number] = r.rank + 1
        assert all(ranks.get(n, 0) == pytest.approx((k + 1) * t.need / total, abs=4) for n, t in own.items())
    assert ranks == {n: t.slots for n, t in own.items()} and len({r.slot for r in rows}) == len(rows)


def test_token_rollup(spark, docs, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup", {"words": word_tokens, "quarters": quarter_tokens})
    assert rollup.totals().count() == 0
    counted = rollup.counted(docs, text="text", longer=F.concat("text", F.lit(" more")))
    assert rollup.apply("all", rollup.changes(counted, 1))
    assert not rollup.apply("all", rollup.changes(counted, 1))
    gone, poor = counted.where("source = 's1'"), counted.where("source = 's2'")
    place = tmp_path / "rollup" / "claims" / rollup._name("gone")
    place.write_text("{")  # a crash left a claim without its content
    assert rollup.apply("gone", rollup.changes(gone, -1)) and not rollup.apply("gone", rollup.changes(gone, -1))
    assert rollup.apply("revised", rollup.revision(poor, "text", "longer"))
    assert rollup.apply("nothing", rollup.changes(counted.where("1 = 0"), 1))
    assert not rollup._claim(rollup._name("gone"), {"gone": "elsewhere"})
    assert rollup.changes(counted, 1, among=docs.where("doc_id < 10")).count() == 2 * docs.where("doc_id < 10").count()
    want = {}
    for r in corpus():
        if r[3] != "s1":
            text = r[1] + " more" if r[3] == "s2" and r[1] is not None else r[1]
            for name, n in (("words", len(WORD.findall(text or ""))), ("quarters", -(-len((text or "").encode()) // 4))):
                d, t = want.get((r[3], r[2], name), (0, 0))
                want[r[3], r[2], name] = (d + 1, t + n)
    read = lambda x: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in x.totals().collect()}
    assert read(rollup) == want
    compacted = rollup.compact()
    assert read(compacted) == want and not compacted.apply("gone", rollup.changes(gone, -1))
    assert compacted.apply("again", rollup.changes(gone, 1)) and read(compacted) != want


def test_bpe_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    count = bpe_tokens(spark, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    rows = spark.createDataFrame([("hello world",), ("",), (None,)], "text string").select(count(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [2, 0, 0]


def test_lm_score(docs, none):
    import math
    from collections import Counter

    rows = [(str(r[0]), WORD.findall(r[1] or "")) for r in corpus()]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in (1, 2, 3)] for _, w in rows]
    total = [sum((g[k] for g in grams), Counter()) for k in range(3)]
    n = sum(len(w) for _, w in rows)
    want = []
    for (d, w), own in zip(rows, grams, strict=True):
        seen = lambda *g: total[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for i in range(len(w)):
            top = min(i + 1, 3)
            for k in range(top, 0, -1):
                if k == 1:
                    s = max(seen(w[i]), 1) / max(n - len(w), 1)
                elif seen(*w[i - k + 1 : i + 1]) > 0:
                    s = seen(*w[i - k + 1 : i + 1]) / seen(*w[i - k + 1 : i])
                else:
                    continue
                score += math.log(s) + (top - k) * math.log(0.4)
                break
        want.append((d, len(w), round(score, 5)))
    got = [(str(r.doc_id), r.n_words, round(r.score, 5)) for r in StupidBackoff().score(docs).collect()]
    assert sorted((a, b) for a, b, _ in got) == sorted((a, b) for a, b, _ in want)
    for g, x in zip(sorted(got), sorted(want), strict=True):
        assert g[2] == pytest.approx(x[2], abs=1e-3)
    assert StupidBackoff().score(none).count() == 0
    rowwise = [(str(r.doc_id), r.n_words, r.score, r.n_full) for r in StupidBackoff().score_rows(docs).collect()]
    for a, b in zip(sorted(rowwise), sorted((str(r.doc_id), r.n_words, r.score, r.n_full) for r in StupidBackoff().score(docs).collect()), strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and a[2] == pytest.approx(b[2], abs=1e-6)
    assert StupidBackoff().score_rows(none).count() == 0
