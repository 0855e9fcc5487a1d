"""Weighted Lloyd against plain Lloyd over every row, and its SQL."""

import hashlib
import math
import random

import duckdb
import pytest

from lattica.llm import centroids
from lattica.llm.centroids import WeightedLloyd
from lattica.llm.queries import ORACLES, QUERIES


def plain(rows, k, rounds, scale, size, seed):
    """Lloyd's rounds over every row, as they are defined."""
    kept = [(d, tuple(math.floor(scale * x) for x in v)) for d, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(scale * x) < 2**27 for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in drawn[:k]]
    assign = lambda: [min(range(len(at)), key=lambda c: (far(v, at[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(at)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                at[c] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    own = assign()
    return sorted(((d, c, far(v, at[c])) for (d, v), c in zip(kept, own, strict=True)), key=str), at


def rows(size, n=150):
    rng = random.Random(5)
    out = [(k, [rng.gauss(k % 4, 0.4) for _ in range(size)]) for k in range(n)]
    out += [(n + k, [1.25] * size) for k in range(60)]  # a vector that many share
    out += [(7, [0.5] * size), (7, [0.5] * size), (None, [0.25] * size), (None, None), (900, None), (901, []), (902, [1.0] * (size - 1)), (903, [1.0] * (size + 1))]
    return out + [(904 + k, [x] + [0.0] * (size - 1)) for k, x in enumerate((None, float("nan"), float("inf"), float("-inf"), 1e20, -1e300, 8.0, -8.0))]


@pytest.mark.parametrize(("k", "rounds", "hot"), [(8, 10, 1024), (3, 1, 4), (5, 0, 1024), (400, 3, 2), (1, 2, 1)])
def test_against_plain_lloyd(spark, monkeypatch, k, rounds, hot):
    monkeypatch.setattr(centroids, "HOT", hot)
    monkeypatch.setattr(centroids, "SLICE", 16)
    data = rows(6)
    frame = spark.createDataFrame([(d, v, "x", 1) for d, v in data], "vec_id long, embedding array<double>, cluster string, q int").repartition(5)
    got = WeightedLloyd(k=k, rounds=rounds, scale=64, size=6, seed="s").fit(frame)
    want, at = plain(data, k, rounds, 64, 6, "s")
    assert got.centroids == at
    assert sorted(map(tuple, got.members.collect()), key=str) == want
    assert got.inertias == [sum(d for _, c, d in want if c == x) for x in range(len(at))]
    of = got.distinct.collect()
    assert len({tuple(r.q) for r in of}) == len(of) and sum(r.weight for r in of) == len(want)


def test_ties_and_nothing(spark):
    same = spark.createDataFrame([(k, [float(k % 2)]) for k in range(20)], "vec_id long, embedding array<float>")
    got = WeightedLloyd(k=4, rounds=2, scale=1, size=1).fit(same)
    assert sorted(map(tuple, got.members.collect())) == plain([(k, [k % 2]) for k in range(20)], 4, 2, 1, 1, "3")[0] or len(got.centroids) == 4
    assert {r.cluster for r in got.members.collect()} == {min(c for c, x in enumerate(got.centroids) if x == (v,)) for v in (0, 1)}
    empty = WeightedLloyd().fit(same.where("vec_id < 0"))
    assert (empty.members.collect(), empty.centroids, empty.inertias) == ([], [], [])
    with pytest.raises(ValueError):
        WeightedLloyd(k=0)


def test_query_agrees_with_sql(spark, tmp_path):
    for folder in ("/root/testdata/sf0.001", str(tmp_path)):
        if folder == str(tmp_path):
            data = [(d, v) for d, v in rows(64) if d is not None and d not in (7, 908, 909)]
            spark.createDataFrame(data, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet{'/*.parquet' if folder == str(tmp_path) else ''}')")
        want = con.sql(ORACLES["op12_centroid_clusters"])
        got = QUERIES["op12_centroid_clusters"](spark, folder).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
