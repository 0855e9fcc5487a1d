import pytest
from pyspark.sql import functions as F

from lattica.errors import InvalidFile, InvalidFileFormat
from lattica.sources import mtx
from lattica.streaming.accumulate import accumulate, accumulate_windows, compact, finals, latest, merged, start, start_final, start_merged
from lattica.types import CooMatrix


def write(folder, name, body):
    path = folder / name
    path.write_text(body)
    return str(path)


def rows(a):
    return sorted(map(tuple, a.df.collect()))


def test_reads_byte_ranges(spark, tmp_path):
    body = "".join(f"{k % 7 + 1} {k + 1} {k}.5\n" for k in range(300))
    path = write(tmp_path, "big.mtx", f"%%MatrixMarket matrix coordinate real general\n% a\n%b\n7 300 300\n{body}")
    mtx.register(spark)
    got = sorted(map(tuple, spark.read.format("mtx").option("range_bytes", 100).load(path).collect()))
    assert got == sorted((k % 7, k, k + 0.5) for k in range(300))


def test_mixed_case_duplicates_and_zeros(spark, tmp_path):
    path = write(tmp_path, "a.mtx", "%%MatrixMarket MATRIX Coordinate INTEGER General\n2 2 3\n1 2 7\n1 2 1\n2 1 0\n")
    assert rows(mtx.read_coo(spark, path)) == [(0, 1, 1.0), (0, 1, 7.0), (1, 0, 0.0)]
    assert rows(mtx.read_coo(spark, path, zeros=False, dup="sum")) == [(0, 1, 8.0)]
    header = mtx.read_header(path)
    assert (header.m, header.n, header.nnz, header.field) == (2, 2, 3, "integer")


def test_seeded_patterns(spark, tmp_path):
    path = write(tmp_path, "p.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")
    assert [r[:2] for r in rows(mtx.read_coo(spark, path))] == [(0, 0), (0, 1), (1, 0)]
    one, two = (rows(mtx.read_coo(spark, path, pattern="rand", seed=5)) for _ in range(2))
    assert one == two and one[1][2] == one[2][2] and 0 <= one[0][2] < 1


@pytest.mark.parametrize("banner", ["matrix array real general", "matrix coordinate complex general", "matrix coordinate real"])
def test_rejects_banners(tmp_path, banner):
    with pytest.raises(InvalidFileFormat):
        mtx.read_header(write(tmp_path, "x.mtx", f"%%MatrixMarket {banner}\n1 1 1\n1 1 1\n"))


def test_rejects_names(tmp_path):
    with pytest.raises(InvalidFile):
        mtx.read_header(write(tmp_path, "x.txt", "%%MatrixMarket matrix coordinate real general\n1 1 1\n1 1 1\n"))
    with pytest.raises(InvalidFile):
        mtx.read_header(str(tmp_path / "none.mtx"))


def test_stream_accumulates_over_restarts(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    for k in range(2):
        spark.range(10).select((F.col("id") % 2).alias("i"), (F.col("id") % 3).alias("j"), F.lit(1.0).alias("v")).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("i bigint, j bigint, v double").json(str(source))
        start(accumulate(stream, "i", "j", "v"), str(tmp_path / "out"), state).awaitTermination()
        assert latest(spark, str(tmp_path / "out")).agg(F.sum("v")).first()[0] == 10 * (k + 1)
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    write(tmp_path, "b.mtx", "%%MatrixMarket matrix coordinate integer general\n2 3 2\n1 2 7\n2 1 3\n")
    write(tmp_path / "deep", "a.mtx", "%%MatrixMarket matrix coordinate real symmetric\n3 3 2\n1 1 2\n2 1 -1\n")
    write(tmp_path, "notes.txt", "no matrix")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = mtx.read_folder(spark, path)
        assert [p.rsplit("/", 1)[-1] for p in found] == ["b.mtx", "a.mtx"]
        assert [rows(a) for a in found.values()] == [[(0, 1, 7.0), (1, 0, 3.0)], [(0, 0, 2.0), (0, 1, -1.0), (1, 0, -1.0)]]
    assert list(mtx.list_matrices(str(tmp_path / "b.mtx"))) == [str(tmp_path / "b.mtx")]
    with pytest.raises(InvalidFile):
        mtx.list_matrices(str(tmp_path / "none"))


def test_written_matrices_read_back(spark, tmp_path):
    from lattica.types import CooMatrix

    want = [(0, 1, 0.1), (2, 0, -3e-300), (2, 4, 1e20)]
    mtx.write_mtx(CooMatrix(spark.createDataFrame(want, "i bigint, j bigint, v double"), 3, 5), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("*/part-*"))
    path = write(tmp_path, "whole.mtx", "".join(p.read_text() for p in parts))
    back = mtx.read_coo(spark, path)
    assert (back.m, back.n) == (3, 5) and rows(back) == want


def test_stream_of_windows(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(k, k % 2) for k in range(10)], "t bigint, i bigint").select(F.timestamp_seconds(F.col("t") * 60).alias("ts"), "i").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("ts timestamp, i bigint").json(str(source))
    start(accumulate_windows(stream, "ts", "5 minutes", "1 minute", "i", "i", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r.begin.minute, r.i, r.v) for r in latest(spark, str(tmp_path / "out")).collect())
    assert got == [(0, 0, 3.0), (0, 1, 2.0), (5, 0, 2.0), (5, 1, 3.0)]


def test_saved_matrices_read_back(spark, tmp_path):
    want = [(k % 7, k, (k % 5 - 2) * 0.1 if k % 11 else 1e300) for k in range(400)] + [(6, 3, float("inf")), (0, 399, 5e-324)]
    a = CooMatrix(spark.createDataFrame(want, "i bigint, j bigint, v double").repartition(5), 7, 400)
    path = str(tmp_path / "folder" / "a.mtx")
    mtx.save(a, path, file_entries=30)
    names = [p.name for p in (tmp_path / "folder" / "a.mtx").iterdir()]
    assert len(names) >= 14 and all(n.startswith("part-") and n.endswith(".mtx") for n in names)  # nothing staged is left
    back = mtx.read_coo(spark, path)
    assert (back.m, back.n, rows(back)) == (7, 400, sorted(want))
    mtx.save(CooMatrix(a.df.where("i < 0"), 2, 3), f"file://{tmp_path}/folder/none.mtx")
    found = mtx.read_folder(spark, str(tmp_path / "folder"))
    assert {p.rsplit("/", 1)[1]: (x.m, x.n, x.df.count()) for p, x in found.items()} == {"a.mtx": (7, 400, 402), "none.mtx": (2, 3, 0)}
    assert mtx.list_matrices(path)[path].nnz == 402
    mtx.save(CooMatrix(a.df.where("j < 9"), 7, 400), path, mode="overwrite")
    assert rows(mtx.read_coo(spark, path)) == sorted(r for r in want if r[1] < 9)
    with pytest.raises(InvalidFile, match="2 matrices"):
        mtx.read_coo(spark, str(tmp_path / "folder"))
    (tmp_path / "folder" / "a.mtx" / "odd.mtx").write_text("%%MatrixMarket matrix coordinate real general\n9 9 0\n")
    with pytest.raises(InvalidFileFormat):
        mtx.read_coo(spark, path)


@pytest.mark.parametrize(("field", "symmetry"), [("integer", "symmetric"), ("real", "skew-symmetric"), ("pattern", "general")])
def test_saved_kinds(spark, tmp_path, field, symmetry):
    sign = -1 if symmetry == "skew-symmetric" else 1
    want = {(i, j): float(1 if field == "pattern" else (i + 2 * j + 1) * (sign if i < j else 1)) for i in range(9) for j in range(9) if symmetry == "general" or i > j or i == j and sign > 0}
    if symmetry != "general":
        want |= {(j, i): sign * v for (i, j), v in want.items() if i != j}
    a = CooMatrix(spark.createDataFrame([(i, j, v) for (i, j), v in want.items()], "i bigint, j bigint, v double"), 9, 9)
    mtx.save(a, str(tmp_path / "x.mtx"), field=field, symmetry=symmetry)
    assert {(r.i, r.j): r.v for r in mtx.read_coo(spark, str(tmp_path / "x.mtx")).df.collect()} == want
    with pytest.raises(Exception, match="not supported|not named"):
        mtx.save(a, str(tmp_path / "x.txt"))


def test_failed_writes_leave_nothing(spark, tmp_path):
    good = CooMatrix(spark.createDataFrame([(0, 0, 1.0)], "i bigint, j bigint, v double"), 1, 1)
    mtx.save(good, str(tmp_path / "a.mtx"))
    bad = CooMatrix(spark.range(40).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("j"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("v")), 40, 1)
    with pytest.raises(Exception, match="broken"):
        mtx.save(bad, str(tmp_path / "a.mtx"), mode="overwrite", file_entries=3)
    assert rows(mtx.read_coo(spark, str(tmp_path / "a.mtx"))) == [(0, 0, 1.0)] and len(list((tmp_path / "a.mtx").iterdir())) == 1


def test_conditions_reach_the_reader(spark, tmp_path):
    want = [(k % 50, k // 50, float(k % 13) - 4 if k % 9 else float("nan")) for k in range(1000)]
    mtx.save(CooMatrix(spark.createDataFrame(want, "i bigint, j bigint, v double"), 50, 20), str(tmp_path / "a.mtx"))
    for condition, test in (("i >= 10 AND i < 20 AND j = 3", lambda i, j, v: 10 <= i < 20 and j == 3), ("v < 0", lambda i, j, v: v < 0), ("v > 3", lambda i, j, v: v > 3 or v != v), ("v <> 2 AND j <= 1", lambda i, j, v: v != 2 and j <= 1), ("i + j > 60", lambda i, j, v: i + j > 60), ("v = 5", lambda i, j, v: v == 5)):
        frame = mtx.read_coo(spark, str(tmp_path / "a.mtx")).df
        assert sorted(map(str, frame.where(condition).collect())) == sorted(f"Row(i={i}, j={j}, v={v})" for i, j, v in want if test(i, j, v))
    from pyspark.sql import datasource as D

    reader = mtx.MtxReader({"path": "x"})
    left = list(reader.pushFilters([D.GreaterThan(("i",), 4), D.IsNotNull(("j",)), D.GreaterThan(("v",), 1.0), D.LessThan(("v",), 9.0), D.EqualTo(("i",), True)]))
    assert reader.where == [("i", "greater", 4), ("v", "less", 9.0)] and len(left) == 2


def test_final_windows_leave_the_state(spark, tmp_path):
    source, query = tmp_path / "in", None
    for day in range(4):  # a batch for each day, five days apart
        spark.createDataFrame([(day * 5 * 86400 + 60 * k, k % 2) for k in range(10)] + ([(0, 9)] if day == 3 else []), "t bigint, i bigint").select(F.timestamp_seconds("t").alias("ts"), "i").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("ts timestamp, i bigint").json(str(source))
        query = start_final(accumulate_windows(stream, "ts", "1 day", "1 hour", "i", "i", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        state = [p["stateOperators"][0] for p in query.recentProgress]
        assert sum(s["numRowsRemoved"] for s in state) == (2 if day else 0) and state[-1]["numRowsTotal"] == 2
    got = sorted((r.begin.timestamp() // 86400, r.i, r.v) for r in finals(spark, str(tmp_path / "out")).collect())
    assert got == [(float(5 * d), i, 5.0) for d in range(3) for i in range(2)]  # the last day is open, and what came late is out


def test_merged_streams_write_what_changes(spark, tmp_path):
    source, out, sizes = tmp_path / "in", tmp_path / "out", []
    for batch, entries in enumerate([[(k, 0) for k in range(20)], [(3, 0), (3, 0), (99, 1)], [(3, 0)]]):
        spark.createDataFrame([(i, j, 1.0) for i, j in entries], "i bigint, j bigint, v double").coalesce(1).write.mode("append").json(str(source))
        start_merged(accumulate(spark.readStream.schema("i bigint, j bigint, v double").json(str(source)), "i", "j", "v"), str(out), str(tmp_path / "state")).awaitTermination()
        sizes.append(spark.read.parquet(f"{out}/{batch:012d}").count())
    assert sizes == [20, 2, 1]
    want = sorted([(k, 0, 4.0 if k == 3 else 1.0) for k in range(20)] + [(99, 1, 1.0)])
    assert sorted(map(tuple, merged(spark, str(out)).collect())) == want
    compact(spark, str(out))
    assert len(list(out.iterdir())) == 1 and sorted(map(tuple, merged(spark, str(out)).collect())) == want


@pytest.mark.parametrize("symmetry", ["general", "symmetric"])
def test_files_outside_the_conditions_are_skipped(spark, tmp_path, symmetry):
    from pyspark.sql import datasource as D

    want = {(i, j): float(i + j) for i in range(60) for j in range(60) if (i * j) % 7 < 3 and (symmetry == "general" or i >= j)}
    mtx.save(CooMatrix(spark.createDataFrame([(i, j, v) for (i, j), v in want.items()], "i bigint, j bigint, v double"), 60, 60), str(tmp_path / "a.mtx"), symmetry=symmetry, ranged=True, file_entries=100)
    if symmetry == "symmetric":
        want |= {(j, i): v for (i, j), v in want.items()}
    files = len(list((tmp_path / "a.mtx").iterdir()))
    for condition, filters, test in (("i < 10", [D.LessThan(("i",), 10)], lambda i, j: i < 10), ("i = 30 AND j >= 50", [D.EqualTo(("i",), 30), D.GreaterThanOrEqual(("j",), 50)], lambda i, j: i == 30 and j >= 50), ("i > 59", [D.GreaterThan(("i",), 59)], lambda i, j: False)):
        reader = mtx.MtxReader({"path": str(tmp_path / "a.mtx")})
        assert not list(reader.pushFilters(filters))
        read = {p.value[0] for p in reader.partitions() if p.value[0]}
        assert reader.skipped + len(read) == files and (reader.skipped > 0) == (symmetry == "general" or condition != "i < 10")
        got = mtx.read_coo(spark, str(tmp_path / "a.mtx")).df.where(condition).collect()
        assert {(r.i, r.j): r.v for r in got} == {k: v for k, v in want.items() if test(*k)}
    plain = mtx.MtxReader({"path": str(tmp_path / "a.mtx")})
    plain.partitions()
    assert plain.skipped == 0


@pytest.mark.parametrize("symmetry", ["general", "skew-symmetric"])
def test_ranges_are_parsed_in_blocks(tmp_path, monkeypatch, symmetry):
    lines = [f"{k + 2} {k % (k + 1) + 1 if k % 3 else 1} {k}.5" + "\n% between\n" * (k % 11 == 0) for k in range(300)]
    head, path = f"%%MatrixMarket matrix coordinate real {symmetry}\n400 400 300\n", tmp_path / "x.mtx"
    for end in ("\n", ""):
        path.write_text(head + "\n".join(lines) + end)
        got = {}
        for block in (1 << 20, 64, 7):
            monkeypatch.setattr(mtx, "BLOCK_BYTES", block)
            for size in (1 << 20, 100, 9):
                reader = mtx.MtxReader({"path": str(path), "range_bytes": size})
                batches = [b for p in reader.partitions() for b in reader.read(p)]
                got[block, size] = sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
                assert block > 64 or size < 1 << 20 or max(b.num_rows for b in batches) <= 64
        want = got[1 << 20, 1 << 20]
        assert len(want) == 300 * (1 if symmetry == "general" else 2) and all(g == want for g in got.values())
