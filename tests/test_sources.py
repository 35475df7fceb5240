import numpy as np
import pandas as pd
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from sweepframe.sources import arrays, tables
from sweepframe.sources.traces import (
    add_condition,
    check_filenames,
    land_traces,
    list_files,
    parse_sample,
    read_landed,
    read_traces,
    text_lines,
)


def write_file(folder, name, n, newline="\n", pad="", blank=False):
    folder.mkdir(parents=True, exist_ok=True)
    rows = [f"{pad}{k * 0.001:.3f}\t{pad}{k}\t{-k}{pad}" for k in range(n)]
    if blank:
        rows.insert(2, "")
    (folder / name).write_bytes((newline.join(rows) + newline).encode())


def test_reads_names_sweeps_and_order(spark, tmp_path):
    write_file(tmp_path, "190101a Chan7x 5K-Na baseline.001.txt", 40)
    write_file(tmp_path, "b+c Chan7x 5K-Li TPA.002.txt", 20, newline="\r\n", pad=" ")
    write_file(tmp_path, "b2 X 5K-Li TPA.003.txt", 20, blank=True)
    write_file(tmp_path, "ignored.csv", 3)
    got = add_condition(read_traces(spark, str(tmp_path), 10)).toPandas()
    assert len(got) == 80
    first = got[got["id"] == "190101a"].sort_values(["sweep", "sample_idx"])
    assert first["i"].tolist() == list(range(40))
    assert first["sweep"].tolist() == [k // 10 + 1 for k in range(40)]
    assert first["sample_idx"].tolist() == [k % 10 for k in range(40)]
    assert set(first["cond"]) == {"baseline"}
    assert set(first["recording"]) == {"190101a Chan7x 5K-Na baseline.001.txt"}
    plus = got[got["id"] == "b+c"].sort_values(["sweep", "sample_idx"])
    assert plus["v"].tolist() == [-k for k in range(20)]
    assert got[got["id"] == "b2"].sort_values(["sweep", "sample_idx"])["i"].tolist() == list(range(20))


@pytest.mark.parametrize("tight", [False, True])
def test_large_file_is_read_in_pieces(spark, tmp_path, tight, request):
    if tight:
        request.getfixturevalue("tight_limits")
    n = 20_000
    write_file(tmp_path, "a c p f.txt", n)
    write_file(tmp_path, "b c p f.txt", 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_traces(spark, str(tmp_path), 100)
        assert df.rdd.getNumPartitions() >= 8
        got = df.toPandas().sort_values(["recording", "sweep", "sample_idx"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["i"].tolist() == [*range(n), *range(500)]
    assert got["sweep"].max() == n // 100


@pytest.mark.parametrize("tight", [False, True])
def test_landing_reads_the_text_once(spark, tmp_path, tight, request):
    from tests.test_expfit import scanned_rows

    if tight:
        request.getfixturevalue("tight_limits")
    n = 20_000
    write_file(tmp_path / "in", "a c p f.txt", n)
    write_file(tmp_path / "in", "b+x c p f.txt", 500, blank=True)
    write_file(tmp_path / "in", "c c p f.txt", 300, newline="\r\n", pad=" ")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    before = scanned_rows(spark, str(tmp_path / "in"), "Scan text")
    try:
        land_traces(spark, str(tmp_path / "in"), str(tmp_path / "out"), 100)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = read_landed(spark, str(tmp_path / "out"), 100)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    rows = got.toPandas().sort_values(["recording", "sweep", "sample_idx"])
    # the blank line is read too
    assert scanned_rows(spark, str(tmp_path / "in"), "Scan text") - before == n + 801
    assert rows["i"].tolist() == [*range(n), *range(500), *range(300)]
    assert rows["sweep"].max() == n // 100 and rows["complete"].all()
    assert set(rows["id"]) == {"a", "b+x", "c"}
    want = read_traces(spark, str(tmp_path / "in"), 100)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows.groupby("recording").size().to_dict() == want.toPandas().groupby("recording").size().to_dict()


def test_landing_keeps_the_strict_check(spark, tmp_path):
    write_file(tmp_path / "in", "a c p f.txt", 25)
    with pytest.raises(SparkRuntimeException, match="incomplete last sweep"):
        land_traces(spark, str(tmp_path / "in"), str(tmp_path / "x"), 10)
    land_traces(spark, str(tmp_path / "in"), str(tmp_path / "y"), 10, strict=False)
    got = read_landed(spark, str(tmp_path / "y"), 10).toPandas()
    assert (~got["complete"]).sum() == 5 and set(got[~got["complete"]]["sweep"]) == {3}
    for folder in ("p", "q"):
        write_file(tmp_path / folder, "a c p f.txt", 10)
    with pytest.raises(SparkRuntimeException, match="share the name"):
        land_traces(spark, str(tmp_path / "[pq]"), str(tmp_path / "z"), 5)


def test_incomplete_sweep(spark, tmp_path):
    write_file(tmp_path, "a c p f.txt", 25)
    with pytest.raises(SparkRuntimeException, match="incomplete last sweep"):
        read_traces(spark, str(tmp_path), 10).collect()
    got = read_traces(spark, str(tmp_path), 10, strict=False).toPandas()
    assert len(got) == 25 and (~got["complete"]).sum() == 5
    assert set(got[~got["complete"]]["sweep"]) == {3}


def test_recursive_reading_keeps_equal_names_apart(spark, tmp_path):
    write_file(tmp_path / "x", "a c p f.txt", 10)
    write_file(tmp_path / "y z", "a c p f.txt", 10)
    (tmp_path / "empty").mkdir()
    got = read_traces(spark, str(tmp_path), 5, recursive=True)
    assert got.select("recording").distinct().count() == 2
    assert got.select("id").distinct().first().id == "a"
    files = list_files(spark, str(tmp_path), recursive=True).toPandas()
    assert sorted(f.rsplit("/", 1)[1] for f in files["folder"]) == ["x", "y z"]
    assert (files["bytes"] > 0).all()


def test_unreadable_numbers_become_null(spark):
    df = spark.createDataFrame([("1.5\tNA\t2",), ("0.1\t 7 ",)], "line string")
    got = [tuple(r) for r in df.select(*parse_sample(F.col("line"))).collect()]
    assert got == [(1.5, None, 2.0), (0.1, 7.0, None)]


def test_filename_check(spark, tmp_path):
    write_file(tmp_path, "a c p f.txt", 1)
    write_file(tmp_path, "a c p extra f.txt", 1)
    got = {r.file_name: r for r in check_filenames(list_files(spark, str(tmp_path))).collect()}
    assert got["a c p f.txt"].ok and got["a c p f.txt"].file == "f.txt"
    assert not got["a c p extra f.txt"].ok and got["a c p extra f.txt"].n_tokens == 5


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "a\r\n b \n\nc")], "k int, text string")
    got = [(r.pos, r.line) for r in text_lines(df, "text", ["k"]).orderBy("pos").collect()]
    assert got == [(0, "a"), (1, "b"), (2, ""), (3, "c")]


def test_summary_csv_with_row_names(spark, tmp_path):
    (tmp_path / "one.csv").write_text(
        '"","sweep","Vpulse","I.0","I.600","id"\n"1",1,-120,0.5,NA,"c1"\n"2",2,20,1.5,2,"c1"\n'
    )
    (tmp_path / "two.csv").write_text(
        '"","sweep","Vpulse","I.0","I.600","id"\n"1",1,-120,9,8,"c2"\n'
    )
    got = tables.read_summaries(
        spark, str(tmp_path), ["", "sweep", "Vpulse", "I.0", "I.600", "id"]
    )
    assert got.columns == ["sweep", "v_pulse", "i_inst", "i_ss", "id"]
    rows = {(r.id, r.sweep): (r.v_pulse, r.i_inst, r.i_ss) for r in got.collect()}
    assert rows == {
        ("c1", 1): (-120, 0.5, None), ("c1", 2): (20, 1.5, 2.0), ("c2", 1): (-120, 9, 8)
    }


@pytest.mark.parametrize("csv", [False, True])
def test_summaries_of_one_recording_are_replaced_alone(spark, tmp_path, csv):
    path = str(tmp_path / "out")
    schema = "recording string, sweep int, i_ss double"
    first = spark.createDataFrame([("007", 1, 1.0), ("b", 1, 2.0)], schema)
    tables.write_summaries(first, path, csv=csv)
    tables.write_summaries(spark.createDataFrame([("b", 1, 5.0)], schema), path, csv=csv)
    if csv:
        back = tables.read_summaries(spark, path, ["recording", "sweep", "i_ss"])
    else:
        back = tables.read_table(spark, path)
    assert {(r.recording, r.i_ss) for r in back.collect()} == {("007", 1.0), ("b", 5.0)}
    assert back.schema["recording"].dataType.simpleString() == "string"


def test_summaries_share_folders(spark, tmp_path):
    """Recordings in the same folder as a replaced one stay as they are."""
    path = str(tmp_path / "out")
    schema = "recording string, sweep int, i_ss double"
    rows = [(f"{k:03d}", s, float(k)) for k in range(40) for s in (1, 2)]
    tables.write_summaries(spark.createDataFrame(rows, schema), path, buckets=3)
    new = [("005", 1, -1.0), ("100", 1, 100.0)]
    tables.write_summaries(spark.createDataFrame(new, schema), path, buckets=3)
    got = sorted((r.recording, r.sweep, r.i_ss) for r in tables.read_table(spark, path).collect())
    assert got == sorted([r for r in rows if r[0] != "005"] + new)
    for commit in (tmp_path / "out" / "data").iterdir():
        assert len(list(commit.glob("_bucket=*"))) <= 3


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    from pathlib import Path

    from sweepframe import session

    one = session.write_table(spark.range(5), "one")
    two = session.write_table(spark.range(5), "two")
    assert one.rows == 5 and one.df.count() == 5
    one.drop()
    assert not Path(one.path.removeprefix("file://")).exists()
    assert two.df.count() == 5


def test_partitioned_table_keeps_text_keys(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("7", 2), (None, 3)], "k string, v int")
    tables.write_table(df, str(tmp_path / "t"), "k")
    back = tables.read_table(spark, str(tmp_path / "t"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_lines_are_not_shuffled(spark, tmp_path, tight_limits):
    for k in range(4):
        write_file(tmp_path, f"a{k} c p f.txt", 10)
    got = read_traces(spark, str(tmp_path), 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan and "Aggregate" not in plan
    rows = got.toPandas()
    assert len(rows) == 40 and rows["complete"].all()
    places = rows.groupby(["recording", "sweep"])["sample_idx"].agg(sorted)
    assert len(places) == 8 and all(p == [0, 1, 2, 3, 4] for p in places)


def test_equal_names_in_two_folders_are_two_recordings(spark, tmp_path):
    for folder in ("x", "y"):
        write_file(tmp_path / folder, "a c p f.txt", 10)
    got = read_traces(spark, [str(tmp_path / "x"), str(tmp_path / "y")], 5)
    assert got.select("recording").distinct().count() == 2
    assert got.groupBy("recording").count().collect()[0]["count"] == 10
    files = [str(tmp_path / f / "a c p f.txt") for f in ("x", "y")]
    assert read_traces(spark, files, 5).select("recording").distinct().count() == 2
    with pytest.raises(SparkRuntimeException, match="share the name"):
        read_traces(spark, str(tmp_path / "*"), 5).collect()


def test_acquisition_block(spark):
    block = np.arange(24.0).reshape(4, 2, 3)  # points, channels, sweeps
    df = spark.createDataFrame([("f", block.tolist())], "file string, p array<array<array<double>>>")
    df = df.select("file", arrays.points_to_block(F.col("p")).alias("traces"))
    got = arrays.block_to_rows(df, ["file"], si=100.0).toPandas()
    got = got.sort_values(["sweep", "sample_idx"])
    assert got["i"].tolist() == block[:, 0, :].T.ravel().tolist()
    assert got["v"].tolist() == block[:, 1, :].T.ravel().tolist()
    assert got["time_ms"].tolist() == pytest.approx([0, 0.1, 0.2, 0.3] * 3)
    assert got["sweep"].tolist() == [1] * 4 + [2] * 4 + [3] * 4


def test_alternating_entries_share_the_first_time_base(spark):
    entries = [([0.0, 0.1], [(1.0, 2.0), (3.0, 4.0)]), ([5.0, 5.1], [(5.0, 6.0), (7.0, 8.0)])]
    df = spark.createDataFrame(
        [("f", entries)],
        "file string, entries array<struct<t:array<double>,iv:array<struct<I:double,V:double>>>>",
    )
    got = arrays.alternating_to_rows(df, ["file"]).orderBy("sweep", "sample_idx").collect()
    assert [(r.sweep, r.t, r.i, r.v) for r in got] == [
        (1, 0.0, 1.0, 2.0), (1, 0.1, 3.0, 4.0), (2, 0.0, 5.0, 6.0), (2, 0.1, 7.0, 8.0)
    ]


def test_flat_vectors_tile_the_time(spark):
    df = spark.createDataFrame(
        [("f", [0.0, 2.0], [1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0])],
        "filename string, time array<double>, b array<double>, c array<double>",
    )
    got = arrays.flat_to_rows(df, ["filename"], "time", {"v": "b", "i": "c"})
    rows = got.orderBy("sweep", "sample_idx").collect()
    assert [(r.sweep, r.sample_idx, r.t, r.v, r.i) for r in rows] == [
        (1, 0, 0.0, 1.0, 5.0), (1, 1, 0.002, 2.0, 6.0),
        (2, 0, 0.0, 3.0, 7.0), (2, 1, 0.002, 4.0, 8.0),
    ]


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"id": ["a", "b"], "x": [1.0, 2.0]}))
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t")).orderBy("id").collect() == df.collect()
