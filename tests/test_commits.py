"""Tables that change by whole commits."""

import json

import pytest
from pyspark.sql import functions as F

from sweepframe.sources import commits
from sweepframe.sources.tables import read_table, write_summaries

ROW = "recording string, sweep int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns_are_added_and_never_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    write_summaries(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], f"{ROW}, x double"), path)
    write_summaries(spark.createDataFrame([("b", 1, 5.0), ("c", 1, 6.0)], f"{ROW}, y double"), path)
    assert read_table(spark, path).columns == ["recording", "sweep", "x", "y"]
    write_summaries(spark.createDataFrame([("d", 1, "t"), (None, 2, "n")], f"{ROW}, z string"), path)
    write_summaries(spark.createDataFrame([("a", 7, 8.0), ("a", 9, 8.5)], f"{ROW}, x double"), path)
    write_summaries(spark.createDataFrame([(None, 3, 0.5)], f"{ROW}, x double"), path)
    assert rows(read_table(spark, path)) == sorted(
        [
            ("a", 7, 8.0, None, None), ("a", 9, 8.5, None, None), ("b", 1, None, 5.0, None),
            ("c", 1, None, 6.0, None), ("d", 1, None, None, "t"), (None, 3, 0.5, None, None),
        ],
        key=str,
    )
    # every version can still be read as it was
    assert rows(read_table(spark, path, 1)) == [("a", 1, 1.0), ("b", 1, 2.0)]


def test_numbers_get_wider_and_other_types_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    write_summaries(spark.createDataFrame([("a", 1), ("b", 2)], ROW), path, buckets=2)
    write_summaries(spark.createDataFrame([("b", 1 << 40)], "recording string, sweep long"), path)
    got = read_table(spark, path)
    assert got.schema["sweep"].dataType.simpleString() == "bigint"
    assert rows(got) == [("a", 1), ("b", 1 << 40)]
    before = commits.current(spark, path)
    with pytest.raises(ValueError, match="sweep was bigint"):
        write_summaries(spark.createDataFrame([("c", "x")], "recording string, sweep string"), path)
    assert commits.current(spark, path) == before


@pytest.mark.parametrize("when", ["rows", "manifest"])
def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, when):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(f"r{k}", k) for k in range(50)], ROW)
    write_summaries(old, path)
    new = spark.createDataFrame([(f"r{k}", -k) for k in range(0, 80, 2)], ROW)
    if when == "rows":
        # tasks fail half-way through the data files
        monkeypatch.setattr(commits, "_shaped", lambda df, schema, f=commits._shaped: f(df, schema).withColumn(
            "sweep", F.when(F.col("recording") == "r62", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("sweep"))
        ))
    else:
        # the manifest is cut off in the middle
        def cut(spark, path, version):
            text = version.text()
            place = tmp_path / "t" / "versions" / f"{version.number:012d}.json"
            place.write_text(text[: len(text) // 2])
            raise RuntimeError("lost")

        monkeypatch.setattr(commits, "_create", cut)
    with pytest.raises(Exception, match="lost"):
        write_summaries(new, path)
    monkeypatch.undo()
    assert rows(read_table(spark, path)) == rows(old)
    write_summaries(new, path)
    want = {f"r{k}": k for k in range(50)} | {f"r{k}": -k for k in range(0, 80, 2)}
    assert rows(read_table(spark, path)) == sorted(want.items(), key=str)
    commits.forget(spark, path)
    live = set(commits.current(spark, path).folders.values())
    assert {d.name for d in (tmp_path / "t" / "data").iterdir()} == live
    assert rows(read_table(spark, path)) == sorted(want.items(), key=str)


def test_two_writers_from_the_same_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write_summaries(spark.createDataFrame([(f"r{k}", k) for k in range(40)], ROW), path, buckets=4)
    other = [False]

    def create(spark_, path_, version, f=commits._create):
        if not other[0]:
            other[0] = True
            write_summaries(spark.createDataFrame([("r1", -1), ("r3", -3), ("new", 5)], f"{ROW}"), path)
        f(spark_, path_, version)

    monkeypatch.setattr(commits, "_create", create)
    write_summaries(spark.createDataFrame([(f"r{k}", 100 + k) for k in range(2, 40)], ROW), path)
    want = {"r0": 0, "r1": -1, "new": 5} | {f"r{k}": 100 + k for k in range(2, 40)}
    assert rows(read_table(spark, path)) == sorted(want.items(), key=str)
    assert commits.current(spark, path).number == 3


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for number, sweep in ((0, 1), (0, 2), (1, 3), (0, 4), (1, 5)):
        write_summaries(spark.createDataFrame([("a", sweep)], ROW), path, batch=("stream", number))
    write_summaries(spark.createDataFrame([("b", 9)], ROW), path, batch=("another", 0))
    assert rows(read_table(spark, path)) == [("a", 3), ("b", 9)]
    assert commits.current(spark, path).batches == {"stream": 1, "another": 0}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    write_summaries(spark.createDataFrame([(f"r{k}", k) for k in range(200)], ROW), path, buckets=16)
    first = commits.current(spark, path)
    write_summaries(spark.createDataFrame([("r7", 0)], ROW), path, buckets=99)
    second = commits.current(spark, path)
    assert second.buckets == 16 and len(first.folders) == 16
    assert sum(first.folders[k] != second.folders[k] for k in first.folders) == 1
    manifest = json.loads((tmp_path / "t" / "versions" / f"{2:012d}.json").read_text())
    assert len(manifest["folders"]) == 16
    # nothing to write: a version with the new column and no data
    write_summaries(spark.createDataFrame([], f"{ROW}, x double"), path)
    assert read_table(spark, path).columns == ["recording", "sweep", "x"] and read_table(spark, path).count() == 200


def test_appended_plain_tables_keep_all_columns(spark, tmp_path):
    from sweepframe.sources.tables import write_table

    path = str(tmp_path / "p")
    write_table(spark.createDataFrame([("a", 1)], "k string, x int"), path, "k")
    write_table(spark.createDataFrame([("b", 2)], "k string, y int"), path, "k")
    assert sorted(read_table(spark, path).columns) == ["k", "x", "y"]
    assert read_table(spark, path).count() == 2


def test_its_own_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="own column"):
        commits.upsert(spark.createDataFrame([("a", 1)], "k string, _bucket int"), str(tmp_path / "t"), "k", 2)
