"""Sets of ids kept as bitmaps, against plain Python sets."""

import random

import pytest
from pyspark.sql import functions as F

from sweepframe.operators import cohort, coverage_state
from sweepframe.sources import commits


def frame(spark, rows):
    return spark.createDataFrame(rows, "lab string, cond string, id string")


@pytest.mark.parametrize("tight", [False, True])
def test_batches_in_any_order(spark, tmp_path, request, tight):
    if tight:
        request.getfixturevalue("tight_limits")
    rng, path, held = random.Random(4), str(tmp_path / "c"), {}
    batches = []
    for _ in range(4):
        rows = [(rng.choice("xy"), rng.choice(["a", "b", None]), rng.choice(["", "é", None, *map(str, range(80))])) for _ in range(60)]
        batches.append(rows)
    for rows in [*batches, batches[1], []]:
        coverage_state.update(frame(spark, rows), path, ["lab", "cond"], parts=3)
        for lab, cond, i in rows:
            if i is not None:
                held.setdefault((lab, cond), set()).add(i)
    got = {(r.lab, r.cond): r.n for r in coverage_state.distinct_counts(spark, path, ["lab", "cond"]).collect()}
    assert got == {k: len(v) for k, v in held.items()}
    labs = {lab: set().union(*(v for k, v in held.items() if k[0] == lab)) for lab in "xy"}
    got = {r.lab: r.n for r in coverage_state.distinct_counts(spark, path, ["lab"]).collect()}
    assert got == {k: len(v) for k, v in labs.items()}
    listed = sorted(map(tuple, coverage_state.members(spark, path, ["lab", "cond"]).collect()), key=repr)
    assert listed == sorted(((*k, i) for k, v in held.items() for i in v), key=repr)
    flags = {r.id: (r.x, r.y) for r in coverage_state.coverage(spark, path, "lab", ["x", "y"]).collect()}
    assert flags == {i: (i in labs["x"] or None, i in labs["y"] or None) for i in labs["x"] | labs["y"]}
    both = {r.lab: r.n for r in coverage_state.common_counts(spark, path, ["lab"], "cond", ["a", "b"]).collect()}
    assert both == {lab: len(held[lab, "a"] & held[lab, "b"]) for lab in "xy"}
    none = coverage_state.common_counts(spark, path, ["lab"], "cond", ["a", "c"]).collect()
    assert none == []


def test_more_ids_than_a_bitmap_holds(spark, tmp_path):
    path = str(tmp_path / "c")
    ids = spark.range(70_000).select(F.lit("s").alias("source"), F.col("id"))
    coverage_state.update(ids.where("id % 3 = 0"), path, ["source"], parts=1)
    coverage_state.update(ids.withColumn("source", F.lit("t")).where("id % 2 = 0"), path, ["source"], parts=1)
    coverage_state.update(ids, path, ["source"], parts=1)
    sources = {"s": ids, "t": ids.where("id % 2 = 0")}
    want = cohort.coverage(sources)
    got = coverage_state.coverage(spark, path, "source", ["s", "t"])
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    rows = commits.read(spark, f"{path}/maps").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in rows} == {"s": 3, "t": 2}
    numbers = commits.read(spark, f"{path}/ids").agg(F.min("_number"), F.max("_number"), F.count_distinct("_number")).first()
    assert tuple(numbers) == (1, 70_000, 70_000)


def test_only_what_changes_is_written(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [("x", "a", str(k)) for k in range(200)]
    coverage_state.update(frame(spark, rows), path, ["cond"], parts=8)
    before = [commits.current(spark, f"{path}/{t}") for t in ("ids", "maps")]
    coverage_state.update(frame(spark, rows[50:90]), path, ["cond"], parts=8)
    assert commits.current(spark, f"{path}/ids") == before[0]
    assert commits.current(spark, f"{path}/maps").folders == before[1].folders
    coverage_state.update(frame(spark, [("x", "b", "3"), ("x", "a", "new")]), path, ["cond"], parts=8)
    after = [commits.current(spark, f"{path}/{t}") for t in ("ids", "maps")]
    assert sum(before[0].folders.get(k) != v for k, v in after[0].folders.items()) == 1
    assert sum(before[1].folders.get(k) != v for k, v in after[1].folders.items()) <= 2


def test_a_batch_that_died_between_the_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    coverage_state.update(frame(spark, [("x", "a", "1"), ("x", "a", "2")]), path, ["cond"], parts=2)

    def upsert(df, to, *more, f=commits.upsert):
        if to.endswith("maps"):
            raise RuntimeError("lost")
        return f(df, to, *more)

    monkeypatch.setattr(commits, "upsert", upsert)
    with pytest.raises(RuntimeError, match="lost"):
        coverage_state.update(frame(spark, [("x", "a", "3"), ("x", "b", "4")]), path, ["cond"], parts=2)
    monkeypatch.undo()
    # another batch first, then the lost one again
    coverage_state.update(frame(spark, [("x", "b", "5")]), path, ["cond"], parts=2)
    coverage_state.update(frame(spark, [("x", "a", "3"), ("x", "b", "4")]), path, ["cond"], parts=2)
    got = sorted(map(tuple, coverage_state.members(spark, path, ["cond"]).collect()))
    assert got == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4"), ("b", "5")]
