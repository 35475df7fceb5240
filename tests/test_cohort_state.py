"""Cohort curves kept up to date by batches."""

import random

import pytest

from sweepframe.operators import cohort, cohort_state
from sweepframe.sources import commits

BY = ["cond", "t"]
SCHEMA = "recording string, cond string, t int, x double, y double"


def recording(rng, name, n):
    return [
        (name, rng.choice(["a", "b", None]), rng.randrange(3), 1e6 + rng.gauss(0, 1), rng.choice([None, rng.gauss(5, 2)]))
        for _ in range(n)
    ]


def compare(spark, path, rows):
    got = {(r.cond, r.t): r for r in cohort_state.curve(spark, path, BY, ["x", "y"]).collect()}
    want = {(r.cond, r.t): r for r in cohort.mean_se(spark.createDataFrame(rows, SCHEMA), BY, ["x", "y"]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("n", "x_avg", "x_lo", "x_hi", "x_null", "y_avg", "y_lo", "y_hi", "y_null"):
            assert got[k][c] == (None if w[c] is None else pytest.approx(w[c], rel=1e-12, abs=1e-9)), (k, c)


def test_any_order_of_batches_and_replaced_recordings(spark, tmp_path):
    rng = random.Random(3)
    path, held = str(tmp_path / "c"), {}
    for number in range(5):
        names = rng.sample(["r1", "r2", "r3", "r4", None], 2)
        batch = [r for name in names for r in recording(rng, name, rng.choice([1, 8, 30]))]
        # a recording may lose points of the curve, or be alone at one
        held |= {name: [r for r in batch if r[0] == name] for name in names}
        cohort_state.update(spark.createDataFrame(batch, SCHEMA), path, "recording", BY, ["x", "y"], ("w", number), 4)
        # tried again with other values: counts once
        if number == 2:
            again = [(*r[:3], 0.0, 0.0) for r in batch]
            cohort_state.update(spark.createDataFrame(again, SCHEMA), path, "recording", BY, ["x", "y"], ("w", number), 4)
    compare(spark, path, [r for rows in held.values() for r in rows])


def test_a_batch_that_died_between_the_tables(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    path = str(tmp_path / "c")
    first, second = recording(rng, "r1", 20) + recording(rng, "r2", 20), recording(rng, "r2", 25)
    cohort_state.update(spark.createDataFrame(first, SCHEMA), path, "recording", BY, ["x", "y"], ("w", 0), 2)

    def upsert(df, to, *more, f=commits.upsert):
        if to.endswith("parts"):
            raise RuntimeError("lost")
        return f(df, to, *more)

    monkeypatch.setattr(commits, "upsert", upsert)
    with pytest.raises(RuntimeError, match="lost"):
        cohort_state.update(spark.createDataFrame(second, SCHEMA), path, "recording", BY, ["x", "y"], ("w", 1), 2)
    monkeypatch.undo()
    cohort_state.update(spark.createDataFrame(second, SCHEMA), path, "recording", BY, ["x", "y"], ("w", 1), 2)
    compare(spark, path, [r for r in first if r[0] == "r1"] + second)
