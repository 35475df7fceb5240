import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepframe.operators.keyed import attach, positions, with_blocks
from sweepframe.session import shared_dir, write_table


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 200, n))
    pdf = pd.DataFrame({"k": key, "ts": rng.permutation(n), "x": rng.random(n).round(3)})
    return spark.createDataFrame(pdf), pdf


def expected_positions(pdf):
    out = pdf.sort_values(["k", "ts"])
    out["pos"] = out.groupby("k").cumcount()
    return out.sort_values("ts")["pos"].tolist()


def test_positions_in_one_window(skewed):
    df, pdf = skewed
    got = positions(df, ["k"], ["ts"], "pos").toPandas().sort_values("ts")
    assert got["pos"].tolist() == expected_positions(pdf)


def test_positions_piecewise(skewed, tight_limits):
    df, pdf = skewed
    out = positions(df, ["k"], ["ts"], "pos")
    assert out.columns == ["k", "ts", "x", "pos"]
    assert out.toPandas().sort_values("ts")["pos"].tolist() == expected_positions(pdf)


@pytest.mark.parametrize("tight", [False, True])
def test_weights_before(skewed, tight, request):
    if tight:
        request.getfixturevalue("tight_limits")
    df, pdf = skewed
    counted = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("w"))
    got = positions(counted, ["k"], ["x"], "before", weight="w").toPandas()
    want = pdf.groupby(["k", "x"]).size().rename("w").reset_index().sort_values(["k", "x"])
    want["before"] = want.groupby("k")["w"].cumsum() - want["w"]
    got = got.sort_values(["k", "x"])
    assert got["before"].tolist() == want["before"].tolist()


@pytest.mark.parametrize("tight", [False, True])
def test_attach(skewed, tight, request):
    if tight:
        request.getfixturevalue("tight_limits")
    df, pdf = skewed
    stats = df.groupBy("k").agg(F.max("ts").alias("last")).filter("k <> 7")
    got = attach(df, stats, ["k"])
    assert got.columns == ["k", "ts", "x", "last"]
    got = got.toPandas().sort_values("ts")
    want = pdf.groupby("k")["ts"].transform("max").where(pdf["k"] != 7)
    want = want[pdf.sort_values("ts").index]
    assert np.array_equal(got["last"].to_numpy(float), want.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("tight", [False, True])
def test_null_is_a_key_like_any_other(spark, tight, request):
    if tight:
        request.getfixturevalue("tight_limits")
    rows = [(None, k) for k in range(40)] + [("a", k) for k in range(40)]
    df = spark.createDataFrame(rows, "k string, ts int").repartition(5)
    numbered = positions(df, ["k"], ["ts"], "pos")
    assert numbered.filter("pos <> ts").count() == 0
    counted = attach(df, df.groupBy("k").agg(F.max("ts").alias("last")), ["k"])
    assert counted.filter("last = 39").count() == 80


def test_blocks_carry_neighbours(spark):
    df = spark.range(25).select(F.col("id").alias("sample_idx"))
    got = with_blocks(df, 3, 2, size=10).toPandas()
    block1 = got[got["_block"] == 1].sort_values("sample_idx")
    assert block1["sample_idx"].tolist() == list(range(7, 22))
    assert block1[block1["_own"]]["sample_idx"].tolist() == list(range(10, 20))
    assert got["_own"].sum() == 25


def test_written_table_counts_rows(spark):
    table = write_table(spark.range(17), "x")
    assert table.rows == 17 and table.df.count() == 17
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
