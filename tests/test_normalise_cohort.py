import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import scalars
from sweepframe.operators import annotate, cohort, normalise, reshape


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, scalars.nernst(140.0, 5.0)) == pytest.approx(
        8.314 * 293 / 96485 * np.log(5 / 140) * 1000
    )
    assert one(spark, scalars.nernst(0.0, 5.0)) is None
    assert one(spark, scalars.nernst(5.0, -1.0)) is None
    assert one(spark, scalars.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert [one(spark, scalars.half_even(F.lit(x))) for x in (2.5, 3.5, -0.5)] == [2, 4, 0]
    assert one(spark, scalars.before_dot(F.lit("baseline.001.txt"))) == "baseline"
    assert one(spark, scalars.first_number(F.lit("lrc12"))) == 12
    assert one(spark, scalars.first_number(F.lit("C"))) is None
    assert one(spark, scalars.drop_tail(F.lit("cell 1.txt"), 3)) == "cell 1."
    assert one(spark, scalars.underscored(F.lit("a b c"), "file_")) == "file_a_b_c"
    assert one(spark, scalars.two_exp(F.lit(0.0), F.lit(0.6), F.lit(5.0), F.lit(0.4),
                                      F.lit(2.0), F.lit(0.1))) == pytest.approx(1.1)


def test_nearest_sample(spark):
    rows = [(1, 0.0, 1.0), (1, 0.25, 2.0), (1, 0.5, 3.0), (2, 0.0, 4.0), (3, 0.125, 5.0),
            (3, 0.375, 6.0), (4, 0.125, 7.0), (4, 0.26, 8.0)]
    df = spark.createDataFrame(rows, "sweep int, t double, v double")
    got = {
        r.sweep: r.x
        for r in df.groupBy("sweep").agg(annotate.nearest("v", 0.25, 0.125).alias("x")).collect()
    }
    assert got == {1: 2.0, 2: None, 3: 5.0, 4: 8.0}  # the earlier of two equally close


def test_junction_lookup(spark):
    df = spark.createDataFrame([("5K-Na", 1.0), ("other", 1.0)], "Pip string, v double")
    got = {r.Pip: r for r in annotate.correct_junction(df).collect()}
    assert got["5K-Na"].v_corr == pytest.approx(-5.8)
    assert got["5K-Na"].ek == pytest.approx(-84.12, abs=0.01)
    assert got["other"].v_corr is None


@pytest.fixture(scope="module")
def measures(spark):
    rows = [
        ("a", "p", "baseline", 100.0, -60.0), ("a", "p", "TPA", 10.0, -20.0),
        ("b", "p", "baseline", 50.0, -55.0),
        ("c", "p", "TPA", 5.0, -1.0),
        ("d", "p", "baseline", 0.0, -5.0), ("d", "p", "TPA", 5.0, -1.0),
    ]
    return spark.createDataFrame(rows, "id string, Pip string, cond string, i_0 double, mp double")


@pytest.mark.parametrize("tight", [False, True])
def test_block_and_pairs(measures, tight, request):
    if tight:
        request.getfixturevalue("tight_limits")
    full = normalise.flag_pairs(normalise.percent_block(measures))
    got = {(r.id, r.cond): r for r in full.collect()}
    assert got["a", "baseline"].block == 0 and got["a", "TPA"].block == pytest.approx(90)
    assert got["c", "TPA"].block is None and got["d", "TPA"].block is None
    assert got["a", "TPA"].block_measured and not got["b", "baseline"].block_measured
    assert not got["c", "TPA"].has_baseline and got["c", "TPA"].has_treated
    pairs = {r.id: r for r in normalise.pair_baseline(full.drop("n_baseline")).collect()}
    assert set(pairs) == {"a", "b", "d"}
    assert pairs["a"].mp_treated == -20 and pairs["a"].mp_shift == 40
    assert pairs["b"].mp_treated is None and pairs["b"].block is None


def test_baseline_mean_becomes_one(spark):
    rows = [("a", "baseline", 2.0), ("a", "baseline", 4.0), ("a", "TPA", 6.0), ("b", "TPA", 1.0)]
    df = spark.createDataFrame(rows, "id string, cond string, i double")
    got = normalise.to_baseline(df, ["id"], F.col("cond") == "baseline")
    mean = got.filter("cond = 'baseline'").agg(F.avg("i_norm")).first()[0]
    assert mean == pytest.approx(1)
    assert got.filter("id = 'b'").first().i_norm is None


def test_mean_se(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("b", 7.0)], "g string, x double"
    )
    got = {r.g: r for r in cohort.mean_se(df, ["g"], ["x"]).collect()}
    assert (got["a"].n, got["a"].x_null, got["a"].x_avg) == (3, 1, 2.0)
    assert got["a"].x_hi - got["a"].x_avg == pytest.approx(np.std([1, 3], ddof=1) / np.sqrt(2))
    assert got["b"].x_lo is None and got["b"].x_avg == 7


@pytest.mark.parametrize("tight", [False, True])
def test_box_statistics(spark, tight, request):
    if tight:
        request.getfixturevalue("tight_limits")
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 700, p=[0.6, 0.39, 0.01]),
                        "x": rng.normal(0, 3, 700).round(1)})
    pdf.loc[0, "x"] = 99.0
    pdf["x"] += 0.0
    got = {r.g: r for r in cohort.box_stats(spark.createDataFrame(pdf), ["g"], "x").collect()}
    for g, part in pdf.groupby("g"):
        q1, med, q3 = np.quantile(part["x"], [0.25, 0.5, 0.75])
        inside = part["x"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        r = got[g]
        assert (r.n, r.n_outliers) == (len(part), (~inside).sum())
        assert [r.q1, r.median, r.q3] == pytest.approx([q1, med, q3])
        assert (r.whisker_lo, r.whisker_hi) == (part["x"][inside].min(), part["x"][inside].max())


def test_coverage_keeps_ids_of_a_single_source(spark):
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "id string")

    got = cohort.coverage(
        {"act_pre": ids("a", "a", "b"), "deact_pre": ids("b"), "ramp": ids("c"), "dt": ids("a")}
    )
    rows = {r.id: (r.act_pre, r.deact_pre, r.ramp, r.dt) for r in got.collect()}
    assert rows == {
        "a": (True, None, None, True), "b": (True, True, None, None), "c": (None, None, True, None)
    }


def test_reshape_round_trips(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k int, a double, b double")
    long = reshape.gather(wide, ["k"], ["a", "b"])
    assert reshape.spread(long, ["k"], "term", "value", ["a", "b"]).orderBy("k").collect() == (
        wide.orderBy("k").collect()
    )
    samples = spark.range(50).select(
        F.lit("r").alias("recording"), F.lit(1).alias("sweep"),
        F.col("id").alias("sample_idx"), (F.col("id") * 2.0).alias("i"),
    )
    nested = reshape.nest_sweeps(samples.repartition(7), block=20)
    assert [len(r.samples) for r in nested.orderBy("block").collect()] == [20, 20, 10]
    flat = reshape.unnest(nested, "samples").select(*samples.columns).orderBy("sample_idx")
    assert flat.collect() == samples.collect()
    two = spark.createDataFrame([(1, [1, 2], ["x", "y"])], "k int, p array<int>, q array<string>")
    assert [tuple(r) for r in reshape.unnest(two, ["p", "q"]).collect()] == [
        (1, 1, "x"), (1, 2, "y")
    ]


def test_sweep_numbers(spark):
    df = spark.range(25).select(F.col("id").alias("pos"), F.lit(25).alias("total"))
    got = annotate.number_sweeps(df, 10, total="total")
    rows = got.groupBy("sweep", "complete").count().orderBy("sweep").collect()
    assert [tuple(r) for r in rows] == [(1, True, 10), (2, True, 10), (3, False, 5)]
