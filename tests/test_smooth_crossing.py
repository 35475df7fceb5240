import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepframe.operators.crossing import first_crossing, smoothed_half_time
from sweepframe.operators import smooth
from sweepframe.operators.smooth import projection, savgol, savgol_sums, smooth_part


def frame(spark, sweeps: dict, extra=None):
    parts = []
    for (rec, sweep), y in sweeps.items():
        parts.append(pd.DataFrame({
            "recording": rec, "sweep": sweep, "sample_idx": np.arange(len(y)),
            "t_fit": np.arange(len(y)) * 0.001, "i": np.asarray(y, float),
            **(extra or {}),
        }))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def brute_smooth(y, order, length):
    half = length // 2
    out = []
    for k in range(len(y)):
        lo = min(max(k - half, 0), len(y) - length)
        x = np.arange(lo, lo + length) - k
        out.append(np.polynomial.polynomial.polyfit(x / half, y[lo : lo + length], order)[0])
    return np.array(out)


def test_interior_weights_have_the_closed_form():
    m = 50
    k = np.arange(-m, m + 1)
    want = 3 * (3 * m * m + 3 * m - 1 - 5 * k * k) / ((2 * m + 3) * (2 * m + 1) * (2 * m - 1))
    assert np.allclose(projection(3, 101)[m], want, atol=1e-14)


def test_cubic_comes_back_unchanged_with_edges(spark):
    x = np.arange(300) / 50
    df = frame(spark, {("a", 1): x**3 - 4 * x**2 + x})
    got = savgol(df, block=128).toPandas()
    assert len(got) == 300
    assert np.abs(got["i_smooth"] - got["i"]).max() < 1e-9


@pytest.mark.parametrize("n", [11, 12, 40, 41, 97])
@pytest.mark.parametrize("block", [11, 16, 1000])
@pytest.mark.parametrize("smoothed", [savgol, savgol_sums])
def test_smoothing_matches_brute_force_for_any_block(spark, n, block, smoothed):
    y = np.random.default_rng(n).normal(size=n)
    df = frame(spark, {("a", 1): y, ("a", 2): y[::-1]}).repartition(7)
    got = smoothed(df, 3, 11, block=block).toPandas().sort_values(["sweep", "sample_idx"])
    want = np.concatenate([brute_smooth(y, 3, 11), brute_smooth(y[::-1], 3, 11)])
    assert np.allclose(got["i_smooth"], want, atol=1e-10)


def test_short_sweep_is_null(spark):
    got = savgol(frame(spark, {("a", 1): np.arange(100.0)})).toPandas()
    assert len(got) == 100 and got["i_smooth"].isna().all()
    assert np.isnan(smooth_part(np.arange(5.0), projection(3, 11))).all()


def test_smoothing_a_phase_that_starts_late(spark):
    y = np.random.default_rng(3).normal(size=90)
    df = frame(spark, {("a", 1): y}).filter("sample_idx >= 23")
    got = savgol(df, 3, 11, block=16).toPandas().sort_values("sample_idx")
    assert np.allclose(got["i_smooth"], brute_smooth(y[23:], 3, 11), atol=1e-10)


def test_ramp_crosses_before_the_half(spark):
    ramp = np.linspace(0, 1, 100)
    df = frame(spark, {("a", 1): ramp}, {"thresh": 0.5})
    row = first_crossing(df, "i", "thresh").first()
    assert row.t_half == pytest.approx(0.049)


@pytest.mark.parametrize("block", [3, 10, 16_384])
def test_crossing_rules(spark, block):
    sweeps = {
        ("a", 1): [0, 0, 2, 2],      # one change
        ("a", 2): [2, 2, 2, 2],      # never
        ("a", 3): [0, 1, 1, 2],      # touches the level
        ("b", 1): [0.0] * 9 + [2.0] * 9,
    }
    df = frame(spark, sweeps, {"thresh": 1.0})
    got = {
        (r.recording, r.sweep): round(r.t_half * 1000)
        for r in first_crossing(df, "i", "thresh", block=block).collect()
    }
    assert got == {("a", 1): 1, ("a", 3): 0, ("b", 1): 8}


def levels(df):
    return df.select("recording", "sweep", "thresh").distinct()


def test_samples_are_shuffled_once(spark, tight_limits):
    df = frame(spark, {("a", 1): np.linspace(0, 1, 200)}, {"thresh": 0.5})
    known = levels(df).withColumn("last", F.lit(199))
    out = smoothed_half_time(df, known, "thresh", last="last")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("block", [101, 128, 16_384])
def test_fused_half_time_equals_two_steps(spark, block):
    rng = np.random.default_rng(5)
    t = np.arange(700)
    sweeps = {("a", k): 1 - np.exp(-t / (40 * k)) + rng.normal(0, 0.05, 700) for k in (1, 2, 3)}
    df = frame(spark, sweeps, {"thresh": 0.5})
    two = first_crossing(savgol(df), "i_smooth", "thresh").toPandas()
    one = smoothed_half_time(df, levels(df), "thresh", block=block).toPandas()
    key = ["recording", "sweep"]
    pd.testing.assert_frame_equal(
        one.sort_values(key, ignore_index=True), two.sort_values(key, ignore_index=True)
    )
    assert len(one) == 3


def test_null_threshold_gives_no_row(spark):
    df = frame(spark, {("a", 1): np.linspace(0, 1, 200)})
    df = df.withColumn("thresh", F.lit(None).cast("double"))
    assert first_crossing(df, "i", "thresh").count() == 0
    assert smoothed_half_time(df, levels(df), "thresh").count() == 0


@pytest.mark.parametrize("smoothed", [savgol, savgol_sums])
def test_missing_values_reach_as_far_as_the_window(spark, smoothed):
    y = np.random.default_rng(6).normal(size=120) + 1e5
    at = 60
    want = brute_smooth(y, 3, 11)
    for gone in (None, float("nan"), float("inf")):
        df = frame(spark, {("a", 1): y}).withColumn("i", F.when(F.col("sample_idx") == at, gone).otherwise(F.col("i")))
        got = smoothed(df, 3, 11, block=32).toPandas().sort_values("sample_idx")["i_smooth"].to_numpy()
        hit = np.abs(np.arange(120) - at) <= 5
        assert np.isnan(got[hit]).all()
        assert np.allclose(got[~hit], want[~hit], rtol=1e-13, atol=1e-9)


@pytest.mark.parametrize("order, length", [(0, 1), (1, 3), (2, 5), (4, 31), (5, 101)])
def test_other_orders_and_lengths(spark, order, length):
    y = np.random.default_rng(length).normal(size=400)
    got = savgol_sums(frame(spark, {("a", 1): y}), order, length, block=64).toPandas().sort_values("sample_idx")
    want = brute_smooth(y, order, length) if length > 1 else y
    assert np.allclose(got["i_smooth"], want, atol=1e-9)


def test_smoothing_stays_out_of_python_and_shuffles_once(spark):
    df = frame(spark, {("a", 1): np.arange(300.0)})
    plan = savgol_sums(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_wide_windows_take_sums(spark, monkeypatch):
    y = np.random.default_rng(8).normal(size=500)
    df = frame(spark, {("a", 1): y, ("a", 2): y[:100]}).filter("sample_idx >= 7")
    one = savgol(df, 3, 101, block=128).toPandas().sort_values(["sweep", "sample_idx"])
    monkeypatch.setattr(smooth, "WIDE", 99)
    two = savgol(df, 3, 101, block=128)
    assert "ArrowEvalPython" not in two._jdf.queryExecution().executedPlan().toString()
    two = two.toPandas().sort_values(["sweep", "sample_idx"])
    assert np.allclose(one["i_smooth"], two["i_smooth"], atol=1e-11, equal_nan=True)
    assert two.loc[two["sweep"] == 2, "i_smooth"].isna().all()
