import numpy as np
import pandas as pd
import pytest

from sweepframe.functions.scalars import step_grid
from sweepframe.functions.student import quantile, two_sided
from sweepframe.operators import polyfit

KEYS = ["id"]


def curves(spark, shapes: dict, v=None):
    v = np.arange(-120.0, 101, 10) if v is None else v
    parts = [pd.DataFrame({"id": k, "v": v, "i": f(v)}) for k, f in shapes.items()]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def test_known_zero(spark):
    df = curves(spark, {"a": lambda v: 0.01 * (v + 78.0) * (v - 300)})
    row = polyfit.reversal(polyfit.quadratic_fit(df, KEYS)).first()
    assert row.e_rev == pytest.approx(-78.0, abs=1e-8)
    assert row.v_crit == -80 and not row.bad and not row.complex_root


def test_complex_roots_give_one_flagged_row(spark):
    df = curves(spark, {"a": lambda v: 0.02 * (v + 41.0) ** 2 + 3})
    rows = polyfit.reversal(polyfit.quadratic_fit(df, KEYS)).collect()
    assert len(rows) == 1
    assert rows[0].complex_root and rows[0].e_rev == pytest.approx(-41.0, abs=1e-6)


def test_linear_curve_and_far_zero(spark):
    v = np.arange(20.0, 101, 10)
    df = curves(spark, {"lin": lambda v: 2 * (v - 33), "far": lambda v: v + 30}, v)
    got = {r.id: r for r in polyfit.reversal(polyfit.quadratic_fit(df, KEYS)).collect()}
    assert got["lin"].e_rev == pytest.approx(33)
    assert got["far"].e_rev == pytest.approx(-30) and got["far"].bad
    rev = polyfit.reversal(polyfit.quadratic_fit(df, KEYS))
    assert [r.id for r in polyfit.dubious(rev).collect()] == ["far"]


def test_too_few_voltages(spark):
    df = curves(spark, {"a": lambda v: v}, np.array([-10.0, 10.0]))
    row = polyfit.reversal(polyfit.quadratic_fit(df, KEYS)).first()
    assert row.e_rev is None and row.c0 is None
    q = polyfit.fit_quality(polyfit.quadratic_fit(df, KEYS)).first()
    assert q.sigma is None and q.p_value is None


def test_tied_minimum_takes_smallest_voltage(spark):
    df = curves(spark, {"a": lambda v: np.abs(v) - 20})
    assert polyfit.critical_voltage(df, KEYS).first().v_crit == -20


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = np.arange(-60.0, 61, 5)
    i = 0.03 * v**2 + 1.5 * v + 4 + rng.normal(0, 5, len(v))
    df = spark.createDataFrame(pd.DataFrame({"id": "a", "v": v, "i": i}))
    fit = polyfit.quadratic_fit(df, KEYS, half_width=1000)
    row = polyfit.fit_quality(fit).first()
    design = np.vander(v, 3, increasing=True)
    beta, sse, *_ = np.linalg.lstsq(design, i, rcond=None)
    n, sse = len(v), float(sse[0])
    cov = np.linalg.inv(design.T @ design) * sse / (n - 3)
    assert np.allclose([row.b0, row.b1, row.b2], beta)
    assert row.sigma == pytest.approx(np.sqrt(sse / (n - 3)))
    assert row.r_squared == pytest.approx(1 - sse / ((i - i.mean()) ** 2).sum())
    log_lik = -n / 2 * (np.log(2 * np.pi * sse / n) + 1)
    assert row.log_lik == pytest.approx(log_lik)
    assert row.aic == pytest.approx(8 - 2 * log_lik)
    terms = polyfit.fit_terms(fit, KEYS).toPandas().set_index("term")
    assert np.allclose(terms["std_error"], np.sqrt(np.diag(cov)))
    want = two_sided(beta / np.sqrt(np.diag(cov)), np.full(3, n - 3.0))
    assert np.allclose(terms["p_value"].astype(float), want)


def test_prediction_grid(spark):
    df = curves(spark, {"a": lambda v: 0.01 * v * v})
    got = polyfit.predict(polyfit.quadratic_fit(df, KEYS), step_grid(-120, 100), KEYS)
    got = got.toPandas()
    assert len(got) == 221
    assert np.allclose(got["fitted"], 0.01 * got["v"] ** 2, atol=1e-8)


def test_student_values():
    # table values of the t distribution
    assert quantile(0.975, np.array([1.0, 10.0, 100.0])) == pytest.approx(
        [12.7062047, 2.2281389, 1.9839715], rel=1e-7
    )
    assert two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.0733880, abs=1e-7)
    assert two_sided(np.array([0.0]), np.array([5.0]))[0] == pytest.approx(1.0)
    assert np.isnan(two_sided(np.array([1.0]), np.array([0.0]))[0])
