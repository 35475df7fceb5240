import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepframe.functions.scalars import step_grid
from sweepframe.functions.student import quantile
from sweepframe.operators import expfit
from tests.synthetic import biexp

KEYS = ["recording", "sweep"]


def frame(spark, sweeps):
    parts = [
        pd.DataFrame({"recording": "r", "sweep": k, "t_fit": t, "i_norm": y})
        for k, (t, y) in sweeps.items()
    ]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True)).repartition(5)


@pytest.fixture(scope="module")
def samples(spark):
    return frame(spark, {
        1: biexp(),
        2: biexp(a1=0.5, l1=5.3, a2=0.45, l2=1.8, c=0.02),
        3: biexp(noise=0.01, seed=4),
        4: (np.zeros(3), np.ones(3)),
        5: (np.linspace(0, 0.1, 4), np.full(4, np.nan)),
    }).withColumn("i_norm", F.nanvl("i_norm", F.lit(None))).cache()


def check(fits):
    got = {r.sweep: r for r in fits.collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    truth = {1: (0.65, 5.0, 0.35, 2.0, 0.0), 2: (0.5, 5.3, 0.45, 1.8, 0.02)}
    for k, want in truth.items():
        assert got[k].status == "converged" and got[k].is_conv
        assert [got[k][x] for x in expfit.TERMS] == pytest.approx(want, abs=1e-6)
    assert [got[3][x] for x in ("A1", "A2", "C")] == pytest.approx((0.65, 0.35, 0), abs=0.03)
    assert got[3].sigma == pytest.approx(0.01, rel=0.1)
    assert got[3].df_residual == 2995
    assert got[4].status == "failed" and got[4].A1 is None and got[4].error
    assert got[5].status == "failed" and got[5].n == 0 and got[5].error == "no values"
    return got


def test_recovers_parameters_in_one_grouped_pass(samples):
    check(expfit.refine_fit(samples, KEYS))


def test_recovers_parameters_without_gathering_a_sweep(samples, tight_limits):
    check(expfit.refine_fit(samples, KEYS, max_passes=30))


def test_mixed_lengths(spark, samples):
    from sweepframe.session import GROUP_ROWS

    more = samples.unionByName(frame(spark, {6: biexp(n=400)}))
    spark.conf.set(GROUP_ROWS[0], "1000")
    try:
        got = {r.sweep: r for r in expfit.refine_fit(more, KEYS, max_passes=30).collect()}
    finally:
        spark.conf.unset(GROUP_ROWS[0])
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[6].A1 == pytest.approx(0.65, abs=1e-5)
    assert got[1].lrc2 == pytest.approx(2.0, abs=1e-6)


def test_samples_are_shuffled_once(samples, tight_limits):
    begin = expfit.grid_candidates(samples, KEYS).selectExpr(
        *KEYS, "n", "transform(candidates, c -> array(c.A1, c.lrc1, c.A2, c.lrc2, c.C)) AS starts"
    )
    slim = samples.selectExpr(*KEYS, "t_fit AS _t", "i_norm AS _y")
    plan = expfit._refine_grouped(slim, begin, KEYS, 5)._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()
    assert plan.toString().count("RepartitionByExpression") == 1


def grouped_fit(monkeypatch, samples, max_passes):
    """The function that Spark calls with batches of sweeps, and the plan around it."""
    functions, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: functions.append(f) or real(kind)(f))
    begin = expfit.grid_candidates(samples, KEYS).selectExpr(
        *KEYS, "n", "transform(candidates, c -> array(c.A1, c.lrc1, c.A2, c.lrc2, c.C)) AS starts"
    )
    slim = samples.selectExpr(*KEYS, "t_fit AS _t", "i_norm AS _y")
    states = expfit._refine_grouped(slim, begin, KEYS, max_passes)
    return functions[0], expfit._report(states, KEYS)


def test_memory_does_not_follow_the_batch(samples, monkeypatch):
    """Python's memory beside the batch itself: a slice, and a few hundred bytes for a sweep."""
    import tracemalloc

    import pyarrow as pa

    fit, _ = grouped_fit(monkeypatch, samples, 3)
    rng = np.random.default_rng(8)
    start = [[0.6, a, 0.3, b, 0.0] for a in (4.0, 5.0, 6.0) for b in (1.5, 2.0, 2.5)]

    def peak(sweeps):
        times = pa.array([np.arange(64) / 100] * sweeps)
        batch = times, pa.array(list(rng.standard_normal((sweeps, 64)))), pa.array([start] * sweeps)
        tracemalloc.start()
        try:
            assert len(fit(*batch)) == sweeps
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    few, many = peak(1000), peak(8000)
    assert few < 30e6 and many - few < 7000 * 1500


def test_one_python_worker_a_task(samples, monkeypatch):
    """The errors of the parameters come from the worker that made the fit."""
    plan = grouped_fit(monkeypatch, samples, 3)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_batches_of_many_kinds(samples, monkeypatch):
    """Sweeps of several lengths and numbers of starting points in one batch, each as alone."""
    import pyarrow as pa

    fit, _ = grouped_fit(monkeypatch, samples, 40)
    monkeypatch.setattr(expfit, "SAMPLES_AT_ONCE", 1000, raising=False)
    start = [[0.6, a, 0.3, b, 0.0] for a in (4.0, 5.0, 6.0) for b in (1.5, 2.0, 2.5)]
    times, values, starts = [], [], []
    for k in range(24):
        t, y = biexp(n=(60, 90, 1100)[k % 3], noise=0.02, seed=k)
        times.append(t)
        values.append(y)
        starts.append((start[: 1 + k % 9], [], None)[0 if k % 5 else 1 + k % 2])
    starts[4] = [[np.nan] * 5]

    def arrays(rows):
        number = pa.list_(pa.float64())
        return [pa.array([x[k] for k in rows], kind) for x, kind in ((times, number), (values, number), (starts, pa.list_(number)))]

    together = fit(*arrays(range(24))).to_pylist()
    for k, row in enumerate(together):
        (alone,) = fit(*arrays([k])).to_pylist()
        assert str(row) == str(alone)
        assert (row["status"] == "failed") == (k == 4 or not starts[k])
        assert (row["p"] is None) == (not starts[k])
        if row["unscaled"]:
            inverse = np.linalg.inv(np.reshape(row["jtj"], (5, 5)))
            assert row["unscaled"] == pytest.approx(np.diag(inverse), rel=1e-3)
    assert sum(bool(row["unscaled"]) for row in together) > 8
    assert fit(*arrays([])).to_pylist() == []


def test_both_solvers_agree(spark):
    """On noisy traces: same parameters, residuals, status and number of passes."""
    from sweepframe.session import GROUP_ROWS

    noisy = frame(spark, {k: biexp(n=120, noise=0.05, seed=k) for k in range(1, 5)}).cache()
    one = {r.sweep: r for r in expfit.refine_fit(noisy, KEYS, max_passes=9).collect()}
    spark.conf.set(GROUP_ROWS[0], "5")
    try:
        other = {r.sweep: r for r in expfit.refine_fit(noisy, KEYS, max_passes=9).collect()}
    finally:
        spark.conf.unset(GROUP_ROWS[0])
    for k, r in one.items():
        assert (r.status, r.passes) == (other[k].status, other[k].passes)
        assert r.sse == pytest.approx(other[k].sse, rel=1e-9)
        assert [r[x] for x in expfit.TERMS] == pytest.approx([other[k][x] for x in expfit.TERMS], rel=1e-5, abs=1e-7)


def test_compressed_sums_are_exact():
    """Sums from the weighted points equal those over the samples, for slow and fast rates."""
    rng = np.random.default_rng(5)
    for n, t0, span in ((3000, 0.0, 0.7), (500, 0.2, 0.7), (40, 3.0, 100.0), (1, 0.5, 0.0)):
        t = np.sort(t0 + span * np.append(0.0, rng.random(n - 1)))
        y = rng.standard_normal(n)
        t[-1] = t0 + span
        since, level = t - t[0], expfit.LEVELS
        with np.errstate(all="ignore"):
            block = np.where(since > 0, np.maximum(0, level + np.ceil(np.log2(since / (t[-1] - t[0])))), -1)
        high = np.where(block < 0, 0, (t[-1] - t[0]) * 2.0 ** (block - level))
        centre = np.where(block == 0, high / 2, 0.75 * high)
        half = np.where(block == 0, high / 2, 0.25 * high)
        with np.errstate(all="ignore"):
            angle = np.arccos(np.clip(np.where(high > 0, (since - centre) / half, 0), -1, 1))
        kinds = np.unique(block)
        each = np.cos(angle[:, None] * np.arange(expfit.TERMS_PER_BLOCK))
        m = np.array([each[block == b].sum(0) for b in kinds])
        v = np.array([(each * y[:, None])[block == b].sum(0) for b in kinds])
        points, w, wy = expfit.weighted_points(kinds, m, v, t[-1] - t[0])
        assert len(points) <= (level + 2) * expfit.TERMS_PER_BLOCK
        for l1 in (-3.0, 0.0, 2.0, 5.0, 8.0, 12.0, 16.0, 40.0):
            p = np.array([[0.65, l1, 0.3, l1 / 2, 0.1]])
            want = expfit.normal_sums(t[None], y[None], p)
            *got, noise = expfit.weighted_sums(t[0] + points, w, wy, float(y @ y), p)
            scale = 1 + np.abs(want[1]).max()
            assert abs(got[0] - want[0]) <= 1e-11 * n + noise
            assert np.abs(got[1] - want[1]).max() <= 1e-11 * scale
            assert np.abs(got[2] - want[2]).max() <= 1e-11 * (scale + n)


def scanned_rows(spark, label, kind="Scan parquet"):
    """Rows read so far from places with a label in their path, by Spark's own counts."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for k in range(executions.size()):
        number = executions.apply(k).executionId()
        counts, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if node.name().startswith(kind) and label in node.desc():
                metrics = node.metrics()
                for i in range(metrics.size()):
                    metric = metrics.apply(i)
                    if metric.name() == "number of output rows" and counts.contains(metric.accumulatorId()):
                        total += int(counts.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_long_sweeps_are_scanned_three_times(spark, tight_limits):
    """Whatever the number of passes, with the same parameters to 1e-8."""
    sweeps = {k: biexp(n=700, noise=0.002 * k, seed=k) for k in range(4)}
    long = frame(spark, sweeps).cache()
    rows = long.count()
    before = scanned_rows(spark, "fit-samples")
    got = {r.sweep: r for r in expfit.refine_fit(long, KEYS).collect()}
    assert scanned_rows(spark, "fit-samples") - before <= 3 * rows
    spark.conf.unset("sweepframe.groupRows")
    want = {r.sweep: r for r in expfit.refine_fit(long, KEYS).collect()}
    for k, r in want.items():
        assert got[k].status == r.status == "converged"
        assert [got[k][x] for x in expfit.TERMS] == pytest.approx([r[x] for x in expfit.TERMS], abs=1e-8)
        assert got[k].std_errors == pytest.approx(r.std_errors, rel=1e-5, abs=1e-10)


def test_more_starts_never_fit_worse(samples):
    """All grid points are refined: no better residual is left from any of them."""
    got = {r.sweep: r.sse for r in expfit.refine_fit(samples, KEYS).collect()}
    t, y = biexp(noise=0.01, seed=4)
    for lrc1 in expfit.LRC1_GRID:
        for lrc2 in expfit.LRC2_GRID:
            x = np.column_stack([np.exp(-np.exp(lrc1) * t), np.exp(-np.exp(lrc2) * t), np.ones_like(t)])
            a1, a2, c = np.linalg.lstsq(x, y, rcond=None)[0]
            s = expfit.fresh_state(np.array([[a1, lrc1, a2, lrc2, c]]))
            with np.errstate(all="ignore"):
                while len(k := expfit.running_rows(s)):
                    expfit.advance(s, k, *expfit.normal_sums(t[None], y[None], s["trial"][k]), 100)
            assert got[3] <= s["sse"][0] * (1 + 1e-9)


def test_limits_are_numbers_or_null(spark):
    terms = spark.createDataFrame(
        [("r", 1, "lrc1", 5.0, -900.0, 910.0), ("r", 1, "lrc2", 2.0, 1.5, 2.5)],
        "recording string, sweep int, term string, estimate double, conf_lo double, conf_hi double",
    )
    got = {r.term: r for r in expfit.time_constants(terms, KEYS).collect()}
    assert got["lrc1"].conf_hi is None and got["lrc1"].conf_lo == 0
    assert got["lrc2"].conf_lo == pytest.approx(np.exp(-2.5)) and got["lrc2"].conf_hi == pytest.approx(np.exp(-1.5))


def test_t_functions_travel_after_use(spark):
    """A call on the driver must not change what is sent to the tasks."""
    import sweepframe
    from pyspark import cloudpickle

    from sweepframe.functions.student import t_p_value, t_quantile, two_sided

    two_sided(np.array([1.0]), np.array([5.0]))
    cloudpickle.register_pickle_by_value(sweepframe)
    try:
        df = spark.range(1, 2001).select(
            t_p_value(F.lit(2.0), F.col("id").cast("double")).alias("p"),
            t_quantile(F.lit(0.975), F.col("id").cast("double")).alias("q"),
        )
        rows = df.collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sweepframe)
    assert rows[9].p == pytest.approx(0.0733880348, abs=1e-9)
    assert rows[9].q == pytest.approx(2.2281388520, abs=1e-8)


def test_grid_is_brute_force_best(samples):
    got = {r.sweep: r for r in expfit.grid_fit(samples, KEYS).collect()}
    t, y = biexp(a1=0.5, l1=5.3, a2=0.45, l2=1.8, c=0.02)
    best = None
    for a in expfit.LRC1_GRID:
        for b in expfit.LRC2_GRID:
            x = np.column_stack([np.exp(-np.exp(a) * t), np.exp(-np.exp(b) * t), np.ones_like(t)])
            beta, *_ = np.linalg.lstsq(x, y, rcond=None)
            sse = float(((y - x @ beta) ** 2).sum())
            if best is None or sse < best[0]:
                best = (sse, a, b, beta)
    assert (got[2].lrc1, got[2].lrc2) == best[1:3]
    assert got[2].sse == pytest.approx(best[0], rel=1e-6)
    assert [got[2].A1, got[2].A2, got[2].C] == pytest.approx(list(best[3]), rel=1e-6)
    assert got[4].A1 is None


def test_term_table_and_limits(spark, samples):
    fits = expfit.refine_fit(samples.filter("sweep = 3"), KEYS)
    terms = expfit.fit_terms(fits, KEYS).toPandas().set_index("term")
    assert list(terms.index) == list(expfit.TERMS)
    t, y = biexp(noise=0.01, seed=4)
    p = terms["estimate"].to_numpy(float)
    sse, jtj, _ = expfit.normal_sums(t, y, p[None, :])
    want = np.sqrt(np.diag(np.linalg.inv(jtj[0])) * sse[0] / (len(t) - 5))
    assert np.allclose(terms["std_error"].astype(float), want, rtol=1e-6)
    q = quantile(0.975, np.array([len(t) - 5.0]))[0]
    assert np.allclose(terms["conf_hi"].astype(float) - p, q * want, rtol=1e-6)


def test_components_and_time_constants(spark):
    rows = [
        ("r", 1, term, est, est - 0.1, est + 0.1)
        for term, est in zip(expfit.TERMS, (0.6, 2.0, 0.4, 5.0, 0.1), strict=True)
    ]
    terms = spark.createDataFrame(
        rows, "recording string, sweep int, term string, estimate double, "
        "conf_lo double, conf_hi double"
    )
    parts = {r.speed: r for r in expfit.components(terms, KEYS).collect()}
    assert parts["fast"].A == 0.4 and parts["fast"].tau == pytest.approx(np.exp(-5))
    assert parts["slow"].A == 0.6 and parts["slow"].C == 0.1
    taus = {r.component: r for r in expfit.time_constants(terms, KEYS).collect()}
    assert taus["fast"].term == "lrc2"
    assert taus["slow"].conf_lo < taus["slow"].tau < taus["slow"].conf_hi
    tied = terms.withColumn("estimate", F.when(F.col("term").like("lrc%"), 3.0).otherwise(1.0))
    assert sorted(r.speed for r in expfit.components(tied, KEYS).collect()) == ["fast", "slow"]


def test_curves(spark):
    fit = spark.createDataFrame(
        [("r", 1, 0.6, 5.0, 0.4, 2.0, 0.1)],
        "recording string, sweep int, A1 double, lrc1 double, A2 double, lrc2 double, C double",
    )
    grid = step_grid(0, 7000, 0.0001)
    curve = expfit.fitted_curve(fit, grid, KEYS).toPandas()
    assert len(curve) == 7001 and curve["t"].max() == pytest.approx(0.7)
    t = curve["t"].to_numpy()
    want = 0.6 * np.exp(-np.exp(5) * t) + 0.4 * np.exp(-np.exp(2) * t) + 0.1
    assert np.allclose(curve["fitted"], want)
