import numpy as np
import pandas as pd
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from sweepframe.operators import features as feat
from sweepframe.operators.normalise import phase_norm, tail_phase_norm
from sweepframe.plans import plots, ramp, relax, steps
from sweepframe.sources.tables import read_summaries, read_table
from sweepframe.sources.traces import read_traces
from sweepframe.streaming.landing import summarise_new_files
from tests.synthetic import DT, N, protocol, recording

META = ["id", "channel", "Pip", "file"]


def with_meta(pdf, id_, channel="Chan7x", pip="5K-Na", file="baseline.001.txt"):
    return pdf.assign(id=id_, channel=channel, Pip=pip, file=file)


@pytest.fixture(scope="module")
def two_recordings(spark):
    pdf = pd.concat([
        with_meta(recording("r1"), "c1"),
        with_meta(recording("r2", (-60.0, 20.0, -100.0)), "c2"),
    ])
    return spark.createDataFrame(pdf).repartition(7).cache(), pdf


def window_mean(part, lo, hi):
    hit = (part["t"] > lo) & (part["t"] < hi)
    return part["i"][hit].mean()


@pytest.mark.parametrize("tight", [False, True])
def test_step_summaries(spark, two_recordings, tight, request):
    if tight:
        request.getfixturevalue("tight_limits")
    df, pdf = two_recordings
    p = protocol()
    got = steps.summarise(df, p, META, invert=False).toPandas()
    assert len(got) == 6
    assert sorted(got["v_pulse"]) == [-120, -100, -60, 0, 20, 60]
    for (rec, sweep), part in pdf.groupby(["recording", "sweep"]):
        row = got[(got["recording"] == rec) & (got["sweep"] == sweep)].iloc[0]
        inst, ss = window_mean(part, 0.601, 0.602), window_mean(part, 1.29, 1.299)
        assert row["i_inst"] == pytest.approx(inst) and row["i_ss"] == pytest.approx(ss)
        assert row["i_400"] == pytest.approx(window_mean(part, 1.0, 1.001))
        assert row["td_ratio"] == pytest.approx((ss - inst) / ss)
        # 0.2 + 0.8*(1 - exp(-6 t)) reaches the half of its measured range
        amp = (row["v_pulse"] + 130) / 10
        half = -np.log(1 - ((inst + ss) / 2 / amp - 0.2) / 0.8) / 6
        assert row["tapp50"] == pytest.approx(half + 0.001, abs=2 * DT)
        tails = pdf[pdf["recording"] == rec]
        lowest = tails[tails["sweep"] == tails.loc[tails[tails["t"] == 1.0].index, :]
                       .sort_values("v")["sweep"].iloc[0]]
        assert row["i_tail_ss_full"] == pytest.approx(window_mean(lowest, 1.89, 1.899))
    for _, part in got.groupby("recording"):
        top = part.sort_values("v_pulse").iloc[-1]
        assert top["norm_tail"] == pytest.approx(1)


def test_prepulse_features(spark, two_recordings):
    df, pdf = two_recordings
    p = protocol(probe=0.65, has_prepulse=True)
    got = steps.summarise(df, p, META, invert=False)
    for name in ("thresh_test", "decay_pulse", "td_pre", "fold_pre", "tapp50_pre",
                 "tapp50_test", "tapp50_tail"):
        assert name in got.columns
    row = got.filter("recording = 'r1' and sweep = 3").first()
    part = pdf[(pdf["recording"] == "r1") & (pdf["sweep"] == 3)]
    inst, ss = window_mean(part, 0.601, 0.602), window_mean(part, 1.29, 1.299)
    assert row.decay_pulse == pytest.approx(1 - ss / inst)
    assert row.td_pre == pytest.approx(0) and row.fold_pre == pytest.approx(1)


def test_phase_normalisation(spark, two_recordings):
    df, pdf = two_recordings
    p = protocol()
    act = phase_norm(df, p.test_phase(), p.onset(p.t_test), p.settled(p.t_post), p.t_test)
    ends = act.groupBy("recording", "sweep").agg(
        feat.mean_where("i_norm", p.onset(p.t_test).holds("t")).alias("zero"),
        feat.mean_where("i_norm", p.settled(p.t_post).holds("t")).alias("one"),
        F.min("t_fit").alias("t0"),
    ).collect()
    assert len(ends) == 6
    for r in ends:
        assert r.zero == pytest.approx(0, abs=1e-9) and r.one == pytest.approx(1)
        assert r.t0 == pytest.approx(0.002, abs=DT * 1.01)
    tails = tail_phase_norm(df, p).toPandas()
    for rec, part in pdf.groupby("recording"):
        zero = window_mean(part[part["sweep"] == 3], 1.89, 1.899)
        assert tails[tails["recording"] == rec]["offset"].unique() == pytest.approx([zero])
    onset = tails[(tails["t"] > 1.301) & (tails["t"] < 1.302)]
    assert onset.groupby(["recording", "sweep"])["i_norm"].mean().to_numpy() == pytest.approx(1)


def summaries(spark):
    rows = []
    for cell, zero in (("a", -85.0), ("b", -70.0)):
        for sweep, v in enumerate(np.arange(-120.0, 101, 10), start=1):
            row = {"id": cell, "channel": "x", "sweep": sweep, "v_pulse": v}
            for k, name in enumerate(protocol().timepoints_ms):
                shift = zero + 2 * k
                row[name] = 0.01 * (v - shift) * (v + 400)
            row |= {"tapp50_test": 0.1 * sweep, "tapp50_tail": 0.2 * sweep}
            rows.append(row)
    return spark.createDataFrame(pd.DataFrame(rows))


def test_reversals_across_cells(spark):
    table = summaries(spark)
    deact = steps.analyse(table, protocol())
    fits = {(r.id, r.time): r.e_rev for r in deact.fits.collect()}
    assert len(fits) == 14
    assert fits["a", 3.0] == pytest.approx(-85) and fits["a", 600.0] == pytest.approx(-73)
    assert plots.polynomial_overlay(deact.fits).count() == 14 * 221
    per_id = {r.id: r for r in deact.per_id.collect()}
    assert per_id["a"].e_rev_shift == pytest.approx(-12)
    assert per_id["a"].prepulse == "deactivating"
    act = steps.analyse(table, protocol(has_prepulse=True))
    row = {r.id: r for r in act.per_id.collect()}["b"]
    assert row.tapp_deact_m120 == pytest.approx(0.1)
    assert row.tapp50_tail_100 == pytest.approx(0.2 * 23)
    patches = steps.per_patch(deact.per_id, act.per_id)
    assert patches.count() == 4
    assert patches.filter("prepulse = 'activating'").first().fold_100 is None
    grid = steps.combined_sweeps(table, table.drop("tapp50_test"))
    assert grid.groupBy("protocol").count().count() == 2
    mean = {(r.channel, r.time): r for r in steps.reversal_summary(deact.fits).collect()}
    assert mean["x", 3.0].e_rev_avg == pytest.approx(-77.5) and mean["x", 3.0].n == 2
    cut = {r.time: r for r in steps.reversal_summary(deact.fits, (-80.0, 0.0)).collect()}
    assert cut[3.0].n == 1 and cut[3.0].e_rev_lo is None


def ramp_samples(spark):
    """I = g*(V + 60); block removes 90 %. Recorded sign is inverted."""
    t = 0.4 + np.arange(1, 500) * 0.002
    v = -120 + 260 * (t - 0.4)
    parts = []
    for id_, conds in (("a", ("baseline", "TPA")), ("b", ("baseline",))):
        for cond in conds:
            g = 1.5 if cond == "baseline" else 0.15
            for sweep in (1, 2):
                parts.append(pd.DataFrame({
                    "recording": f"{id_}-{cond}", "id": id_, "channel": "Chan7x",
                    "Pip": "5K-Na", "file": f"{cond}.001.txt", "sweep": sweep,
                    "sample_idx": np.arange(len(t)), "t": t,
                    "i": -(g * (v - 6.8 + 60) + (0.5 if sweep == 1 else -0.5)), "v": -v,
                }))
    return spark.createDataFrame(pd.concat(parts))


def test_ramp_analysis(spark):
    out = ramp.analyse(ramp_samples(spark))
    assert out.by_id.count() == 3 * 499
    base = out.by_id.filter("cond = 'baseline' and v_corr > 99.5 and v_corr < 100.5")
    for r in base.groupBy("id").agg(F.avg("i_norm").alias("m")).collect():
        assert r.m == pytest.approx(1)
    measured = {(r.id, r.cond): r for r in out.measures.collect()}
    assert measured["a", "baseline"].block == pytest.approx(0)
    assert measured["a", "TPA"].block == pytest.approx(90)
    assert measured["a", "TPA"].mp == pytest.approx(-60, abs=1)
    assert not measured["b", "baseline"].block_measured
    quality = {r.id: r for r in out.quality.collect()}
    assert quality["a"].block == pytest.approx(90) and quality["b"].block is None
    curve = out.by_channel.filter("cond = 'baseline'").first()
    assert curve.n == 2 and curve.i_lo == pytest.approx(curve.i_avg)
    assert ramp.pairs_per_group(out.quality, "Chan7x").first().n == 1
    assert [r.id for r in ramp.complete_ids(out.quality).collect()] == ["a"]
    assert ramp.quality_scatter(out.quality, "Chan7x").count() == 1
    assert plots.cohort_iv(out.by_channel, "Chan7x").count() == 2 * 499
    near = plots.cohort_iv_near_zero(out.by_channel, -20.0, 50.0)
    assert 0 < near.count() < 2 * 499
    band = near.select(F.max("i_hi").alias("top"), F.min("i_lo").alias("low")).first()
    assert band.top <= 50 and band.low >= -20
    box = plots.recording_box(out.quality, "Chan7x", "block").first()
    assert box.median == pytest.approx(90)


def relaxing_recording(spark):
    """Test pulse at -60 mV and tails that follow known double exponentials."""
    t = np.arange(N) * DT
    parts = []
    for sweep, v in enumerate((-60.0, 40.0, -120.0), start=1):
        test = t - 0.6
        post = t - 1.3
        i = np.where(
            (t >= 0.6) & (t < 1.3),
            2 * (0.65 * np.exp(-np.exp(5) * test) + 0.35 * np.exp(-np.exp(2.0) * test)) + 1,
            0.0,
        )
        tail = 3 * (0.6 * np.exp(-np.exp(4.8) * post) + 0.4 * np.exp(-np.exp(2.2) * post))
        i = np.where(t >= 1.3, tail if v > 0 else 0.0, i)
        volt = np.where((t >= 0.6) & (t < 1.3), v, -80.0)
        parts.append(pd.DataFrame({
            "recording": "r", "sweep": sweep, "sample_idx": np.arange(N), "t": t, "i": i,
            "v": volt,
        }))
    return spark.createDataFrame(pd.concat(parts))


def test_relaxation_fits(spark):
    p = protocol(probe=0.8)
    samples = relaxing_recording(spark)
    fits = relax.fit(relax.test_pulse(samples, p, invert=False))
    speed = {(r.sweep, r.speed): r for r in fits.by_component.collect()}
    assert {k[0] for k in speed} == {1, 3}  # steps below -20 mV
    assert speed[1, "fast"].tau == pytest.approx(np.exp(-5), rel=1e-4)
    assert speed[1, "slow"].tau == pytest.approx(np.exp(-2), rel=1e-4)
    assert fits.curves().count() == 2 * 7001
    assert fits.component_curves().count() == 4 * 7001
    taus = fits.taus.filter("sweep = 1").toPandas()
    assert (taus["conf_lo"].astype(float) <= taus["tau"]).all()
    tails = relax.fit(relax.tail(samples, p, invert=False))
    parts = {(r.sweep, r.speed): r for r in tails.by_component.collect()}
    assert {k[0] for k in parts} == {2}
    assert parts[2, "slow"].tau == pytest.approx(np.exp(-2.2), rel=1e-4)
    overlay = plots.fit_overlay(tails.by_component)
    assert overlay.count() == 6
    traces = plots.fit_traces(relax.tail(samples, p, invert=False), tails)
    kinds = {r.kind: r for r in traces.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.max("t").alias("end")
    ).collect()}
    assert set(kinds) == {"sample", "fitted", "fast", "slow"}
    assert kinds["fitted"].n > 5900 and all(r.top <= 1 and r.end <= 0.6 for r in kinds.values())


def test_relaxation_from_recorded_text(spark, tmp_path):
    """Files hold the sign of the recording; both plans turn it before they choose."""
    folder = tmp_path / "in"
    write_trace(folder, "007 ch 5K-Na one.001.txt", relaxing_recording(spark).toPandas())
    p = protocol(probe=0.8)
    samples = read_traces(spark, str(folder), N)
    fits = relax.fit(relax.test_pulse(samples, p))
    speed = {(r.sweep, r.speed): r.tau for r in fits.by_component.collect()}
    assert {k[0] for k in speed} == {1, 3}
    assert speed[1, "fast"] == pytest.approx(np.exp(-5), rel=1e-3)
    tails = relax.fit(relax.tail(samples, p))
    parts = {(r.sweep, r.speed): r.tau for r in tails.by_component.collect()}
    assert {k[0] for k in parts} == {2}
    assert parts[2, "slow"] == pytest.approx(np.exp(-2.2), rel=1e-3)
    meta = samples.select("recording", *META).distinct()
    for csv in (False, True):
        out = str(tmp_path / f"fits{csv}")
        tails.write(out, meta, csv=csv)
        tails.write(out, meta, csv=csv)
        if csv:
            header = tails.tables(meta)["by_component"].columns
            back = read_summaries(spark, f"{out}/by_component", header, text=["speed"])
        else:
            back = read_table(spark, f"{out}/by_component")
            assert read_table(spark, f"{out}/glance").count() == 1
            assert read_table(spark, f"{out}/estimates").count() == 5
        rows = back.collect()
        assert {(r.id, r.speed) for r in rows} == {("007", "fast"), ("007", "slow")}


def test_ramp_reads_samples_once(spark):
    """The samples are behind the written averages: no later table goes back to them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    samples = ramp_samples(spark)
    counted = samples.mapInPandas(count, samples.schema)
    out = ramp.analyse(counted)
    for df in (out.by_id, out.by_channel, out.measures, out.quality):
        df.collect()
    assert seen.value == samples.count()


def test_smoothed_trace_table(spark, two_recordings):
    df, _ = two_recordings
    p = protocol()
    features = steps.sweep_features(df, p, ["recording", "sweep"])
    out = plots.smoothed_trace(df, features, p, p.test_phase(), p.t_test, ["thresh"])
    err = out.agg(F.max(F.abs(F.col("i_smooth") - F.col("i")))).first()[0]
    assert err < 1e-3
    assert out.filter("thresh is null").count() == 0
    assert plots.step_timecourse(df, p).agg(F.max("t")).first()[0] < 1.9
    assert plots.instant_and_steady_iv(features).count() == 12
    tails = plots.tail_iv(features).collect()
    assert len(tails) == 6 and all(r.norm_tail is not None for r in tails)


def write_trace(folder, name, part):
    folder.mkdir(exist_ok=True)
    part = part.sort_values(["sweep", "sample_idx"])
    text = part[["t", "i", "v"]].assign(i=-part["i"], v=-part["v"])
    text.to_csv(folder / name, sep="\t", header=False, index=False)


def test_new_files_are_summarised_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    p = protocol()
    write_trace(folder, "c1 ch 5K-Na one.001.txt", recording("x", (-120.0, 60.0)))

    def run():
        return summarise_new_files(
            spark, str(folder), out, str(tmp_path / "ckpt"),
            lambda s: steps.summarise(s, p, META), N,
        )

    run()
    first = read_table(spark, out).toPandas()
    assert len(first) == 2 and set(first["id"]) == {"c1"}
    assert sorted(first["v_pulse"]) == [-120, 60]
    write_trace(folder, "c2 ch 5K-Na two.001.txt", recording("x", (0.0, 20.0, 40.0)))
    run()
    assert read_table(spark, out).groupBy("id").count().orderBy("id").collect()[1]["count"] == 3


def test_files_to_half_times(spark, tmp_path):
    folder = tmp_path / "in"
    write_trace(folder, "c1 ch 5K-Na one.001.txt", recording("x", (-120.0, 60.0, 0.0)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        samples = read_traces(spark, str(folder), N)
        got = steps.summarise(samples, protocol(), META).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3 and got["tapp50"].notna().all()
    # the first scan counted other splits: refuse, never misnumber
    with pytest.raises(SparkRuntimeException, match="file splits changed"):
        samples.collect()
