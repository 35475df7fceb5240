"""Library operators applied to the shared tables, one query per operator group.

Stand-ins for recordings:

* ``events``: a recording per user, samples in order of (ts, event_id), current
  in hundredths so that sums are exact;
* ``lineitem``: an I-V curve per (supplier, return flag);
* ``orders``: measures per customer, order status as condition;
* ``embeddings``: one trace of 64 samples per vector.
"""

from __future__ import annotations

from collections.abc import Callable
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.scalars import (
    before_dot,
    drop_tail,
    first_number,
    half_even,
    nernst,
    ratio,
    step_grid,
    tokens,
    two_exp,
    underscored,
)
from sweepframe.operators import cohort, expfit, polyfit, reshape
from sweepframe.operators import cohort_state as curves
from sweepframe.operators import coverage_state as bitmaps
from sweepframe.operators.annotate import (
    add_labels,
    add_lookup,
    cut,
    flip,
    nearest,
    number_sweeps,
)
from sweepframe.operators.crossing import first_crossing, smoothed_half_time
from sweepframe.operators.features import derive, mean_where, tail_norm, window_means
from sweepframe.operators.keyed import attach, attach_aggregates, positions
from sweepframe.operators.normalise import (
    flag_pairs,
    pair_baseline,
    percent_block,
    phase_norm,
    tail_norm_by_reference,
    to_baseline,
    to_extremes,
)
from sweepframe.operators.smooth import savgol, savgol_sums
from sweepframe.plans import steps
from sweepframe.protocol import Window
from sweepframe.session import scratch_path, write_table
from sweepframe.sources import arrays, tables
from sweepframe.sources.traces import (
    add_condition,
    check_filenames,
    land_traces,
    list_files,
    read_landed,
    read_traces,
    text_lines,
)

PER_SWEEP = 16
#: Open windows on the sample number of a whole trace.
TRACE_WINDOWS = {
    "i_inst": Window(-1, 5),
    "i_50": Window(9, 13),
    "i_tail": Window(29, 35),
    "i_tail_ss": Window(34, 40),
    "i_ss": Window(39, inf),
}
#: Sweeps of 16 samples: the first and the last three.
FIRST3, LAST3 = Window(-1, 3), Window(12, 16)
LRC1, LRC2 = (4.0, 5.0, 6.0), (1.5, 2.0, 2.5)
# Offsets per region; one region has none on purpose.
REGION_OFFSET = {"AFRICA": -1.5, "AMERICA": -12.25, "ASIA": -4.5, "EUROPE": -7.75}
MEASURE_CODE = {"l_quantity": 3.0, "l_discount": 50.0}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round, and turn a negative zero into zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).alias("i")


# --- traces from events ----------------------------------------------------------


def trace(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """One trace per user: sample number and current."""
    ev = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", *extra, hundredths("value")
    )
    return positions(ev, ["user_id"], ["ts", "event_id"]).drop("ts", "event_id")


def swept(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """The same, cut into sweeps of 16 samples with a time in seconds."""
    numbered = number_sweeps(
        trace(spark, sf, *extra).withColumnRenamed("sample_idx", "pos"), PER_SWEEP
    )
    return numbered.drop("pos").withColumn("t", F.col("sample_idx") * 0.01)


SWEEP = ["user_id", "sweep"]


def trace_features(samples: DataFrame) -> DataFrame:
    return derive(
        window_means(samples, TRACE_WINDOWS, ["user_id"], t="sample_idx"), False
    )


def half_time(spark: SparkSession, sf: str) -> DataFrame:
    """Samples to half-time: number, window means, threshold, first crossing."""
    samples = trace(spark, sf)
    means = {n: TRACE_WINDOWS[n] for n in ("i_inst", "i_ss")}
    level = window_means(samples, means, ["user_id"], t="sample_idx").select(
        "user_id", ((F.col("i_inst") + F.col("i_ss")) / 2).alias("thresh")
    )
    with_level = attach(samples, level, ["user_id"])
    first = first_crossing(with_level, "i", "thresh", ["user_id"], t="sample_idx")
    return first.select("user_id", F.col("t_half").cast("long").alias("t_half"))


def sweep_number(spark, sf):
    numbered = number_sweeps(
        attach_aggregates(
            trace(spark, sf).withColumnRenamed("sample_idx", "pos"),
            ["user_id"],
            {"total": F.count(F.lit(1))},
        ),
        PER_SWEEP,
        total="total",
    )
    return numbered.groupBy(*SWEEP, "complete").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("sample_idx").alias("last_idx"),
        F.sum("i").alias("sum_i"),
    )


def _phase_norm(spark, sf, zero: Window, one: Window):
    # windows on sample numbers, moved to the time axis of 0.01 s steps
    def seconds(w: Window) -> Window:
        return Window((w.lo + 0.5) / 100, (w.hi - 0.5) / 100)

    out = phase_norm(
        swept(spark, sf), Window(-1.0, 1.0), seconds(zero), seconds(one), 0.0, SWEEP
    )
    return rounded(
        out.select(*SWEEP, "sample_idx", "offset", "norm", "i_norm", "t_fit"),
        8, "offset", "norm", "i_norm", "t_fit",
    )


def phase_norm_act(spark, sf):
    return _phase_norm(spark, sf, FIRST3, LAST3)


def phase_norm_deact(spark, sf):
    return _phase_norm(spark, sf, LAST3, FIRST3)


def tail_norm_ref(spark, sf):
    idx = F.col("sample_idx")
    out = tail_norm_by_reference(
        swept(spark, sf),
        phase=F.lit(True),
        zero=LAST3.holds(idx) & (F.col("sweep") == 1),
        one=FIRST3.holds(idx),
        anchor=0.0,
        keys=SWEEP,
        by=["user_id"],
    )
    return rounded(
        out.select(*SWEEP, "sample_idx", "offset", "i_norm"), 8, "offset", "i_norm"
    )


def _step(samples: DataFrame) -> Column:
    return half_even(nearest("v", 8, 0.5, "sample_idx"))


def step_voltage(spark, sf):
    samples = swept(spark, sf).withColumn("v", F.col("i") / 10)
    return samples.groupBy(*SWEEP).agg(_step(samples).alias("v_pulse"))


def sweep_features(spark, sf):
    samples = trace(spark, sf)
    full = trace_features(samples).join(half_time(spark, sf), "user_id", "left")
    names = [*TRACE_WINDOWS, "td_current", "td_ratio", "frac_tail", "thresh"]
    return rounded(full.select("user_id", *names, "t_half"), 8, *names)


def zero_crossing_mean(spark, sf):
    ev = table(spark, sf, "events").withColumn("k", first_number("props"))
    near = F.abs(F.col("value") - 50) < 5
    out = ev.groupBy("user_id").agg(mean_where("k", near).alias("mp"))
    return rounded(out, 8, "mp")


def phase_filter(spark, sf):
    samples = swept(spark, sf, "event_type").withColumn("v", F.col("i") / 10)
    with_step = attach_aggregates(samples, SWEEP, {"v_pulse": _step(samples)})
    return (
        with_step.filter(F.col("v_pulse") > 200)
        .filter(F.col("event_type") != "error")
        .filter(F.col("event_type").isin("click", "view"))
        .withColumnsRenamed({"event_type": "channel"})
        .select(
            F.col("user_id").cast("string").alias("id"),
            "channel",
            F.col("sweep").cast("string").alias("sweep"),
            "sample_idx",
            "v_pulse",
            (F.col("i") / 1000).alias("i_na"),
        )
    )


def sweep_average(spark, sf):
    samples = flip(cut(swept(spark, sf, "event_type"), Window(0.015, 0.125)), ["i"])
    out = cohort.average_sweeps(samples, ["event_type", "sample_idx"], ["i"])
    return rounded(out, 8, "t", "i")


def cohort_curve(spark, sf):
    out = cohort.mean_se(swept(spark, sf, "event_type"), ["event_type", "sample_idx"], ["i"])
    return rounded(out, 6, "i_avg", "i_lo", "i_hi")


def cohort_state(spark, sf):
    """The cohort curve from a state that four batches have updated.

    Recordings with a high mean come with wrong values first, then the others, then the
    first ones again with the right values; that batch is tried twice.
    """
    samples = write_table(swept(spark, sf, "event_type").select("user_id", "event_type", "sample_idx", "i"), "swept").df
    high = samples.groupBy("user_id").agg((F.avg("i") > 5000).alias("high"))
    marked = write_table(attach(samples, high, ["user_id"]), "marked").df
    right, first = marked.where("high").drop("high"), marked.where("not high").drop("high")
    wrong = right.withColumn("i", F.when(F.col("i") > 300, F.col("i") * 7 + 1e6))
    path, by = scratch_path(spark, "cohort"), ["event_type", "sample_idx"]
    for part, number in ((wrong, 0), (first, 1), (right, 2), (wrong, 2)):
        curves.update(part, path, "user_id", by, ["i"], ("lab", number), buckets=4)
    out = curves.curve(spark, path, by, ["i"])
    # off the ties that means of whole numbers often are
    return out.withColumns({c: F.round(F.col(c) + 1e-8, 6) for c in ("i_avg", "i_lo", "i_hi")})


def nest_unnest(spark, sf):
    nested = reshape.nest_sweeps(trace(spark, sf), ["user_id"])
    flat = reshape.unnest(nested, "samples")
    return flat.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("sample_idx") * F.col("i")).alias("checksum"),
    )


def pixel_columns(spark, sf):
    """Traces reduced to 50 pixel columns of 20 samples."""
    return reshape.pixels(trace(spark, sf), ["user_id"], "sample_idx", "i", 0, 1000, 50)


def summary_files(spark, sf):
    """Cohort curves written as CSV folders per group, read back as one table."""
    curves = cohort_curve(spark, sf).select("event_type", "sample_idx", "n", "i_avg")
    path = scratch_path(spark, "summary-csv")
    tables.write_summaries(curves, path, "event_type", csv=True)
    back = tables.read_summaries(spark, path, ["event_type", "sample_idx", "n", "i_avg"], text=["event_type"])
    return back.select(
        "event_type",
        F.col("sample_idx").cast("long").alias("sample_idx"),
        F.col("n").cast("long").alias("n"),
        "i_avg",
    )


def summary_commits(spark, sf):
    """Summaries of all recordings, committed three times with changing columns.

    Recordings with a high mean are measured again with their maximum, then those that
    come near zero with their minimum alone. The last batch is tried twice.
    """
    per = trace(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i"), F.max("i").alias("hi"), F.min("i").alias("lo")
    )
    per = write_table(per, "summaries").df
    path = scratch_path(spark, "summary-commits")
    parts = [
        per.select("user_id", "n", "sum_i"),
        per.where("sum_i > 5000 * n").select("user_id", "n", "sum_i", "hi"),
        per.where("lo < 100").select("user_id", "n", "lo"),
        per.select("user_id", F.lit(0).cast("long").alias("n")),
    ]
    for part, number in zip(parts, (0, 1, 2, 2)):
        tables.write_summaries(part, path, "user_id", buckets=4, batch=("lab", number))
    return tables.read_table(spark, path)


def landed_table(spark, sf):
    """Samples landed as Parquet, one folder per event type, and read back."""
    path = scratch_path(spark, "landed")
    tables.write_table(trace(spark, sf, "event_type"), path, "event_type")
    return tables.read_table(spark, path).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("i").alias("sum_i")
    )


def trace_files(spark, sf):
    """Events written as trace text, read back with their line positions.

    Each line carries the position it was written at, in the place of the time.
    """
    path = scratch_path(spark, "trace-text")
    written_at = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)).cast("double")
    table(spark, sf, "events").select(
        F.concat_ws("\t", written_at, hundredths("value"), "event_id").alias("value")
    ).write.text(path)
    back = read_traces(spark, path, PER_SWEEP, strict=False, meta=())
    pos = (F.col("sweep") - 1) * PER_SWEEP + F.col("sample_idx")
    return back.select(
        F.col("v").cast("long").alias("event_id"), "i", (pos == F.col("t")).alias("in_place")
    )


def _named_files(spark, sf) -> str:
    """Folder with a trace file per event type, named as recordings are; one name has a
    token too many, and one file lies in a folder of its own."""
    folder = scratch_path(spark, "recordings")
    events = table(spark, sf, "events").select("event_type", "ts", "event_id", hundredths("value"))
    # a handful of types; a file is written by one task, as a recording is
    for k, (kind,) in enumerate(events.select("event_type").distinct().orderBy("event_type").collect()):
        part = f"{folder}-{k}"
        rows = events.where(F.col("event_type") == kind).repartition(1).sortWithinPartitions("ts", "event_id")
        rows.select(F.concat_ws("\t", F.lit(0.25), "i", "event_id").alias("value")).write.text(part)
        extra = "again " if k == 1 else ""
        own = f"{folder}/late" if k == 2 else folder
        _move_only_file(spark, part, own, f"c{k} Chan{kind} 5K-Na {extra}{kind}+tpa.00{k}.txt")
    return folder


def _move_only_file(spark, source: str, folder: str, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(folder))
    (found,) = [s.getPath() for s in store.listStatus(path(source)) if s.getPath().getName().startswith("part-")]
    store.rename(found, path(folder, name))


def trace_meta(spark, sf):
    """Named files of two folders as samples with metadata and condition."""
    back = read_traces(spark, _named_files(spark, sf), PER_SWEEP, recursive=True, strict=False)
    name = F.substring_index("recording", "/", -1).alias("file_name")
    return add_condition(back).select(
        name, "id", "channel", "Pip", "file", "cond", "sweep", "sample_idx", "t", "i",
        F.col("v").cast("long").alias("event_id"), "complete",
    )


def trace_landed(spark, sf):
    """The same files landed as a table with one reading of the text."""
    path = scratch_path(spark, "landed-traces")
    land_traces(spark, _named_files(spark, sf), path, PER_SWEEP, recursive=True, strict=False)
    return read_landed(spark, path, PER_SWEEP).select(
        "id", "channel", "Pip", "file", "sweep", "sample_idx", "i", F.col("v").cast("long").alias("event_id"), "complete"
    )


def trace_names(spark, sf):
    """Files of a folder and all below it, and whether their names have the right parts."""
    files = list_files(spark, _named_files(spark, sf), recursive=True)
    folders = files.select("file_name", F.substring_index("folder", "/", -1).alias("folder"))
    sized = files.select("file_name", (F.col("bytes") > 0).alias("has_bytes"))
    folder = F.when(F.col("folder") == "late", "late").otherwise("top").alias("folder")
    found = check_filenames(files).join(folders, "file_name").join(sized, "file_name")
    return found.select("file_name", "id", "channel", "Pip", "file", "n_tokens", "ok", "has_bytes", folder)


def preview(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return ev.orderBy("ts", "event_id").limit(6).drop("ts")


def union_protocols(spark, sf):
    ev = table(spark, sf, "events")
    clicks = ev.filter("event_type = 'click'").select("user_id", "event_id", "value")
    views = ev.filter("event_type = 'view'").select("user_id", "event_id", "props")
    return add_labels(clicks, {"protocol": "deact. pre p."}).unionByName(
        add_labels(views, {"protocol": "act. pre p."}), allowMissingColumns=True
    )


# --- measures from orders --------------------------------------------------------


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("cond"),
        F.round(F.col("o_totalprice") * 100).alias("i"),
    )


def baseline_norm(spark, sf):
    out = to_baseline(orders(spark, sf), ["id"], F.col("cond") == "F")
    return rounded(out.select("o_orderkey", "id", "i_norm"), 8, "i_norm")


def _measures(spark, sf) -> DataFrame:
    return orders(spark, sf).groupBy("id", "cond").agg(
        F.avg("i").alias("i_0"), F.max("i").alias("mp")
    )


def block(spark, sf):
    out = flag_pairs(
        percent_block(_measures(spark, sf), ["id"], baseline="F"), ["id"], baseline="F"
    )
    return rounded(out.drop("mp"), 6, "i_0", "block")


def _pairs(spark, sf) -> DataFrame:
    kept = _measures(spark, sf).filter(F.col("cond").isin("F", "O"))
    return pair_baseline(percent_block(kept, ["id"], baseline="F").drop("n_baseline"),
                         ["id"], baseline="F")


def pair_table(spark, sf):
    return rounded(_pairs(spark, sf), 6, "i_0", "block")


def quality_points(spark, sf):
    limits = (5e6, 5e7)
    pairs = cohort.inside_limits(_pairs(spark, sf), "mp", *limits)
    shown = cohort.inside_limits(pairs, "mp_treated", *limits)
    return rounded(shown.select("id", "mp", "mp_treated", "block"), 6, "block")


def extremal_norm(spark, sf):
    both = to_extremes(orders(spark, sf), ["id"], "i", "o_orderkey")
    out = both.select(
        "o_orderkey", ratio("i", "at_max").alias("norm_tail"),
        (F.col("i") - F.col("at_min")).alias("td_tail"),
    )
    return rounded(out, 8, "norm_tail")


def _by_segment(spark, sf) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )
    return orders(spark, sf).join(customers, "id").select("segment", "cond", "id")


def distinct_n(spark, sf):
    return cohort.counts_of_ids(_by_segment(spark, sf), ["segment", "cond"])


def id_listing(spark, sf):
    done = _by_segment(spark, sf).filter("cond = 'P'")
    return cohort.id_listing(done, ["segment"], "id", ["segment", "id"])


def coverage(spark, sf):
    o = orders(spark, sf)
    sources = {
        "act_pre": o.filter("cond = 'F'"),
        "deact_pre": o.filter("cond = 'O'"),
        "ramp": o.filter("cond = 'P'"),
        "dt": table(spark, sf, "events").select(F.col("user_id").alias("id")),
    }
    return cohort.coverage(sources)


def coverage_state(spark, sf):
    """The same from stored bitmaps: a batch of two thirds of the orders, then one of the events
    and all orders, so that most ids come a second time."""
    path = scratch_path(spark, "coverage")
    names = F.create_map(*[F.lit(x) for x in ("F", "act_pre", "O", "deact_pre", "P", "ramp")])
    all_orders = table(spark, sf, "orders").select(
        names[F.col("o_orderstatus")].alias("source"), F.col("o_custkey").alias("id"), "o_orderdate"
    )
    late = all_orders.filter(F.dayofmonth("o_orderdate") > 10)
    events = table(spark, sf, "events").select(F.lit("dt").alias("source"), F.col("user_id").alias("id"))
    pairs = [df.select("source", "id") for df in (late, events, all_orders)]
    for part in (pairs[0], pairs[1].unionByName(pairs[2])):
        bitmaps.update(part, path, ["source"], parts=4)
    return bitmaps.coverage(spark, path, "source", ["act_pre", "deact_pre", "ramp", "dt"])


def _segment_bitmaps(spark, sf) -> str:
    path = scratch_path(spark, "coverage")
    rows = _by_segment(spark, sf)
    for cond in (["F", "P"], ["O", "P"]):
        bitmaps.update(rows.filter(F.col("cond").isin(cond)), path, ["segment", "cond"], parts=4)
    return path


def distinct_state(spark, sf):
    return bitmaps.distinct_counts(spark, _segment_bitmaps(spark, sf), ["segment", "cond"])


def common_ids(spark, sf):
    """Customers per segment with orders of every status."""
    return bitmaps.common_counts(spark, _segment_bitmaps(spark, sf), ["segment"], "cond", ["F", "O", "P"])


def lookup_correct(spark, sf):
    customers = table(spark, sf, "customer").join(
        F.broadcast(table(spark, sf, "nation")),
        F.col("c_nationkey") == F.col("n_nationkey"), "left",
    ).join(
        F.broadcast(table(spark, sf, "region")),
        F.col("n_regionkey") == F.col("r_regionkey"), "left",
    )
    named = add_lookup(
        customers.select("c_custkey", F.col("c_acctbal").alias("v"),
                         F.col("r_name").alias("region")),
        REGION_OFFSET, "region", "e_junc",
    )
    out = named.select("c_custkey", "region", (F.col("v") + F.col("e_junc")).alias("v_corr"))
    return rounded(out, 6, "v_corr")


# --- I-V curves from lineitem ----------------------------------------------------

IV_KEYS = ["id", "flag"]


def iv(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag"),
        (F.col("l_quantity") - 25).alias("v"),
        (F.round(F.col("l_extendedprice") * 100) / 100 - 35000).alias("i"),
    )


def timepoints(spark, sf):
    long = reshape.gather(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"],
        ["l_quantity", "l_discount", "l_tax"], "timepoint", "value",
    )
    with_time = add_lookup(long, MEASURE_CODE, "timepoint", "time")
    return with_time.groupBy("l_partkey", "timepoint", "time").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100)).alias("total")
    )


def critical_voltage(spark, sf):
    near = polyfit.near_critical(iv(spark, sf), IV_KEYS, half_width=10)
    return near.groupBy(*IV_KEYS, "v_crit").agg(
        F.count(F.lit(1)).alias("n_near"), F.min("v").alias("v_lo"), F.max("v").alias("v_hi")
    )


def fits(spark, sf) -> DataFrame:
    return polyfit.quadratic_fit(iv(spark, sf), IV_KEYS)


def _reversal(spark, sf) -> DataFrame:
    return polyfit.reversal(fits(spark, sf)).select(
        *IV_KEYS, "v_crit", "n", "e_rev", "e_test", "bad", "complex_root"
    )


def reversal(spark, sf):
    return rounded(_reversal(spark, sf), 4, "e_rev", "e_test")


def dubious(spark, sf):
    return rounded(
        polyfit.dubious(_reversal(spark, sf)).select(*IV_KEYS, "e_rev"), 4, "e_rev"
    )


QUALITY = ["r_squared", "adj_r_squared", "sigma", "statistic", "p_value", "log_lik",
           "aic", "bic"]


def quad_stats(spark, sf):
    out = polyfit.fit_quality(fits(spark, sf))
    return rounded(out.select(*IV_KEYS, "n", "df_residual", *QUALITY), 4, *QUALITY)


def quad_terms(spark, sf):
    out = polyfit.fit_terms(fits(spark, sf), IV_KEYS, p_values=False)
    return rounded(out.drop("df_residual"), 4, "estimate", "std_error", "statistic")


def quad_p_values(spark, sf):
    out = polyfit.fit_terms(fits(spark, sf), IV_KEYS)
    return rounded(out, 6, "estimate", "std_error", "statistic", "p_value")


def quad_curve(spark, sf):
    out = polyfit.predict(fits(spark, sf), step_grid(-25, 25), IV_KEYS)
    return rounded(out, 3, "fitted")


def reversal_shift(spark, sf):
    out = cohort.reversal_shift(_reversal(spark, sf), ["id"], "flag", "R", "A")
    return rounded(out, 4, "e_rev_inst", "e_rev_steady", "e_rev_shift")


def cell_measures(spark, sf):
    """Per-cell measures with the shift of the reversal joined to them; the first two
    lines of an order stand for the first and last time after the jump."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("channel"),
        F.col("l_linenumber").alias("sweep"), "l_quantity",
        (F.round(F.col("l_extendedprice") * 100) / 100 - 35000).alias("i"),
    )
    time = F.when(F.col("sweep") == 1, 3.0).when(F.col("sweep") == 2, 600.0)
    curves = rows.withColumn("time", time).withColumn("v_pulse", F.col("l_quantity") - 25)
    fits = steps.reversals(curves.filter("sweep <= 2"))
    summaries = rows.groupBy("id", "channel", "sweep").agg(
        F.sum("l_quantity").alias("i_ss"), F.count(F.lit(1)).cast("double").alias("i_inst")
    )
    out = steps.cell_measures_deactivating(summaries, fits, sweep=2)
    return rounded(out, 4, "fold_100", "e_rev_inst", "e_rev_steady", "e_rev_shift")


def pick_ratio(spark, sf):
    totals = iv(spark, sf).groupBy(*IV_KEYS).agg(
        F.sum("v").alias("sum_v"), F.count(F.lit(1)).alias("n")
    )
    out = totals.groupBy("id").agg(
        (cohort.pick_ratio("sum_v", "n", "flag", "N") * 100).alias("steady_percent"),
        cohort.pick("n", "flag", "R").alias("n_r"),
    )
    return rounded(out, 6, "steady_percent")


def reversal_summary(spark, sf):
    shown = cohort.inside_limits(_reversal(spark, sf), "e_rev", -20.0, 20.0)
    out = cohort.mean_se(shown, ["flag"], ["e_rev"])
    return rounded(out, 4, "e_rev_avg", "e_rev_lo", "e_rev_hi")


def box(spark, sf):
    out = cohort.box_stats(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(out, 4, "q1", "median", "q3", "whisker_lo", "whisker_hi")


# --- traces from embeddings ------------------------------------------------------


def vector_trace(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("pos", "e")
    ).select(
        "vec_id", F.col("pos").cast("long").alias("sample_idx"),
        (F.col("pos") / 100).alias("t_fit"), F.col("e").cast("double").alias("i"),
    )


def smooth(spark, sf):
    out = savgol(vector_trace(spark, sf), 3, 11, ["vec_id"])
    return rounded(out.select("vec_id", "sample_idx", "i_smooth"), 6, "i_smooth")


def smooth_by_sums(spark, sf):
    out = savgol_sums(vector_trace(spark, sf), 3, 11, ["vec_id"])
    return rounded(out.select("vec_id", "sample_idx", "i_smooth"), 6, "i_smooth")


def smooth_half_time(spark, sf):
    samples = vector_trace(spark, sf)
    levels = samples.groupBy("vec_id").agg(F.avg("i").alias("thresh"))
    return smoothed_half_time(samples, levels, "thresh", ["vec_id"], length=11)


def array_to_rows(spark, sf):
    def channel(s: Column, c: Column) -> Column:
        return F.slice("embedding", s * 32 + c * 16 + 1, 16)

    pair = F.sequence(F.lit(0), F.lit(1))
    traces = F.transform(pair, lambda s: F.transform(pair, lambda c: channel(s, c)))
    blocks = table(spark, sf, "embeddings").select("vec_id", traces.alias("traces"))
    out = arrays.block_to_rows(blocks, ["vec_id"], si=50.0)
    return out.withColumns({c: F.col(c).cast("double") for c in ("i", "v")})


def tile_time(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", step_grid(0, 15, 2.0).alias("time"), "embedding"
    )
    out = arrays.flat_to_rows(vectors, ["vec_id"], "time", {"i": "embedding"})
    return out.withColumn("i", F.col("i").cast("double"))


def _grid(spark, sf) -> DataFrame:
    return expfit.grid_fit(vector_trace(spark, sf), ["vec_id"], y="i", lrc1=LRC1, lrc2=LRC2)


def biexp_grid(spark, sf):
    numbers = ["A1", "A2", "C", "sse", "sigma", "log_lik", "aic", "bic"]
    out = _grid(spark, sf).select("vec_id", "n", "df_residual", "lrc1", "lrc2", *numbers)
    return rounded(out, 5, *numbers)


def _components(spark, sf) -> DataFrame:
    fit = write_table(_grid(spark, sf), "grid").df
    terms = reshape.gather(fit, ["vec_id"], list(expfit.TERMS), "term", "estimate")
    return expfit.components(terms, ["vec_id"])


def components(spark, sf):
    return rounded(_components(spark, sf), 5, "A", "C", "tau")


def spread_terms(spark, sf):
    fit = _grid(spark, sf)
    long = reshape.gather(fit, ["vec_id"], ["A1", "A2", "C"], "term", "estimate")
    wide = reshape.spread(long, ["vec_id"], "term", "estimate", ["A1", "A2", "C"])
    return rounded(wide, 5, "A1", "A2", "C")


def fit_curve(spark, sf):
    out = expfit.fitted_curve(_grid(spark, sf), step_grid(0, 63, 0.01), ["vec_id"])
    return rounded(out, 5, "t", "fitted")


def component_curves(spark, sf):
    out = expfit.component_curves(_components(spark, sf), step_grid(0, 63, 0.01), ["vec_id"])
    return rounded(out, 5, "t", "fitted")


def _truth(spark, sf) -> DataFrame:
    """Parameters of a relaxation per vector."""
    vec = F.col("vec_id")

    def amplitude(k: int, middle: float) -> Column:
        off = F.round(F.get("embedding", F.lit(k)).cast("double") * 100) / 1000
        return middle + F.least(F.greatest(off, F.lit(-0.3)), F.lit(0.3))

    return table(spark, sf, "embeddings").select(
        "vec_id", amplitude(0, 0.6).alias("a1"), (4.4 + F.pmod(vec, F.lit(7)) / 10).alias("l1"),
        amplitude(1, 0.4).alias("a2"), (1.6 + F.pmod(vec, F.lit(9)) / 10).alias("l2"),
        (0.05 + F.pmod(vec, F.lit(5)) / 100).alias("c"), "embedding",
    )


def known_trace(spark, sf) -> DataFrame:
    """Noiseless relaxations whose parameters come from the table; every fiftieth trace
    has no values."""
    vec, truth = F.col("vec_id"), _truth(spark, sf).drop("embedding")
    return truth.select("*", F.explode(step_grid(0, 299, 0.002)).alias("t_fit")).select(
        "vec_id", "t_fit",
        F.when(vec % 50 != 0, two_exp("t_fit", "a1", "l1", "a2", "l2", "c")).alias("i_norm"),
    )


def _known_fits(spark, sf) -> DataFrame:
    fit = expfit.refine_fit(known_trace(spark, sf), ["vec_id"], lrc1=LRC1, lrc2=LRC2)
    return write_table(fit, "fits").df


def biexp_refine(spark, sf):
    out = _known_fits(spark, sf).select(
        "vec_id", "n", (F.col("status") == "failed").alias("failed"), "error", *expfit.TERMS,
        "df_residual",
    )
    return rounded(out, 6, *expfit.TERMS)


def refine_terms(spark, sf):
    terms = expfit.fit_terms(_known_fits(spark, sf), ["vec_id"]).drop("statistic")
    exact = rounded(terms, 6, "estimate", "std_error", "p_value")
    return rounded(exact, 4, "conf_lo", "conf_hi")


def refine_taus(spark, sf):
    terms = expfit.fit_terms(_known_fits(spark, sf), ["vec_id"])
    taus = expfit.time_constants(terms, ["vec_id"])
    return rounded(taus, 5, "tau", "conf_lo", "conf_hi")


def residual_trace(spark, sf) -> DataFrame:
    """Relaxations with a residual at right angles to the five slopes, from the vectors.

    The parameters they are made from are the best ones, though every sample is off, and
    the residual and its errors are known.
    """
    vec = F.col("vec_id")

    @F.pandas_udf("array<double>")
    def off(a1: pd.Series, l1: pd.Series, a2: pd.Series, l2: pd.Series, vectors: pd.Series) -> pd.Series:
        t = np.arange(300) * 0.002
        out = []
        for *p, v in zip(a1, l1, a2, l2, vectors):
            e1, e2 = (np.exp(-np.exp(x) * t) for x in p[1::2])
            slopes = np.column_stack([e1, t * e1, e2, t * e2, np.ones_like(t)])
            q = np.linalg.qr(slopes)[0]
            raw = 0.1 * np.resize(np.asarray(v, float), 300)
            for _ in range(2):
                raw = raw - q @ (q.T @ raw)
            out.append(raw)
        return pd.Series(out)

    truth = _truth(spark, sf).withColumn("c", F.pmod(vec, F.lit(5)) / 500)
    truth = truth.withColumn("off", off("a1", "l1", "a2", "l2", "embedding")).drop("embedding")
    rows = truth.select("*", F.posexplode("off").alias("_i", "_off")).withColumn("t_fit", F.col("_i") * 0.002)
    y = two_exp("t_fit", "a1", "l1", "a2", "l2", "c") + F.col("_off")
    return rows.select("vec_id", "t_fit", y.alias("i_norm"))


def _residual_terms(spark, sf) -> DataFrame:
    fit = expfit.refine_fit(residual_trace(spark, sf), ["vec_id"], lrc1=LRC1, lrc2=LRC2)
    return expfit.fit_terms(write_table(fit, "fits").df, ["vec_id"])


def refine_errors(spark, sf):
    """Errors, t, probabilities and limits of fits with a known residual."""
    out = rounded(_residual_terms(spark, sf), 3, "estimate", "conf_lo", "conf_hi", "p_value")
    return rounded(rounded(out, 6, "std_error"), 1, "statistic")


def refine_tau_limits(spark, sf):
    """Time constants of the same fits, with their limits."""
    taus = expfit.time_constants(_residual_terms(spark, sf), ["vec_id"])
    return rounded(taus, 4, "tau", "conf_lo", "conf_hi")


def refine_noise(spark, sf):
    """Fits of noise, their residuals taken from the samples again."""
    fit = expfit.refine_fit(vector_trace(spark, sf), ["vec_id"], y="i", lrc1=LRC1, lrc2=LRC2)
    fit = write_table(fit, "fits").df
    best = _grid(spark, sf).select("vec_id", F.col("sse").alias("grid_sse"))
    res = F.col("i") - two_exp("t_fit", *expfit.TERMS[:4], "C")
    left = vector_trace(spark, sf).join(fit.select("vec_id", *expfit.TERMS), "vec_id")
    left = left.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(res * res).alias("left"))
    out = fit.select("vec_id", "sse", "status").join(left, "vec_id").join(best, "vec_id")
    same = F.abs(F.col("sse") - F.col("left")) <= 1e-9 * F.col("left")
    worse = F.col("sse") > F.col("grid_sse") * (1 + 1e-9)
    return out.select("vec_id", "n", same.alias("same"), (~worse).alias("no_worse"), F.round("grid_sse", 6).alias("grid_sse"))


def extremal_tail(spark, sf):
    """Tail values per sweep relative to the sweeps at the extreme steps, with ties."""
    idx = F.col("sample_idx")
    features = swept(spark, sf).groupBy(F.col("user_id").alias("recording"), "sweep").agg(
        F.max(F.when(idx == 2, F.round(F.col("i") / 2000))).alias("v_pulse"),
        F.sum(F.when(idx < 4, F.col("i"))).alias("i_tail"),
        F.sum(F.when(idx >= 4, F.col("i"))).alias("i_tail_ss"),
    )
    out = tail_norm(features)
    return rounded(out, 8, "norm_tail", "td_tail", "thresh_tail", "i_tail_ss_full")


def probe_beside(spark, sf):
    """Voltage at a probe between two samples: the nearer, the earlier, or none."""
    return swept(spark, sf).groupBy(*SWEEP).agg(
        nearest("i", 8.3, 0.5, "sample_idx").alias("near_8"),
        nearest("i", 8.7, 0.5, "sample_idx").alias("near_9"),
        nearest("i", 8.5, 0.6, "sample_idx").alias("earlier"),
        nearest("i", 8.5, 0.4, "sample_idx").alias("out_of_reach"),
    )


# --- text ------------------------------------------------------------------------


def lines(spark, sf):
    return text_lines(table(spark, sf, "documents"), "text", ["doc_id"]).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "line"
    )


def label_clean(spark, sf):
    parts = table(spark, sf, "part")
    file = F.concat_ws(".", F.col("p_name"), F.lit("001"), F.lit("txt"))
    return parts.select(
        "p_partkey", before_dot(file).alias("cond"), underscored("p_name", "file_").alias("key"),
        drop_tail(file, 4).alias("stem"),
    )


def name_tokens(spark, sf):
    pieces = tokens("c_name", "[#]")
    return table(spark, sf, "customer").select(
        "c_custkey", pieces[0].alias("kind"), F.size(pieces).alias("n_tokens"),
        first_number("c_name").alias("number"), F.substring("c_name", 1, 1).alias("letter"),
    )


def potentials(spark, sf):
    out = table(spark, sf, "part").select(
        "p_partkey", nernst("p_retailprice", "p_size").alias("e_mv")
    )
    return rounded(out, 6, "e_mv")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_half_time": half_time,
    "q_sweep_number": sweep_number,
    "q_phase_norm_act": phase_norm_act,
    "q_phase_norm_deact": phase_norm_deact,
    "q_tail_norm_ref": tail_norm_ref,
    "q_step_voltage": step_voltage,
    "q_sweep_features": sweep_features,
    "q_zero_crossing_mean": zero_crossing_mean,
    "q_phase_filter": phase_filter,
    "q_sweep_average": sweep_average,
    "q_cohort_curve": cohort_curve,
    "q_cohort_state": cohort_state,
    "q_nest_unnest": nest_unnest,
    "q_pixel_columns": pixel_columns,
    "q_summary_files": summary_files,
    "q_summary_commits": summary_commits,
    "q_landed_table": landed_table,
    "q_trace_files": trace_files,
    "q_trace_meta": trace_meta,
    "q_trace_landed": trace_landed,
    "q_trace_names": trace_names,
    "q_preview": preview,
    "q_union_protocols": union_protocols,
    "q_baseline_norm": baseline_norm,
    "q_percent_block": block,
    "q_pair_table": pair_table,
    "q_quality_points": quality_points,
    "q_extremal_norm": extremal_norm,
    "q_distinct_n": distinct_n,
    "q_id_listing": id_listing,
    "q_coverage": coverage,
    "q_coverage_state": coverage_state,
    "q_distinct_state": distinct_state,
    "q_common_ids": common_ids,
    "q_lookup_correct": lookup_correct,
    "q_timepoints": timepoints,
    "q_critical_voltage": critical_voltage,
    "q_reversal": reversal,
    "q_dubious": dubious,
    "q_quad_stats": quad_stats,
    "q_quad_terms": quad_terms,
    "q_quad_p_values": quad_p_values,
    "q_quad_curve": quad_curve,
    "q_reversal_shift": reversal_shift,
    "q_cell_measures": cell_measures,
    "q_pick_ratio": pick_ratio,
    "q_reversal_summary": reversal_summary,
    "q_box_stats": box,
    "q_savgol": smooth,
    "q_savgol_sums": smooth_by_sums,
    "q_savgol_half_time": smooth_half_time,
    "q_array_to_rows": array_to_rows,
    "q_tile_time": tile_time,
    "q_biexp_grid": biexp_grid,
    "q_components": components,
    "q_spread_terms": spread_terms,
    "q_fit_curve": fit_curve,
    "q_component_curves": component_curves,
    "q_biexp_refine": biexp_refine,
    "q_refine_terms": refine_terms,
    "q_refine_taus": refine_taus,
    "q_refine_errors": refine_errors,
    "q_refine_tau_limits": refine_tau_limits,
    "q_refine_noise": refine_noise,
    "q_extremal_tail": extremal_tail,
    "q_probe_beside": probe_beside,
    "q_text_lines": lines,
    "q_label_clean": label_clean,
    "q_tokens": name_tokens,
    "q_nernst": potentials,
}
