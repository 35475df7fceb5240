"""Tables behind the summary graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import step_grid
from sweepframe.operators.annotate import SWEEP_KEYS, cut, shifted_time
from sweepframe.operators.cohort import box_stats, inside_limits
from sweepframe.operators.keyed import attach
from sweepframe.operators.polyfit import predict
from sweepframe.operators.reshape import gather, pixels
from sweepframe.operators.smooth import savgol
from sweepframe.plans.relax import RelaxationFits
from sweepframe.protocol import Protocol, Window


def cohort_iv(by_channel: DataFrame, channel: str) -> DataFrame:
    """Cohort I-V of one channel in nA with its error band."""
    shown = by_channel.filter(F.col("channel") == channel)
    return shown.select(
        "Pip", "cond", "v_corr", *[(F.col(c) / 1000).alias(c) for c in ("i_avg", "i_lo", "i_hi")]
    )


def cohort_iv_near_zero(
    by_channel: DataFrame, lo: float = -200.0, hi: float = 500.0
) -> DataFrame:
    """Cohort curves inside the axis limits; an edge of the band outside is NULL."""
    shown = inside_limits(by_channel, "i_avg", lo, hi)
    return shown.withColumns(
        {c: F.when(F.col(c).between(lo, hi), F.col(c)) for c in ("i_lo", "i_hi")}
    )


def recording_box(quality: DataFrame, channel: str, value: str) -> DataFrame:
    """Box-plot statistics per solution over complete pairs of one channel."""
    shown = quality.filter((F.col("channel") == channel) & F.col("block_measured"))
    return box_stats(shown, ["Pip"], value)


def step_timecourse(
    samples: DataFrame, p: Protocol, columns: int | None = None, keys: Sequence[str] = SWEEP_KEYS
) -> DataFrame:
    """Samples around the step; with ``columns`` at most four points per sweep and column."""
    shown = Window(p.t_pre - 0.05, p.t_steady)
    part = cut(samples, shown)
    return part if columns is None else pixels(part, keys, "t", "i", shown.lo, shown.hi, columns)


def instant_and_steady_iv(features: DataFrame) -> DataFrame:
    return gather(
        features, ["recording", "sweep", "v_pulse"], ["i_ss", "i_inst"], "measure", "i"
    )


def tail_iv(features: DataFrame) -> DataFrame:
    """Normalised tail current against the step voltage, per sweep."""
    shown = features.filter(F.col("v_pulse").isNotNull() & F.col("norm_tail").isNotNull())
    return shown.select("recording", "sweep", "v_pulse", "norm_tail")


def smoothed_trace(
    samples: DataFrame, features: DataFrame, p: Protocol, phase: Window, anchor: float,
    levels: Sequence[str], keys: Sequence[str] = SWEEP_KEYS,
) -> DataFrame:
    """Raw and smoothed samples of a phase with the sweep's thresholds beside them."""
    part = cut(samples.select(*keys, "sample_idx", "t", "i"), phase)
    smooth = savgol(part, p.sg_order, p.sg_length, keys)
    return attach(
        smooth.withColumn("t_fit", shifted_time(anchor, p.t_offset)),
        features.select(*keys, *levels),
        keys,
    )


def polynomial_overlay(
    fits: DataFrame, keys: Sequence[str] = ("id", "channel", "time")
) -> DataFrame:
    """Fitted parabolas from -120 to 100 mV in steps of 1 mV."""
    return predict(fits, step_grid(-120, 100), keys, "v_pulse")


def fit_traces(
    relaxation: DataFrame, fits: RelaxationFits, keys: Sequence[str] = SWEEP_KEYS,
    t: Window = Window(0.0, 0.6), y: Window = Window(0.0, 1.0), columns: int | None = None,
) -> DataFrame:
    """Normalised samples, fitted curve and components of each sweep on one axis.

    ``kind`` is ``sample``, ``fitted``, ``fast`` or ``slow``. Rows outside the axis
    limits are left out; the limits themselves are inside. With ``columns``, at most four
    points per curve and pixel column come back, each with its place in the column as
    ``point``.
    """
    keys = list(keys)
    parts = (
        relaxation.select(
            *keys, F.lit("sample").alias("kind"), F.col("t_fit").alias("t"),
            F.col("i_norm").alias("value"),
        ),
        fits.curves(keys).select(
            *keys, F.lit("fitted").alias("kind"), "t", F.col("fitted").alias("value")
        ),
        fits.component_curves(keys).select(
            *keys, F.col("speed").alias("kind"), "t", F.col("fitted").alias("value")
        ),
    )
    shown = F.col("t").between(t.lo, t.hi) & F.col("value").between(y.lo, y.hi)
    curves = reduce(DataFrame.unionByName, parts).filter(shown)
    if columns is None:
        return curves
    named = curves.withColumnRenamed("kind", "curve")
    few = pixels(named, [*keys, "curve"], "t", "value", t.lo, t.hi, columns)
    return few.withColumnsRenamed({"kind": "point", "curve": "kind"})


def fit_overlay(parameters: DataFrame) -> DataFrame:
    """Component parameters in long form."""
    return gather(
        parameters, ["recording", "sweep", "speed"], ["A", "C", "tau"], "term", "estimate"
    )
