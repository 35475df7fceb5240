"""Step protocols: per-sweep summaries, then reversal potentials across cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.operators.annotate import (
    SWEEP_KEYS,
    add_lookup,
    flip,
    shifted_time,
)
from sweepframe.operators.cohort import (
    inside_limits,
    mean_se,
    pick,
    pick_ratio,
    reversal_shift,
)
from sweepframe.operators.crossing import smoothed_half_time
from sweepframe.operators.features import sweep_features
from sweepframe.operators.keyed import matched
from sweepframe.operators.polyfit import quadratic_fit, reversal
from sweepframe.operators.reshape import gather, spread
from sweepframe.protocol import Protocol, Window
from sweepframe.session import write_table

META = ("id", "channel", "Pip", "file")


def phases(p: Protocol) -> dict[str, tuple[Window, float, str]]:
    """Per half-time: its phase, the anchor of its clock and its threshold."""
    tail = {"tapp50_tail": (p.tail_phase(), p.t_post, "thresh_tail")}
    if not p.has_prepulse:
        return {"tapp50": (p.test_phase(), p.t_test, "thresh")} | tail
    return {
        "tapp50_pre": (p.pre_phase(), p.t_pre, "thresh"),
        "tapp50_test": (p.test_phase(), p.t_test, "thresh_test"),
    } | tail


def half_times(samples: DataFrame, features: DataFrame, p: Protocol) -> DataFrame:
    """Half-times of every phase of the protocol joined to the sweep features.

    Thresholds are in units of the raw current, so the raw trace is smoothed.
    The phases do not overlap, so one scan and one shuffle serve all of them.
    """
    keys = list(SWEEP_KEYS)
    parts = phases(p)

    def by_phase(value: Callable[[tuple[Window, float, str]], Column]) -> Column:
        return F.coalesce(
            *[F.when(part[0].holds("t"), value(part)) for part in parts.values()]
        )

    name_of = {part[2]: name for name, part in parts.items()}
    last = "_last" if "_last" in features.columns else None
    labelled = samples.select(*keys, "sample_idx", "t", "i").withColumns(
        {
            "phase": by_phase(lambda part: F.lit(name_of[part[2]])),
            "t_fit": by_phase(lambda part: shifted_time(part[1], p.t_offset)),
        }
    )
    level = [
        F.struct(F.lit(name_of[part[2]]).alias("phase"), F.col(part[2]).alias("level"))
        for part in parts.values()
    ]
    levels = features.select(*keys, *([last] if last else []), F.inline(F.array(*level)))
    half = smoothed_half_time(
        labelled.filter(F.col("phase").isNotNull()), levels, "level", [*keys, "phase"],
        order=p.sg_order, length=p.sg_length, last=last,
    )
    wide = spread(half, keys, "phase", "t_half", list(parts))
    return matched(features, wide, keys).drop("_last")


def summarise(
    samples: DataFrame, p: Protocol, meta: Sequence[str] = META, invert: bool = True
) -> DataFrame:
    """One row per sweep: features, tail normalisation, half-times, metadata."""
    physiological = flip(samples) if invert else samples
    last = {"_last": F.max("sample_idx")}
    features = sweep_features(physiological, p, [*SWEEP_KEYS, *meta], last)
    return half_times(physiological, write_table(features, "sweep-features").df, p)


@dataclass(frozen=True)
class ReversalAnalysis:
    """Tables of one protocol across all cells."""

    iv: DataFrame
    fits: DataFrame
    per_id: DataFrame


def timepoints(summaries: DataFrame, p: Protocol) -> DataFrame:
    """Long I-V table: one row per sweep and time after the jump."""
    long = gather(
        summaries, ["id", "channel", "v_pulse"], list(p.timepoints_ms), "timepoint", "i"
    )
    return add_lookup(long, p.timepoints_ms, "timepoint", "time")


def reversals(iv: DataFrame) -> DataFrame:
    """Reversal potential per cell, channel and time."""
    return reversal(quadratic_fit(iv, ["id", "channel", "time"], "v_pulse", "i"))


def cell_measures_deactivating(
    summaries: DataFrame, fits: DataFrame, sweep: int = 23
) -> DataFrame:
    """Current ratio on the step to the probe sweep, and the shift of the reversal."""
    own = summaries.groupBy("id", "channel").agg(
        pick_ratio("i_ss", "i_inst", "sweep", sweep).alias("fold_100"),
        F.lit("deactivating").alias("prepulse"),
    )
    return matched(own, _shift(fits), ["id", "channel"])


def cell_measures_activating(
    summaries: DataFrame, fits: DataFrame, first: int = 1, last: int = 23
) -> DataFrame:
    """Persistent current (percent) and half-times at the two extreme sweeps."""
    own = summaries.groupBy("id", "channel").agg(
        (pick_ratio("i_ss", "i_inst", "sweep", first) * 100).alias("steady_m120_percent"),
        pick("tapp50_test", "sweep", first).alias("tapp_deact_m120"),
        pick("tapp50_tail", "sweep", last).alias("tapp50_tail_100"),
        F.lit("activating").alias("prepulse"),
    )
    return matched(own, _shift(fits), ["id", "channel"])


def _shift(fits: DataFrame) -> DataFrame:
    return reversal_shift(fits, ["id", "channel"], "time", 3.0, 600.0)


def analyse(summaries: DataFrame, p: Protocol) -> ReversalAnalysis:
    """I-V table, fits with reversal potentials, and per-cell measures."""
    iv = timepoints(summaries, p)
    fits = write_table(reversals(iv), "reversals").df
    measures = cell_measures_activating if p.has_prepulse else cell_measures_deactivating
    return ReversalAnalysis(iv, fits, measures(summaries, fits))


def reversal_summary(
    fits: DataFrame, limits: tuple[float, float] | None = None
) -> DataFrame:
    """Mean and standard error of the reversal potential per channel and time.

    Axis limits remove values before the mean is taken.
    """
    shown = fits if limits is None else inside_limits(fits, "e_rev", *limits)
    return mean_se(shown, ["channel", "time"], ["e_rev"])


def per_patch(deactivating: DataFrame, activating: DataFrame) -> DataFrame:
    """Per-cell measures of both protocols; columns of only one are NULL elsewhere."""
    return deactivating.unionByName(activating, allowMissingColumns=True)


def combined_sweeps(deactivating: DataFrame, activating: DataFrame) -> DataFrame:
    """Per-sweep rows of both protocols with a protocol label."""
    return deactivating.withColumn("protocol", F.lit("deact. pre p.")).unionByName(
        activating.withColumn("protocol", F.lit("act. pre p.")), allowMissingColumns=True
    )
