"""Per-sweep features: conditional window means and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import ratio
from sweepframe.operators.annotate import SWEEP_KEYS, step_voltage
from sweepframe.operators.keyed import attach
from sweepframe.protocol import Protocol, Window
from sweepframe.session import write_table


def mean_where(value: str, condition: Column) -> Column:
    """Aggregate: mean of the rows that satisfy a condition, NULL if none does."""
    return F.avg(F.when(condition, F.col(value)))


def window_means(
    df: DataFrame,
    windows: dict[str, Window],
    keys: Sequence[str] = SWEEP_KEYS,
    value: str = "i",
    t: str = "t",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """All window means of a sweep in one pass over its samples."""
    aggregates = {n: mean_where(value, w.holds(t)) for n, w in windows.items()}
    aggregates |= extra or {}
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def derive(features: DataFrame, prepulse: bool) -> DataFrame:
    """Amplitudes, ratios and half-way thresholds."""
    inst, ss = F.col("i_inst"), F.col("i_ss")
    if not prepulse:
        swing = ss - inst
        return features.withColumns(
            {
                "td_current": swing,
                "td_ratio": ratio(swing, ss),
                "frac_tail": ratio("i_tail", "i_tail_ss"),
                "thresh": inst + swing / 2,
            }
        )
    inst_pre, ss_pre = F.col("i_inst_pre"), F.col("i_ss_pre")
    return features.withColumns(
        {
            "td_test": inst - ss,
            "thresh_test": (inst + ss) / 2,
            "decay_pulse": 1 - ratio(ss, inst),
            "td_pre": ss_pre - inst_pre,
            "thresh": (inst_pre + ss_pre) / 2,
            "fold_pre": ratio(ss_pre, inst_pre),
        }
    )


def tail_norm(
    features: DataFrame, by: Sequence[str] = ("recording",), v: str = "v_pulse"
) -> DataFrame:
    """Tail currents relative to the sweeps at the two extreme step voltages.

    Of several sweeps at the highest (lowest) step the last (first) one counts.

    The recording-wide values come from an aggregate joined back, so a
    recording with any number of sweeps is fine.
    """
    known = features.filter(F.col(v).isNotNull())
    per_step = known.groupBy(*by, v).agg(
        F.max_by("i_tail", "sweep").alias("_tail"),
        F.min_by("i_tail_ss", "sweep").alias("_tail_ss"),
    )
    extremes = per_step.groupBy(*by).agg(
        F.max_by("_tail", v).alias("_peak_tail"),
        F.min_by("_tail_ss", v).alias("i_tail_ss_full"),
    )
    full = attach(features, extremes, by)
    return full.withColumns(
        {
            "norm_tail": ratio("i_tail", "_peak_tail"),
            "td_tail": F.col("i_tail") - F.col("i_tail_ss_full"),
            "thresh_tail": (F.col("i_tail") + F.col("i_tail_ss_full")) / 2,
        }
    ).drop("_peak_tail")


def sweep_features(
    samples: DataFrame, p: Protocol, keys: Sequence[str] = SWEEP_KEYS,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per sweep: step voltage, window means, derived values, tail values.

    Key columns beyond recording and sweep (metadata of the recording) are
    carried along.
    """
    means = window_means(
        samples, p.feature_windows(), keys, extra={"v_pulse": step_voltage(p)} | (extra or {})
    )
    # the tail values read this table twice; the samples are scanned once
    return tail_norm(derive(write_table(means, "window-means").df, p.has_prepulse))
