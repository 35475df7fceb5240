"""Normalisation of traces and of per-recording measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import ratio
from sweepframe.operators.annotate import SWEEP_KEYS, cut, shifted_time
from sweepframe.operators.features import mean_where
from sweepframe.operators.keyed import attach, attach_aggregates, matched
from sweepframe.protocol import Protocol, Window
from sweepframe.session import write_table


def to_baseline(
    df: DataFrame, by: Sequence[str], baseline: Column, value: str = "i",
    name: str = "i_norm",
) -> DataFrame:
    """Value divided by the mean of the group's baseline rows."""
    return (
        attach_aggregates(df, by, {"_base": mean_where(value, baseline)})
        .withColumn(name, ratio(value, "_base"))
        .drop("_base")
    )


def to_extremes(
    df: DataFrame, by: Sequence[str], value: str, key: str,
    at_max: str = "at_max", at_min: str = "at_min", tie: str | None = None,
) -> DataFrame:
    """Bring the values at the largest and the smallest key of a group to its rows.

    Of several rows at the largest (smallest) key the one with the largest (smallest)
    ``tie`` counts; without ``tie`` the largest (smallest) value.
    """
    tie = tie or value
    known = df.filter(F.col(key).isNotNull())
    per_key = known.groupBy(*by, key).agg(
        F.max_by(value, tie).alias("_top"), F.min_by(value, tie).alias("_bottom")
    )
    extremes = per_key.groupBy(*by).agg(
        F.max_by("_top", key).alias(at_max), F.min_by("_bottom", key).alias(at_min)
    )
    return attach(df, extremes, by)


def percent_block(
    measures: DataFrame,
    by: Sequence[str] = ("id", "Pip"),
    cond: str = "cond",
    baseline: str = "baseline",
    value: str = "i_0",
) -> DataFrame:
    """Percent of the baseline current that is gone, per condition.

    ``n_baseline`` counts the baseline rows of the group; the block is defined
    only when there is exactly one.
    """
    is_base = F.col(cond) == F.lit(baseline)
    with_base = attach_aggregates(
        measures,
        by,
        {
            "_base": F.max(F.when(is_base, F.col(value))),
            "n_baseline": F.count_if(is_base),
        },
    )
    block = (1 - ratio(value, "_base")) * 100
    return with_base.withColumn(
        "block", F.when(F.col("n_baseline") == 1, block)
    ).drop("_base")


def flag_pairs(
    measures: DataFrame,
    by: Sequence[str] = ("id",),
    cond: str = "cond",
    baseline: str = "baseline",
    expected: int = 2,
) -> DataFrame:
    """Whether a group has the expected number of measures, and which kinds."""
    is_base = F.col(cond) == F.lit(baseline)
    return attach_aggregates(
        measures,
        by,
        {
            "block_measured": F.count(F.lit(1)) == expected,
            "has_baseline": F.max(is_base),
            "has_treated": F.max(~is_base),
        },
    )


def pair_baseline(
    measures: DataFrame,
    by: Sequence[str] = ("id", "Pip"),
    cond: str = "cond",
    baseline: str = "baseline",
    carry: Sequence[str] = ("block",),
    potential: str = "mp",
) -> DataFrame:
    """Baseline rows with the treated rows of the same group beside them.

    A baseline without treatment is kept, with NULLs. Both sides are per-condition
    summaries, so a group has a handful of rows.
    """
    keys = list(by)
    is_base = F.col(cond) == F.lit(baseline)
    left = measures.filter(is_base).drop(cond, *carry)
    right = measures.filter(~is_base).select(
        *keys, *carry, F.col(potential).alias(f"{potential}_treated")
    )
    return matched(left, right, keys).withColumn(
        f"{potential}_shift", F.col(f"{potential}_treated") - F.col(potential)
    )


def phase_norm(
    samples: DataFrame,
    phase: Window,
    zero: Window,
    one: Window,
    anchor: float,
    keys: Sequence[str] = SWEEP_KEYS,
    t_offset: float = 0.001,
    name: str = "i_norm",
    extra: dict[str, Column] | None = None,
    only: Column | None = None,
) -> DataFrame:
    """Scale one phase of each sweep so that ``zero`` maps to 0 and ``one`` to 1.

    Activating traces take their zero from the onset and their one from the
    settled end; deactivating traces the other way round. ``extra`` aggregates
    are taken over the whole sweep in the same pass, and ``only`` keeps the
    sweeps that satisfy a condition on them.
    """
    part = cut(samples, phase)
    per_sweep = (samples if extra else part).groupBy(*keys).agg(
        mean_where("i", zero.holds("t")).alias("offset"),
        mean_where("i", one.holds("t")).alias("_one"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return _scaled(_attach_kept(part, per_sweep, keys, only), anchor, t_offset, name)


def tail_phase_norm(
    samples: DataFrame,
    p: Protocol,
    keys: Sequence[str] = SWEEP_KEYS,
    by: Sequence[str] = ("recording",),
    name: str = "i_norm",
    extra: dict[str, Column] | None = None,
    only: Column | None = None,
) -> DataFrame:
    """Scale tails to their onset, with one zero for the whole recording.

    The zero is the settled end of the reference sweep, because the other
    sweeps do not always relax completely. The reference sweep counts even if
    ``only`` drops it.
    """
    settled = p.settled(p.t_steady).holds("t")
    return tail_norm_by_reference(
        samples,
        phase=p.tail_phase().holds("t"),
        zero=settled & (F.col("sweep") == F.lit(p.ref_sweep)),
        one=p.onset(p.t_post).holds("t"),
        anchor=p.t_post,
        keys=keys,
        by=by,
        t_offset=p.t_offset,
        name=name,
        extra=extra,
        only=only,
    )


def tail_norm_by_reference(
    samples: DataFrame,
    phase: Column,
    zero: Column,
    one: Column,
    anchor: float,
    keys: Sequence[str],
    by: Sequence[str],
    t_offset: float = 0.001,
    name: str = "i_norm",
    extra: dict[str, Column] | None = None,
    only: Column | None = None,
) -> DataFrame:
    """Zero from one condition over the recording, one from a condition per sweep.

    Both means come from one pass: sums per sweep, then the recording's zero
    from the sums of its sweeps.
    """
    part = samples.filter(phase)
    per_sweep = (samples if extra else part).groupBy(*keys).agg(
        mean_where("i", one).alias("_one"),
        F.sum(F.when(zero, F.col("i"))).alias("_zero_sum"),
        F.count(F.when(zero, F.col("i"))).alias("_zero_n"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    # used for the reference and for the sweeps: scan the samples once
    per_sweep = write_table(per_sweep, "sweep-means").df
    reference = per_sweep.groupBy(*by).agg(
        ratio(F.sum("_zero_sum"), F.sum("_zero_n")).alias("offset")
    )
    stats = attach(per_sweep.drop("_zero_sum", "_zero_n"), reference, by)
    return _scaled(_attach_kept(part, stats, keys, only), anchor, t_offset, name)


def _attach_kept(
    part: DataFrame, per_sweep: DataFrame, keys: Sequence[str], only: Column | None
) -> DataFrame:
    if only is None:
        return attach(part, per_sweep, keys)
    return attach(part, per_sweep.filter(only), keys, "inner")


def _scaled(df: DataFrame, anchor: float, t_offset: float, name: str) -> DataFrame:
    # mean(i - offset) over the window equals mean(i) - offset
    return df.withColumns(
        {
            "norm": F.col("_one") - F.col("offset"),
            name: ratio(
                F.col("i") - F.col("offset"), F.col("_one") - F.col("offset")
            ),
            "t_fit": shifted_time(anchor, t_offset),
        }
    ).drop("_one")
