"""Sample-level annotation: sweep numbers, sign, phases, step voltage, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import half_even, nernst
from sweepframe.protocol import Protocol, Window

SWEEP_KEYS = ("recording", "sweep")


def number_sweeps(
    df: DataFrame, n_per_sweep: int, position: str = "pos", total: str | None = None
) -> DataFrame:
    """Sweep number and sample number from the position in the recording.

    ``total`` names a column with the sample count of the recording; rows of a
    last sweep that is cut short are then marked ``complete = false``.
    """
    pos, n = F.col(position), F.lit(n_per_sweep)
    out = df.withColumns(
        {
            "sweep": (F.floor(pos / n) + 1).cast("int"),
            "sample_idx": F.pmod(pos, n).cast("long"),
        }
    )
    if total is not None:
        whole = F.floor(F.col(total) / n)
        out = out.withColumn("complete", F.col("sweep") <= whole)
    return out


def add_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Constant text columns on every row."""
    return df.withColumns({name: F.lit(value) for name, value in labels.items()})


def flip(df: DataFrame, columns: Sequence[str] = ("i", "v")) -> DataFrame:
    """Reverse the sign convention."""
    return df.withColumns({c: -F.col(c) for c in columns})


def cut(df: DataFrame, window: Window, t: str = "t") -> DataFrame:
    """Samples strictly inside a time window."""
    return df.filter(window.holds(t))


def shifted_time(anchor: float, offset: float = 0.001, t: str = "t") -> Column:
    """Time since ``anchor`` plus the protocol's one-millisecond offset."""
    return F.col(t) - F.lit(anchor) + F.lit(offset)


def nearest(value: str, at: float, tolerance: float, t: str = "t") -> Column:
    """Aggregate: ``value`` at the sample closest to time ``at``.

    The earlier of two equally close samples wins; NULL when no sample lies
    within ``tolerance``. Built from aggregates with plain numeric buffers, so
    Spark can hash-aggregate instead of sorting the samples.
    """
    time = F.col(t)
    before = F.when(time.between(at - tolerance, at), time)
    after = F.when((time > at) & (time <= at + tolerance), time)
    gap_before = F.lit(at) - F.max(before)
    gap_after = F.min(after) - F.lit(at)
    take_later = gap_before.isNull() | (gap_after < gap_before)
    return F.when(take_later, F.min_by(value, after)).otherwise(F.max_by(value, before))


def step_voltage(p: Protocol) -> Column:
    """Aggregate: rounded voltage of the step, read at the probe time."""
    # a hair of slack: the probe time itself is rarely a binary fraction
    return half_even(nearest("v", p.probe, p.dt / 2 * (1 + 1e-9)))


def junction_potentials(df_or_spark) -> DataFrame:
    """Liquid-junction offsets (mV) per pipette solution, and the K+ potential."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    # Solution, measured junction potential.
    offsets = [("5K-Na", -6.8), ("5K-NMDG", -9.8), ("5K-Li", -2.9)]
    return spark.createDataFrame(offsets, "Pip string, e_junc double").withColumn(
        "ek", nernst(140.0, 5.0)
    )


def correct_junction(
    df: DataFrame, potentials: DataFrame | None = None, on: str = "Pip"
) -> DataFrame:
    """Add the junction offset to the voltage (NULL for unknown solutions).

    The lookup has one row per solution and is handed in by the caller or is
    the constant table above, so it is broadcast.
    """
    table = junction_potentials(df) if potentials is None else potentials
    return df.join(F.broadcast(table), on, "left").withColumn(
        "v_corr", F.col("v") + F.col("e_junc")
    )


def add_lookup(df: DataFrame, pairs: dict[str, float], key: str, value: str) -> DataFrame:
    """Left join to a constant table given as a dict."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(pairs.items()), f"`{key}` string, `{value}` double")
    return df.join(F.broadcast(table), key, "left")
