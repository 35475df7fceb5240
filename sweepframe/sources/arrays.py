"""Recordings that arrive as arrays: acquisition blocks and exported matrices.

Decoding the binary files is left to a codec; these functions start from array
columns and return tidy sample rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_to_rows(
    df: DataFrame, keys: Sequence[str], traces: str = "traces", si: Column | float = 50.0
) -> DataFrame:
    """Array ``[sweep][channel][point]`` to rows; channel 1 is current, 2 voltage.

    ``si`` is the sample interval in microseconds, ``time_ms`` counts from the
    start of the sweep.
    """
    step = si if isinstance(si, Column) else F.lit(float(si))
    sweeps = df.select(
        *keys, step.alias("_si"), F.posexplode(traces).alias("_sweep", "_channels")
    )
    points = sweeps.select(
        *keys,
        "_si",
        (F.col("_sweep") + 1).alias("sweep"),
        F.posexplode(
            F.arrays_zip(
                F.get("_channels", F.lit(0)).alias("i"),
                F.get("_channels", F.lit(1)).alias("v"),
            )
        ).alias("sample_idx", "_s"),
    )
    return points.select(
        *keys,
        "sweep",
        F.col("sample_idx").cast("long").alias("sample_idx"),
        (F.col("sample_idx") * F.col("_si") / 1000).alias("time_ms"),
        F.col("_s")["i"].alias("i"),
        F.col("_s")["v"].alias("v"),
    )


def points_to_block(points: Column) -> Column:
    """``[point][channel][sweep]`` (acquisition order) to ``[sweep][channel][point]``."""
    n_channels = F.size(F.get(points, F.lit(0)))
    n_sweeps = F.size(F.get(F.get(points, F.lit(0)), F.lit(0)))
    return F.transform(
        F.sequence(F.lit(0), n_sweeps - 1),
        lambda s: F.transform(
            F.sequence(F.lit(0), n_channels - 1),
            lambda c: F.transform(points, lambda p: F.get(F.get(p, c), s)),
        ),
    )


def alternating_to_rows(
    df: DataFrame, keys: Sequence[str], entries: str = "entries"
) -> DataFrame:
    """List of (time, I/V) entries, one per sweep, to rows.

    ``entries`` is ``array<struct<t: array<double>, iv: array<struct<I, V>>>>``.
    The time base of the first sweep serves all sweeps.
    """
    sweeps = df.select(
        *keys,
        F.get(entries, F.lit(0))["t"].alias("_time"),
        F.posexplode(entries).alias("_sweep", "_entry"),
    )
    points = sweeps.select(
        *keys,
        "_time",
        (F.col("_sweep") + 1).alias("sweep"),
        F.posexplode(F.col("_entry")["iv"]).alias("sample_idx", "_iv"),
    )
    return points.select(
        *keys,
        "sweep",
        F.col("sample_idx").cast("long").alias("sample_idx"),
        F.get("_time", F.col("sample_idx")).alias("t"),
        F.col("_iv")["I"].alias("i"),
        F.col("_iv")["V"].alias("v"),
    )


def flat_to_rows(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    channels: dict[str, str],
    per_second: float = 1000.0,
) -> DataFrame:
    """One time vector for a sweep plus channels over all sweeps, to rows.

    ``channels`` maps output columns to array columns, so either channel order
    can be read. The time vector is repeated for each sweep and converted to
    seconds.
    """
    zipped = F.arrays_zip(*[F.col(a).alias(name) for name, a in channels.items()])
    rows = df.select(
        *keys, F.col(time).alias("_time"), F.posexplode(zipped).alias("_pos", "_s")
    )
    n = F.size("_time")
    return rows.select(
        *keys,
        (F.floor(F.col("_pos") / n) + 1).cast("int").alias("sweep"),
        (F.col("_pos") % n).cast("long").alias("sample_idx"),
        (F.get("_time", F.col("_pos") % n) / per_second).alias("t"),
        *[F.col("_s")[name].alias(name) for name in channels],
    )
