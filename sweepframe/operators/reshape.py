"""Long, wide and nested forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.operators.annotate import SWEEP_KEYS
from sweepframe.operators.keyed import BLOCK


def gather(
    df: DataFrame, ids: Sequence[str], values: Sequence[str],
    key: str = "term", value: str = "value",
) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), key, value)


def spread(
    df: DataFrame, ids: Sequence[str], key: str, value: str, levels: Sequence[str]
) -> DataFrame:
    """Long to wide for the given levels of ``key``; of several values the largest."""
    return df.groupBy(*ids).pivot(key, list(levels)).agg(F.max(value))


def pixels(
    df: DataFrame, keys: Sequence[str], x: str, y: str, lo: float, hi: float, columns: int = 1000
) -> DataFrame:
    """At most four points per trace and pixel column: what a line through all samples shows.

    The axis from ``lo`` to ``hi`` has so many columns; samples outside are left out, the
    limits are inside. Of each column's samples the ``first`` and ``last`` stay, and the
    ``low`` and ``high`` of the values between them if they go beyond, in the middle of
    the two. So extremes and crossings survive, and a plot's size depends on its width, not
    on the recording. One aggregate of plain numbers. ``x`` must be unique in a trace;
    samples without a value are left out.
    """
    place = F.floor((F.col(x) - lo) / (hi - lo) * columns).cast("int")
    rows = df.where(F.col(x).between(lo, hi) & F.col(y).isNotNull())
    rows = rows.select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
        F.least(place, F.lit(columns - 1)).alias("pixel"),
    )
    ends = rows.groupBy(*keys, "pixel").agg(
        F.min("_x").alias("_x0"), F.min_by("_y", "_x").alias("_y0"),
        F.max("_x").alias("_x1"), F.max_by("_y", "_x").alias("_y1"),
        F.min("_y").alias("_low"), F.max("_y").alias("_high"),
    )
    middle = (F.col("_x0") + F.col("_x1")) / 2

    def point(kind: str, at, value, shown=None):
        out = F.struct(F.lit(kind).alias("kind"), F.col(at).alias(x) if isinstance(at, str) else at.alias(x), F.col(value).alias(y))
        return out if shown is None else F.when(shown, out)

    points = F.array(
        point("first", "_x0", "_y0"),
        point("low", middle, "_low", F.col("_low") < F.least("_y0", "_y1")),
        point("high", middle, "_high", F.col("_high") > F.greatest("_y0", "_y1")),
        point("last", "_x1", "_y1", F.col("_x1") > F.col("_x0")),
    )
    return ends.select(*keys, "pixel", F.inline(F.array_compact(points)))


def nest_sweeps(
    samples: DataFrame,
    keys: Sequence[str] = SWEEP_KEYS,
    idx: str = "sample_idx",
    name: str = "samples",
    block: int = BLOCK,
) -> DataFrame:
    """Sorted arrays of samples, one per key and block of ``block`` positions.

    A sweep of ordinary length is one array; a longer one is several, so that
    no array grows with the data.
    """
    inner = [idx, *[c for c in samples.columns if c not in {*keys, idx}]]
    return (
        samples.withColumn("block", F.floor(F.col(idx) / F.lit(block)))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct(*inner))).alias(name))
    )


def unnest(
    df: DataFrame, arrays: str | Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """One row per array element.

    One array of structs becomes its fields; several arrays are walked in
    parallel and become one column each.
    """
    if isinstance(arrays, str):
        keep = [c for c in df.columns if c != arrays]
        return df.select(*keep, F.inline(arrays))
    keep = [c for c in df.columns if c not in arrays]
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    out = df.select(*keep, F.inline(zipped))
    return out.toDF(*keep, *(names or arrays))
