"""First crossing of a threshold: the half-time of a relaxation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepframe.operators.annotate import SWEEP_KEYS
from sweepframe.operators.keyed import (
    BLOCK,
    collect_blocks,
    matched,
    or_nan,
    split_lists,
    with_blocks,
)
from sweepframe.operators.smooth import projection, smooth_part


def crossings(
    samples: DataFrame,
    value: str,
    threshold: str,
    keys: Sequence[str] = SWEEP_KEYS,
    idx: str = "sample_idx",
    block: int = BLOCK,
) -> DataFrame:
    """Samples after which the trace changes its side of the threshold.

    The reported sample is the last one before the change; a sample exactly on
    the threshold has a side of its own (zero). Sweeps never influence each
    other. Each block sees one sample of the next block.
    """
    side = F.signum(F.col(value) - F.col(threshold))
    pieces = with_blocks(samples.withColumn("_side", side), 0, 1, idx, block)
    following = F.lead("_side").over(W.partitionBy(*keys, "_block").orderBy(idx))
    return (
        pieces.withColumn("turn", following - F.col("_side"))
        .filter(F.col("_own") & (F.col("turn") != 0))
        .drop("_side", "_block", "_own")
    )


def first_crossing(
    samples: DataFrame,
    value: str,
    threshold: str,
    keys: Sequence[str] = SWEEP_KEYS,
    t: str = "t_fit",
    idx: str = "sample_idx",
    name: str = "t_half",
    block: int = BLOCK,
) -> DataFrame:
    """Earliest crossing per sweep; sweeps that never cross have no row."""
    slim = samples.select(*dict.fromkeys([*keys, idx, t, value, threshold]))
    return (
        crossings(slim, value, threshold, keys, idx, block)
        .groupBy(*keys)
        .agg(F.min(t).alias(name))
    )


def smoothed_half_time(
    samples: DataFrame,
    levels: DataFrame,
    threshold: str,
    keys: Sequence[str] = SWEEP_KEYS,
    value: str = "i",
    t: str = "t_fit",
    idx: str = "sample_idx",
    order: int = 3,
    length: int = 101,
    name: str = "t_half",
    block: int = BLOCK,
    last: str | None = None,
) -> DataFrame:
    """``first_crossing`` of the smoothed trace in a single shuffle of the samples.

    ``levels`` has one row per key with its threshold and, if ``last`` names the
    column, the number of the key's last sample (else one more scan finds it). A copy
    of that row goes to every block of the key together with the block's samples, so
    nothing is joined. Each block is smoothed and searched in one go and returns one
    number.
    """
    proj = projection(order, length)
    size = max(block, length)

    @F.arrow_udf(T.DoubleType())
    def search_blocks(
        places: pa.Array, values: pa.Array, times: pa.Array, levels: pa.Array, numbers: pa.Array
    ) -> pa.Array:
        level = levels.to_numpy(zero_copy_only=False).astype(float)
        number = numbers.to_numpy(zero_copy_only=False)
        columns = (split_lists(c) for c in (places, values, times))
        first = []
        for k, (place, y, when) in enumerate(zip(*columns, strict=True)):
            if len(place) == 0:
                first.append(None)
                continue
            order_of = np.argsort(place, kind="stable")
            side = np.sign(smooth_part(y[order_of], proj) - level[k])
            step = np.diff(side)
            own = place[order_of][:-1] // size == number[k]
            hits = when[order_of][:-1][np.isfinite(step) & (step != 0) & own]
            first.append(float(hits.min()) if len(hits) else None)
        return pa.array(first, pa.float64())

    slim = samples.select(*dict.fromkeys([*keys, idx, t, value]))
    if last is None:
        ends = samples.groupBy(*keys).agg(F.max(idx).alias("_last"))
        levels, last = matched(levels, ends, keys), "_last"
    nothing = {"_place": "long", "_y": "double", "_when": "double"}
    pieces = with_blocks(slim, length - 1, length, idx, size).select(
        *keys, "_block", F.col(idx).cast("long").alias("_place"), or_nan(value).alias("_y"),
        or_nan(t).alias("_when"), F.lit(None).cast("double").alias("_level"),
    )
    final = F.floor((F.col(last) + F.lit(length - 1)) / F.lit(size))
    marks = levels.select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), final)).alias("_block"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()],
        F.col(threshold).cast("double").alias("_level"),
    )
    blocks = collect_blocks(
        pieces.unionByName(marks), keys, {c: F.col(c) for c in nothing}, _level=F.max("_level")
    )
    found = blocks.select(
        *keys, search_blocks("_place", "_y", "_when", "_level", "_block").alias(name)
    )
    return found.filter(F.col(name).isNotNull()).groupBy(*keys).agg(F.min(name).alias(name))
