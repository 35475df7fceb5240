"""Savitzky-Golay smoothing of sweeps of any length."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import comb
from operator import add, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepframe.operators.annotate import SWEEP_KEYS
from sweepframe.operators.keyed import BLOCK, collect_blocks, or_nan, split_lists, with_blocks

#: Windows up to this length are products with a matrix of its square, faster up to there.
WIDE = 2001


def projection(order: int, length: int) -> np.ndarray:
    """Matrix that replaces ``length`` samples by their polynomial fit.

    Its middle row smooths interior samples; the other rows serve the two ends
    of a sweep.
    """
    half = length // 2
    u = np.arange(-half, half + 1) / half
    basis, _ = np.linalg.qr(np.vander(u, order + 1, increasing=True))
    return basis @ basis.T


def smooth_part(y: np.ndarray, proj: np.ndarray) -> np.ndarray:
    """Smooth consecutive samples, fitting the ends to their outermost window."""
    length = proj.shape[0]
    half = length // 2
    if len(y) < length:
        return np.full(len(y), np.nan)
    out = np.empty(len(y))
    out[half : len(y) - half] = np.convolve(y, proj[half], mode="valid")
    out[:half] = (proj @ y[:length])[:half]
    out[len(y) - half :] = (proj @ y[-length:])[half + 1 :]
    return out


def savgol(
    samples: DataFrame,
    order: int = 3,
    length: int = 101,
    keys: Sequence[str] = SWEEP_KEYS,
    value: str = "i",
    idx: str = "sample_idx",
    name: str = "i_smooth",
    block: int = BLOCK,
) -> DataFrame:
    """Add the smoothed value of each sample; NULL in sweeps shorter than the window, and
    where the window has a value that is missing or not finite.

    ``idx`` must run without gaps inside a sweep. Sweeps are smoothed block by
    block: a block brings along ``length - 1`` neighbours on either side, enough
    for its own interior and, next to an end, for the outermost window.
    Windows of more than ``WIDE`` samples are left to :func:`savgol_sums`.
    """
    if length % 2 == 0 or order >= length:
        raise ValueError("length must be odd and larger than order")
    if length > WIDE:
        return savgol_sums(samples, order, length, keys, value, idx, name, block)
    proj = projection(order, length)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def smooth_blocks(positions: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        pairs = zip(split_lists(positions), split_lists(values), strict=True)
        for place, y in pairs:
            order_of = np.argsort(place, kind="stable")
            smoothed = np.empty(len(y))
            smoothed[order_of] = smooth_part(y[order_of], proj)
            out.append(smoothed)
        return pa.ListArray.from_arrays(
            np.cumsum([0, *map(len, out)], dtype=np.int32),
            np.concatenate(out) if out else np.empty(0),
        )

    halo = length - 1
    inner = [F.col(c) for c in samples.columns if c not in keys]
    blocks = collect_blocks(
        with_blocks(samples, halo, halo, idx, max(block, length)),
        keys,
        {
            "_place": F.col(idx),
            "_y": or_nan(value),
            "_sample": F.struct(*inner, F.col("_own")),
        },
    ).withColumn("_s", smooth_blocks("_place", "_y"))
    rows = blocks.select(*keys, F.inline(F.arrays_zip("_sample", "_s"))).filter("_sample._own")
    return rows.select(
        *[F.col(c) if c in keys else F.col("_sample")[c].alias(c) for c in samples.columns],
        F.when(F.abs("_s") < float("inf"), F.col("_s")).alias(name),
    )


def _shifted(sums: Sequence[Column], scale: float | Column, offset: float | Column) -> list[Column]:
    """Sums of ``y * (scale * w + offset)**k`` from sums of ``y * w**m``."""
    return [
        reduce(add, [F.lit(float(comb(k, m))) * scale**m * _power(offset, k - m) * sums[m] for m in range(k + 1)])
        for k in range(len(sums))
    ]


def _power(x: float | Column, n: int) -> Column:
    return reduce(mul, [x] * n, F.lit(1.0))


def savgol_sums(
    samples: DataFrame,
    order: int = 3,
    length: int = 101,
    keys: Sequence[str] = SWEEP_KEYS,
    value: str = "i",
    idx: str = "sample_idx",
    name: str = "i_smooth",
    block: int = BLOCK,
) -> DataFrame:
    """What :func:`savgol` does at a cost that does not depend on the window, without Python.

    A block is cut into strips as long as the window, with running sums of the values times
    powers of the position in the strip. A window covers the end of a strip and the beginning
    of the next, so its sums are those of two samples, whatever its length, and the fit
    is a fixed matrix away. Sums never reach beyond a strip, so no digits are lost on the way.
    """
    if length % 2 == 0 or order >= length:
        raise ValueError("length must be odd and larger than order")
    half, halo = length // 2, length - 1
    unit, powers = float(max(half, 1)), range(order + 1)
    basis = np.vander(np.arange(-half, half + 1) / unit, order + 1, increasing=True)
    solve = np.linalg.inv(basis.T @ basis)

    place = F.col(idx).cast("long")
    pieces = with_blocks(samples, halo, halo, idx, max(block, length))
    spread = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    y = F.col(value).cast("double")
    usable = F.coalesce(F.abs(y) < float("inf"), F.lit(False))
    rows = pieces.repartition(spread, *keys, "_block").select(
        *samples.columns, "_block", "_own",
        F.floor(place / length).alias("_strip"),
        (F.pmod(place, F.lit(length)) / length).alias("_w"),
        F.when(usable, y).otherwise(0.0).alias("_y"),
        F.when(usable, 0).otherwise(1).alias("_bad"),
    )

    strip = W.partitionBy(*keys, "_block", "_strip").orderBy(idx)
    so_far = strip.rowsBetween(W.unboundedPreceding, W.currentRow)
    in_all = strip.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    terms = {f"{m}": F.col("_y") * _power(F.col("_w"), m) for m in powers} | {"b": F.col("_bad")}
    summed = rows.select(
        "*",
        *[F.sum(x).over(so_far).alias(f"_s{m}") for m, x in terms.items()],
        *[F.sum(x).over(in_all).alias(f"_t{m}") for m, x in terms.items()],
    )
    # what is left of the strip from a sample on
    left = {m: F.col(f"_t{m}") - F.col(f"_s{m}") + x for m, x in terms.items()}
    around = W.partitionBy(*keys, "_block").orderBy("_strip", idx)
    ends = summed.select("*", *[x.alias(f"_l{m}") for m, x in left.items()]).select(
        *samples.columns, "_block", "_own", "_strip",
        *[F.lead(f"_s{m}", half).over(around).alias(f"_s{m}") for m in terms],
        *[F.lag(f"_l{m}", half).over(around).alias(f"_l{m}") for m in terms],
    )

    # sums around the first sample of the strip that the window ends in
    origin = F.floor((place + half) / length) * length
    two = origin > place - half
    before = _shifted([F.col(f"_l{m}") for m in powers], 1.0, -1.0)
    window = [F.col(f"_s{m}") + F.when(two, before[m]).otherwise(0.0) for m in powers]
    bad = F.col("_sb") + F.when(two, F.col("_lb")).otherwise(0)
    whole = F.col("_sb").isNotNull() & F.col("_lb").isNotNull()
    moments = ends.select(
        "*", whole.alias("_whole"), bad.alias("_bad"),
        *[x.alias(f"_m{m}") for m, x in enumerate(window)], ((origin - place) / unit).alias("_off"),
    )
    centred = _shifted([F.col(f"_m{m}") for m in powers], length / unit, F.col("_off"))
    fits = moments.select("*", *[x.alias(f"_c{m}") for m, x in enumerate(centred)]).select(
        *samples.columns, "_block", "_own", "_strip", "_whole", "_lb",
        F.when(
            F.col("_whole"),
            F.struct(
                place.alias("at"),
                *[
                    F.when(F.col("_bad") == 0, reduce(add, [F.lit(float(solve[k, m])) * F.col(f"_c{m}") for m in powers]))
                    .alias(f"a{k}")
                    for k in powers
                ],
            ),
        ).alias("_fit"),
    )
    outer = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = fits.select(
        *samples.columns, "_own",
        F.when(F.col("_whole"), F.col("_fit"))
        .when(F.col("_lb").isNull(), F.first("_fit", ignorenulls=True).over(outer))
        .otherwise(F.last("_fit", ignorenulls=True).over(outer))
        .alias("_fit"),
    ).filter("_own")
    u = (place - F.col("_fit.at")) / unit
    smoothed = reduce(add, [F.col(f"_fit.a{k}") * _power(u, k) for k in powers])
    return near.select(*samples.columns, smoothed.alias(name))
