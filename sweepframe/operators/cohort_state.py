"""Cohort curves that are kept up to date without reading old recordings again.

A folder holds two tables that change by whole commits:

* ``parts``: per recording and curve point the number, mean and sum of squared
  deviations (M2) of its values;
* ``state``: the same per curve point over all recordings.

A batch of recordings is reduced to its parts. Those that replace a recording take its old
parts, which lie in a few buckets, back out of the state; then the new ones are merged in.
Means and deviations are combined around the state's mean, so that large values with a small
spread keep their digits. Nothing but the batch, the old parts of its recordings and the
state of the points they touch is read.

The state is committed before the parts, each with the number of the batch, so a batch that
died in between can be tried again and counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.functions.scalars import ratio
from sweepframe.operators.keyed import matched
from sweepframe.session import write_table
from sweepframe.sources import commits

POINT = "_point"
BUCKETS = 64


def _named(values: Sequence[str]) -> list[str]:
    return ["n", *(f"{x}_{s}" for x in values for s in ("n", "mean", "m2"))]


def _point(by: Sequence[str]) -> Column:
    """A curve point as one value; NULLs are values too."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


def partial(samples: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Number, mean and M2 of each value per group."""
    sums = [F.count(F.lit(1)).alias("n")]
    for x in values:
        sums += [
            F.count(x).alias(f"{x}_n"),
            F.avg(x).alias(f"{x}_mean"),
            (F.var_pop(x) * F.count(x)).alias(f"{x}_m2"),
        ]
    return samples.groupBy(*by).agg(*sums)


def _around(parts: DataFrame, by: Sequence[str], values: Sequence[str], sign: str) -> DataFrame:
    """Parts summed per point, less the centre ``<value>_c`` that they carry."""
    sums = [F.sum(F.col(sign) * F.col("n")).alias("n")]
    for x in values:
        n = F.col(sign) * F.coalesce(F.col(f"{x}_n"), F.lit(0))
        off = F.coalesce(F.col(f"{x}_mean") - F.col(f"{x}_c"), F.lit(0.0))
        m2 = F.col(sign) * F.coalesce(F.col(f"{x}_m2"), F.lit(0.0))
        sums += [
            F.sum(n).alias(f"{x}_n"),
            F.sum(n * off).alias(f"{x}_s"),
            F.sum(m2 + n * off * off).alias(f"{x}_q"),
            F.first(f"{x}_c").alias(f"{x}_c"),
        ]
    return parts.groupBy(*by).agg(*sums)


def merge(parts: DataFrame, by: Sequence[str], values: Sequence[str], sign: str) -> DataFrame:
    """One row per point from parts (``n`` and, per value, number, mean and M2), those
    with ``sign`` -1 taken out again."""
    # any mean of a point serves as its centre; the largest part's is near the result
    weight = [F.max_by(f"{x}_mean", F.struct(F.col(sign), f"{x}_n")).alias(f"{x}_c") for x in values]
    centres = parts.groupBy(*by).agg(*weight)
    centred = _around(matched(parts, centres, by), by, values, sign)
    out = [F.col("n").cast("long").alias("n")]
    for x in values:
        n, s = F.col(f"{x}_n"), F.col(f"{x}_s")
        out += [
            n.cast("long").alias(f"{x}_n"),
            (F.col(f"{x}_c") + ratio(s, n)).alias(f"{x}_mean"),
            F.greatest(F.col(f"{x}_q") - ratio(s * s, n), F.lit(0.0)).alias(f"{x}_m2"),
        ]
    return centred.select(*by, *out)


def update(
    samples: DataFrame, folder: str, recording: str, by: Sequence[str], values: Sequence[str],
    batch: tuple[str, int] | None = None, buckets: int = BUCKETS,
) -> None:
    """Add a batch of whole recordings to the cohort; those it has already are replaced.

    Runs jobs. ``batch``: name of the writer and number of the batch (see ``commits``).
    """
    spark, folder, by = samples.sparkSession, folder.rstrip("/"), list(by)
    state_path, parts_path = f"{folder}/state", f"{folder}/parts"
    new = write_table(partial(samples, [recording, *by], values), "parts").df
    state = commits.current(spark, state_path)
    if not (batch and state.batches.get(batch[0], -1) >= batch[1]):
        signed = [new.withColumn("_sign", F.lit(1))]
        if commits.is_table(spark, parts_path):
            own = commits.read_keys(new.select(recording), parts_path, recording)
            signed.append(own.select(new.columns).withColumn("_sign", F.lit(-1)))
        changes = [p.drop(recording) for p in signed]
        if state.number:
            touched = reduce(DataFrame.unionByName, changes).select(_point(by).alias(POINT)).distinct()
            kept = commits.read_keys(touched, state_path, POINT)
            changes.append(kept.select(*by, *_named(values)).withColumn("_sign", F.lit(1)))
        merged = merge(reduce(DataFrame.unionByName, changes), by, values, "_sign")
        commits.upsert(merged.withColumn(POINT, _point(by)), state_path, POINT, buckets, batch)
    commits.upsert(new, parts_path, recording, buckets, batch)


def curve(spark: SparkSession, folder: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, mean -/+ standard error and counts per point, as ``cohort.mean_se`` has them."""
    state = commits.read(spark, f"{folder.rstrip('/')}/state").where("n > 0")
    out = [F.col("n")]
    for x in values:
        n, mean = F.col(f"{x}_n"), F.col(f"{x}_mean")
        error = F.when(n > 1, F.sqrt(F.col(f"{x}_m2") / (n - 1)) / F.sqrt(n))
        out += [
            mean.alias(f"{x}_avg"),
            (mean - error).alias(f"{x}_lo"),
            (mean + error).alias(f"{x}_hi"),
            (F.col("n") - n).alias(f"{x}_null"),
        ]
    return state.select(*by, *out)
