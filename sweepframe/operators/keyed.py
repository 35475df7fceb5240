"""Group-wise building blocks that stay balanced when one group is huge.

A plain window over a group puts the whole group into one task. The helpers
here give the same answers with groups of any size:

* ``matched``     joins on keys, NULL included;
* ``attach``      brings one row per group back to the rows of the group;
* ``positions``   numbers rows (or accumulates weights) inside a group;
* ``with_blocks`` cuts a sweep into blocks of neighbouring samples plus the
  few samples around them that a sliding operator needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sweepframe.session import BROADCAST_ROWS, GROUP_ROWS, limit, write_table

#: Samples per block of a cut sweep.
BLOCK = 16_384


def matched(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Equi-join that also matches NULL keys with each other.

    Grouping treats NULL as a value (a file name without its third token, say),
    so joining a group's result back must do the same.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    )
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def attach(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a table with one row per key to many rows.

    The per-key table is written and counted first. Up to the broadcast limit
    the rows are not shuffled at all. Beyond it both sides are shuffled on the keys,
    so that adaptive execution can split the partition of a heavy key.
    """
    spark = rows.sparkSession
    keys = list(keys)
    table = write_table(per_key, "per-key")
    if table.rows <= limit(spark, BROADCAST_ROWS):
        joined = matched(rows, F.broadcast(table.df), keys, how)
    else:
        joined = matched(rows, table.df.hint("merge"), keys, how)
    added = [c for c in per_key.columns if c not in keys]
    return joined.select(*rows.columns, *added)


def attach_aggregates(
    rows: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]
) -> DataFrame:
    """Give every row the aggregates of its own group."""
    stats = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return attach(rows, stats, keys)


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "sample_idx",
    weight: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, or the weight before it.

    ``order`` must be unique inside a group. When every group is known to be
    small enough, this is one window. Otherwise the rows are range-partitioned
    on keys and order, which cuts big groups into even pieces, numbered piece
    by piece, and each piece is shifted by what came before it.
    """
    spark = df.sparkSession
    keys, order = list(keys), list(order)
    step = F.lit(1) if weight is None else F.col(weight)
    step = step.cast("long")
    before = F.coalesce(
        F.sum(step).over(
            W.partitionBy(*keys)
            .orderBy(*order)
            .rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0).cast("long"),
    )
    if weight is None:
        before = (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast(
            "long"
        )
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit(spark, GROUP_ROWS):
        return df.withColumn(name, before)

    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = write_table(
        df.repartitionByRange(pieces, *keys, *order).withColumn(
            "_piece", F.spark_partition_id()
        ),
        "pieces",
    ).df
    # at most one row per piece can be a continuation, so ``carry`` is no
    # larger than the number of shuffle partitions
    carry = (
        cut.groupBy(*keys, "_piece")
        .agg(F.sum(step).alias("_here"))
        .withColumn(
            "_carry",
            F.sum("_here").over(
                W.partitionBy(*keys)
                .orderBy("_piece")
                .rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .filter(F.col("_carry") > 0)
        .drop("_here")
    )
    inside = W.partitionBy("_piece", *keys).orderBy(*order)
    local = F.coalesce(
        F.sum(step).over(inside.rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0).cast("long"),
    )
    return (
        matched(cut.withColumn(name, local), F.broadcast(carry), [*keys, "_piece"])
        .withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0).cast("long")))
        .select(*df.columns, name)
    )


def with_blocks(
    df: DataFrame,
    before: int,
    after: int,
    idx: str = "sample_idx",
    size: int = BLOCK,
) -> DataFrame:
    """Assign samples to blocks ``_block`` of ``size`` consecutive positions.

    Each block also receives the ``before`` samples in front of it and the
    ``after`` samples behind it, marked ``_own = false``. Only samples near a
    block edge are copied.
    """
    pos = F.col(idx)
    first = F.greatest(pos - F.lit(after), F.lit(0)).cast("long")
    blocks = F.sequence(
        F.floor(first / F.lit(size)), F.floor((pos + F.lit(before)) / F.lit(size))
    )
    return df.withColumn("_block", F.explode(blocks)).withColumn(
        "_own", F.col("_block") == F.floor(pos / F.lit(size))
    )


def collect_blocks(
    pieces: DataFrame, keys: Sequence[str], arrays: dict[str, Column], **per_key: Column
) -> DataFrame:
    """One row per block with its samples in arrays, for work in Python.

    The arrays are aligned with each other but in no particular order; NULL in one is
    NULL in all and left out. Arrays of numbers cross to Python far cheaper than rows. That
    work is heavy per byte, so the number of partitions is fixed: adaptive
    execution would merge small inputs by size into a few tasks.
    """
    spread = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = [*keys, "_block"]
    return (
        pieces.repartition(spread, *block)
        .groupBy(*block)
        .agg(
            *[F.collect_list(c).alias(n) for n, c in arrays.items()],
            *[c.alias(n) for n, c in per_key.items()],
        )
    )


def split_lists(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists of an Arrow column as numpy arrays."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def or_nan(c: Column | str) -> Column:
    """NULL as NaN, so that collected arrays stay aligned."""
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(column.cast("double"), F.lit(float("nan")))
