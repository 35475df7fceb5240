"""Exact order statistics of groups of any size, without sorting their values.

A value is turned into a whole number that keeps its order: the bits of a double. The
numbers are counted by their first 16 bits; the counts tell which of these prefixes holds a
wanted rank, and only values with that prefix are counted by the next 16. A prefix whose
smallest and largest value are equal is settled, so tied or rounded values end early; four
rounds settle everything. What is shuffled is counts: for each group and wanted rank at most
65,536 a round. The values themselves stay where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepframe.operators.keyed import matched
from sweepframe.session import BROADCAST_ROWS, limit, write_table

#: Bits of a number that one round decides.
ROUND_BITS = 16
FRACTION = 2.0**52
#: Exponent of the smallest double with all its digits.
SMALLEST = -1022


def ordered_bits(x: Column) -> Column:
    """A double as a long in the same order: its bits, or their negative.

    Both zeros are 0; NaN comes last, as Spark sorts it. Built from exact products and
    quotients with powers of two, so equal numbers, and no others, give equal longs.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("double")
    # the logarithm may be off by one next to a power of two
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(size < power, -1).when(size >= power * 2, 1).otherwise(0)
    digits = (size / F.pow(F.lit(2.0), exponent) * FRACTION).cast("long")
    normal = ((exponent - SMALLEST) * FRACTION).cast("long") + digits
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    endless = F.lit(2047 << 52).cast("long")
    bits = (
        F.when(F.isnan(x), endless + 1)
        .when(size == float("inf"), endless)
        .when(size < 2.0**SMALLEST, tiny)
        .otherwise(normal)
    )
    return F.when(x < 0, -bits).otherwise(bits)


def order_key(df: DataFrame, column: str) -> Column:
    """A number column as a long in the same order."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.IntegralType):
        return x.cast("long")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return ordered_bits(x.cast("double"))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (x * F.lit(10**kind.scale)).cast("long")
    raise ValueError(f"{column} is {kind.simpleString()}: no number of up to 64 bits")


def _counted(rows: DataFrame, keys: Sequence[str], value: str, shift: int) -> DataFrame:
    return rows.groupBy(*keys, F.shiftright("_bits", shift).alias("_prefix")).agg(
        F.count(F.lit(1)).alias("_count"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )


def _holding(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prefixes that hold any of ``_ranks``, with the ranks they hold and the rows before."""
    earlier = W.partitionBy(*keys).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    end = F.col("_before") + F.col("_count")
    held = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < end))
    return placed.withColumn("_ranks", held).where(F.size("_ranks") > 0)


def at_ranks(
    rows: DataFrame, by: Sequence[str], value: str, ranks: Callable[[Column], Column]
) -> DataFrame:
    """Values of ``rows`` at some ranks (from 0) of their groups. Runs jobs.

    ``rows`` has the order of ``value`` in ``_bits`` (see :func:`order_key`) and no NULLs; it
    is read once a round, so it should be a written table. ``ranks`` makes an array of ranks
    from the number of rows. Returns the keys, ``n``, the value, and in ``_ranks`` all
    wanted ranks that have it.
    """
    spark, by = rows.sparkSession, list(by)
    out = [*by, "n", "_ranks", F.col("_low").alias(value)]
    shift = 64 - ROUND_BITS
    first = _counted(rows, by, value, shift).withColumn("n", F.sum("_count").over(W.partitionBy(*by)))
    first = first.withColumns({"_ranks": ranks(F.col("n")), "_base": F.lit(0).cast("long")})
    state = write_table(_holding(first, by), "ranks").df
    found = state.where("not _low <> _high").select(*out)
    while shift:
        within = write_table(
            state.where("_low <> _high").select(
                *by, F.col("_prefix").alias("_at"), "n", F.col("_before").alias("_base"), "_ranks"
            ),
            "open-ranks",
        )
        if not within.rows:
            break
        keys, few = [*by, "_at"], within.rows <= limit(spark, BROADCAST_ROWS)
        near = rows.withColumn("_at", F.shiftright("_bits", shift))
        wanted = within.df.select(*keys)
        near = matched(near, F.broadcast(wanted) if few else wanted, keys, "left_semi")
        shift -= ROUND_BITS
        counts = matched(_counted(near, keys, value, shift), within.df, keys, "inner")
        state = write_table(_holding(counts, keys), "ranks").df
        found = found.unionByName(state.where("not _low <> _high").select(*out))
    return found
