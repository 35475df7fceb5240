"""Cohort statistics and completeness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import ratio
from sweepframe.operators.keyed import attach
from sweepframe.operators.ranks import at_ranks, order_key
from sweepframe.session import write_table


def std_error(x: str) -> Column:
    """Standard error of the mean; NULL for a single value."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def average_sweeps(
    samples: DataFrame,
    by: Sequence[str] = ("id", "channel", "Pip", "cond", "sample_idx"),
    values: Sequence[str] = ("i", "v_corr", "ek"),
    t: str = "t",
) -> DataFrame:
    """Mean curve of repeated sweeps, grouped on the sample number, not on time."""
    return samples.groupBy(*by).agg(
        F.min(t).alias(t), *[F.avg(c).alias(c) for c in values]
    )


def mean_se(
    df: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    means: Sequence[str] = (),
) -> DataFrame:
    """Mean, mean -/+ standard error and counts; ``means`` get the mean only.

    NULLs are left out of the statistics and counted in ``<value>_null``.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    for x in values:
        aggregates += [
            F.avg(x).alias(f"{x}_avg"),
            (F.avg(x) - std_error(x)).alias(f"{x}_lo"),
            (F.avg(x) + std_error(x)).alias(f"{x}_hi"),
            F.count_if(F.col(x).isNull()).alias(f"{x}_null"),
        ]
    aggregates += [F.avg(x).alias(x) for x in means]
    return df.groupBy(*by).agg(*aggregates)


def inside_limits(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Rows inside axis limits (both ends included), before any summary."""
    return df.filter(F.col(column).between(lo, hi))


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> tuple[DataFrame, DataFrame]:
    """Exact interpolated quantiles, and the written values they came from.

    The two order statistics around each quantile are found by counting (see ``ranks``):
    values are neither sorted nor shuffled.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    rows = write_table(known.select(*by, value, order_key(df, value).alias("_bits")), "values").df

    def places(n: Column) -> dict[str, Column]:
        return {name: F.lit(p) * (n - 1) for name, p in probs.items()}

    def ranks(n: Column) -> Column:
        both = [f(h) for h in places(n).values() for f in (F.floor, F.ceil)]
        return F.array_distinct(F.array(*both))

    def at(rank: Column) -> Column:
        return F.max(F.when(F.array_contains("_ranks", rank), F.col(value)))

    picks, columns = [], []
    for name, h in places(F.col("n")).items():
        picks += [at(F.floor(h)).alias(f"_{name}_0"), at(F.ceil(h)).alias(f"_{name}_1")]
        low, high = F.col(f"_{name}_0"), F.col(f"_{name}_1")
        columns.append((low + (h - F.floor(h)) * (high - low)).alias(name))
    found = at_ranks(rows, by, value, ranks).groupBy(*by).agg(F.min("n").alias("n"), *picks)
    return found.select(*by, "n", *columns), rows.drop("_bits")


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and outlier count."""
    quart, rows = quantiles(
        df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach(rows, quart, by)
        .groupBy(*by, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
            F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def pick(value: str, key: str, level: object) -> Column:
    """Aggregate: the value in the row whose key has the given level."""
    return F.max(F.when(F.col(key) == F.lit(level), F.col(value)))


def pick_ratio(num: str, den: str, key: str, level: object) -> Column:
    return ratio(pick(num, key, level), pick(den, key, level))


def reversal_shift(
    rev: DataFrame, by: Sequence[str], key: str, first: object, last: object,
    value: str = "e_rev",
) -> DataFrame:
    """Value at two levels of a key, and their difference."""
    return rev.groupBy(*by).agg(
        pick(value, key, first).alias(f"{value}_inst"),
        pick(value, key, last).alias(f"{value}_steady"),
        (pick(value, key, first) - pick(value, key, last)).alias(f"{value}_shift"),
    )


def counts_of_ids(df: DataFrame, by: Sequence[str], id_column: str = "id") -> DataFrame:
    """Number of distinct ids per group."""
    return df.groupBy(*by).agg(F.count_distinct(id_column).alias("n"))


def id_listing(
    df: DataFrame, by: Sequence[str], id_column: str = "id", order: Sequence[str] = ()
) -> DataFrame:
    """Distinct ids with their groups, sorted."""
    listing = df.select(*by, id_column).distinct()
    return listing.orderBy(*(order or [*by, id_column]))


def coverage(sources: dict[str, DataFrame], id_column: str = "id") -> DataFrame:
    """Which sources know each id: TRUE, or NULL where the id is missing."""
    tagged = None
    for name, df in sources.items():
        flags = [
            (F.lit(True) if n == name else F.lit(None).cast("boolean")).alias(n)
            for n in sources
        ]
        part = df.select(F.col(id_column).cast("string").alias("id"), *flags)
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("id").agg(*[F.bool_or(n).alias(n) for n in sources])
