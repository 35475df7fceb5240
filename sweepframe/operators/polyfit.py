"""Quadratic I-V fits around the zero of the current, and their roots.

Least squares needs only the power sums of a group, so a fit is one
partially aggregated ``groupBy`` whatever the size of the group. The voltage
is centred on the critical voltage to keep the sums well conditioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import ratio
from sweepframe.functions.student import t_p_value
from sweepframe.operators.keyed import attach
from sweepframe.session import write_table


def critical_voltage(
    df: DataFrame, keys: Sequence[str], v: str = "v", i: str = "i"
) -> DataFrame:
    """Voltage with the smallest absolute current; ties go to the smallest voltage.

    Three small steps with plain numeric buffers, which Spark hash-aggregates:
    the smallest current per voltage, the smallest voltage per such current,
    and the voltage of the smallest current.
    """
    usable = df.filter(F.col(i).isNotNull() & F.col(v).isNotNull())
    per_voltage = usable.groupBy(*keys, v).agg(F.min(F.abs(F.col(i))).alias("_low"))
    untied = per_voltage.groupBy(*keys, "_low").agg(F.min(v).alias("_v"))
    return untied.groupBy(*keys).agg(F.min_by("_v", "_low").alias("v_crit"))


def near_critical(
    df: DataFrame, keys: Sequence[str], v: str = "v", i: str = "i",
    half_width: float = 30.0,
) -> DataFrame:
    """Rows less than ``half_width`` from their group's critical voltage."""
    return attach(df, critical_voltage(df, keys, v, i), keys).filter(
        F.abs(F.col(v) - F.col("v_crit")) < half_width
    )


def per_voltage(df: DataFrame, keys: Sequence[str], v: str = "v", i: str = "i") -> DataFrame:
    """Number, sum, sum of squares and smallest size of the currents at each voltage."""
    y = F.col(i)
    return (
        df.filter(y.isNotNull() & F.col(v).isNotNull())
        .groupBy(*keys, F.col(v).alias("v"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(y).alias("sy"),
            F.sum(y * y).alias("syy"),
            F.min(F.abs(y)).alias("low"),
        )
    )


def quadratic_fit(
    df: DataFrame, keys: Sequence[str], v: str = "v", i: str = "i",
    half_width: float = 30.0,
) -> DataFrame:
    """Least-squares parabola per group, from one scan of the data. Runs jobs.

    The scan sums the currents at each voltage; the critical voltage, the range around
    it and the power sums come from that table.

    ``c0..c2`` belong to the centred voltage ``v - v_crit``, ``b0..b2`` to the
    voltage itself. NULL where fewer than three distinct voltages remain.
    """
    steps = write_table(per_voltage(df, keys, v, i), "per-voltage").df
    x, m, y = F.col("v") - F.col("v_crit"), F.col("n"), F.col("sy")
    rows = near_critical(steps, keys, "v", "low", half_width)
    sums = rows.groupBy(*keys).agg(
        F.min("v_crit").alias("v_crit"),
        F.sum(m).alias("n"),
        F.sum(m * x).alias("sx1"),
        F.sum(m * x * x).alias("sx2"),
        F.sum(m * x * x * x).alias("sx3"),
        F.sum(m * x * x * x * x).alias("sx4"),
        F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"),
        F.sum(x * x * y).alias("sx2y"),
        F.sum("syy").alias("syy"),
    )
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "sx1", "sx2", "sx3", "sx4"))
    with_cofactors = sums.withColumns(
        {
            "k00": s2 * s4 - s3 * s3,
            "k01": s2 * s3 - s1 * s4,
            "k02": s1 * s3 - s2 * s2,
            "k11": n * s4 - s2 * s2,
            "k12": s1 * s2 - n * s3,
            "k22": n * s2 - s1 * s1,
        }
    ).withColumn(
        "raw_det", n * F.col("k00") + s1 * F.col("k01") + s2 * F.col("k02")
    )
    # relative to the product of the diagonal, rounding noise counts as zero
    singular = F.abs(F.col("raw_det")) <= F.lit(1e-12) * n * s2 * s4
    solved = with_cofactors.withColumn(
        "det", F.when(~singular, F.col("raw_det"))
    ).withColumns(
        {
            "c0": _solve(("k00", "k01", "k02")),
            "c1": _solve(("k01", "k11", "k12")),
            "c2": _solve(("k02", "k12", "k22")),
        }
    )
    c0, c1, c2, vc = (F.col(c) for c in ("c0", "c1", "c2", "v_crit"))
    named = solved.withColumns(
        {
            "b0": c0 - c1 * vc + c2 * vc * vc,
            "b1": c1 - 2 * c2 * vc,
            "b2": c2,
            "sse": F.greatest(
                F.col("syy") - c0 * F.col("sy") - c1 * F.col("sxy") - c2 * F.col("sx2y"),
                F.when(c0.isNotNull(), F.lit(0.0)),
            ),
        }
    ).drop("raw_det")
    # one short row per group, used by several later tables: solve it once
    return write_table(named, "quadratic").df


def _solve(row: tuple[str, str, str]) -> Column:
    terms = zip(row, ("sy", "sxy", "sx2y"), strict=True)
    total = sum((F.col(k) * F.col(s) for k, s in terms), F.lit(0.0))
    return total / F.col("det")


def fit_quality(fit: DataFrame) -> DataFrame:
    """Summary statistics of each parabola, from the power sums alone."""
    n, sse = F.col("n"), F.when(F.col("c0").isNotNull(), F.col("sse"))
    dof = n - 3
    sst = F.col("syy") - F.col("sy") * F.col("sy") / n
    return (
        fit.withColumns(
            {
                "r_squared": 1 - ratio(sse, sst),
                "sigma": F.sqrt(ratio(sse, F.greatest(dof, F.lit(0)))),
                "statistic": ratio(
                    (sst - sse) / 2, ratio(sse, F.greatest(dof, F.lit(0)))
                ),
                "log_lik": -n / 2 * (math.log(2 * math.pi) + F.ln(sse / n) + 1),
                "deviance": sse,
                "df_residual": dof,
            }
        )
        .withColumns(
            {
                "adj_r_squared": 1
                - (1 - F.col("r_squared")) * ratio(n - 1, F.greatest(dof, F.lit(0))),
                # upper tail of F with two numerator degrees of freedom
                "p_value": F.when(
                    dof > 0, F.pow(1 + 2 * ratio(F.col("statistic"), dof), -dof / 2)
                ),
                "aic": -2 * F.col("log_lik") + 2 * 4,
                "bic": -2 * F.col("log_lik") + 4 * F.ln(n),
            }
        )
    )


def fit_terms(fit: DataFrame, keys: Sequence[str], p_values: bool = True) -> DataFrame:
    """One row per coefficient of the uncentred parabola, with its error.

    Variances are those of the centred fit carried through the shift of origin.
    """
    vc, dof = F.col("v_crit"), F.col("n") - 3
    var = ratio("sse", F.greatest(dof, F.lit(0)))
    k = {
        name: F.col(name) / F.col("det")
        for name in ("k00", "k01", "k02", "k11", "k12", "k22")
    }
    v0 = (
        k["k00"]
        + vc**2 * k["k11"]
        + vc**4 * k["k22"]
        - 2 * vc * k["k01"]
        + 2 * vc**2 * k["k02"]
        - 2 * vc**3 * k["k12"]
    )
    v1 = k["k11"] - 4 * vc * k["k12"] + 4 * vc**2 * k["k22"]
    rows = [
        F.struct(
            F.lit(term).alias("term"),
            F.col(b).alias("estimate"),
            F.sqrt(F.greatest(var * v, F.lit(0.0) * var)).alias("std_error"),
        )
        for term, b, v in (
            ("(Intercept)", "b0", v0), ("v", "b1", v1), ("v^2", "b2", k["k22"])
        )
    ]
    terms = fit.select(
        *keys, dof.cast("double").alias("df_residual"), F.inline(F.array(*rows))
    ).withColumn("statistic", ratio("estimate", "std_error"))
    if p_values:
        terms = terms.withColumn("p_value", t_p_value("statistic", "df_residual"))
    return terms


def reversal(fit: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Zero of each parabola next to the critical voltage.

    A pair of complex roots is represented by its real part and flagged. A
    result further than ``tolerance`` from the critical voltage is ``bad``.
    """
    c0, c1, c2 = F.col("c0"), F.col("c1"), F.col("c2")
    disc = c1 * c1 - 4 * c2 * c0
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    # the root next to zero without subtracting nearly equal numbers
    sign = F.when(c1 < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    small = ratio(-2 * c0, c1 + sign * root)
    large = ratio(-c1 - sign * root, 2 * c2)
    real = F.when(F.abs(small) < F.abs(large), small).when(
        F.abs(large) < F.abs(small), large
    ).otherwise(F.coalesce(F.least(small, large), small, large))
    nearest = F.when(disc < 0, ratio(-c1, 2 * c2)).otherwise(real)
    return (
        fit.withColumn("e_test", F.when(c2 == 0, ratio(-c0, c1)).otherwise(nearest))
        .withColumns(
            {
                "e_rev": F.col("v_crit") + F.col("e_test"),
                "bad": F.abs(F.col("e_test")) > tolerance,
                "complex_root": (c2 != 0) & (disc < 0),
            }
        )
    )


def predict(fit: DataFrame, grid: Column, keys: Sequence[str], v: str = "v") -> DataFrame:
    """Fitted current on a voltage grid: a fixed number of rows per fit."""
    return fit.select(*keys, "b0", "b1", "b2", F.explode(grid).alias(v)).select(
        *keys,
        v,
        (F.col("b0") + F.col("b1") * F.col(v) + F.col("b2") * F.col(v) * F.col(v)).alias(
            "fitted"
        ),
    )


def dubious(rev: DataFrame) -> DataFrame:
    """Fits whose zero is too far from the data."""
    return rev.filter("bad")
