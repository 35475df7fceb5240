"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constant (J/mol/K), temperature (K), Faraday constant (C/mol).
GAS_CONSTANT = 8.314
TEMPERATURE = 293
FARADAY = 96485


def _col(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Quotient that is NULL, not an error, when the divisor is zero."""
    return _col(num) / F.nullif(_col(den).cast("double"), F.lit(0.0))


def nernst(
    cin: Column | str | float,
    cout: Column | str | float,
    temp_k: float = TEMPERATURE,
    z: int = 1,
) -> Column:
    """Equilibrium potential in mV; NULL for concentrations that are not positive."""
    slope = GAS_CONSTANT * temp_k / (FARADAY * z) * 1000
    return F.lit(slope) * F.ln(ratio(cout, cin))


def tau(log_rate: Column | str) -> Column:
    """Time constant of a log rate constant."""
    return F.exp(-_col(log_rate))


def one_exp(t, amp, log_rate, const) -> Column:
    """One relaxing component on top of a constant."""
    return _col(amp) * F.exp(-F.exp(_col(log_rate)) * _col(t)) + _col(const)


def two_exp(t, a1, lrc1, a2, lrc2, const) -> Column:
    """Sum of two relaxing components and a constant."""
    return _col(a1) * F.exp(-F.exp(_col(lrc1)) * _col(t)) + one_exp(
        t, a2, lrc2, const
    )


def half_even(x: Column | str) -> Column:
    """Nearest whole number, ties to the even one."""
    return F.rint(_col(x))


def before_dot(x: Column | str) -> Column:
    """Text in front of the first dot."""
    return F.substring_index(_col(x), ".", 1)


def tokens(x: Column | str, sep: str = "[ ]") -> Column:
    """Pieces of a text between matches of the pattern ``sep``."""
    return F.split(_col(x), sep)


def first_number(x: Column | str) -> Column:
    """First whole number written in a text, NULL when there is none."""
    return F.regexp_extract(_col(x), r"(\d+)", 1).try_cast("int")


def drop_tail(x: Column | str, n: int) -> Column:
    """Text without its last ``n`` characters."""
    c = _col(x)
    return F.left(c, F.greatest(F.length(c) - F.lit(n), F.lit(0)))


def underscored(x: Column | str, prefix: str = "") -> Column:
    """Identifier made from a name: prefix, then blanks replaced by underscores."""
    return F.concat(F.lit(prefix), F.replace(_col(x), F.lit(" "), F.lit("_")))


def step_grid(start: int, stop: int, scale: float = 1.0) -> Column:
    """Array ``start*scale .. stop*scale``; whole-number steps avoid drift."""
    return F.transform(
        F.sequence(F.lit(start), F.lit(stop)), lambda k: k * F.lit(float(scale))
    )


def speed_label(rank: Column) -> Column:
    return F.when(rank == 1, "fast").when(rank == 2, "slow")
