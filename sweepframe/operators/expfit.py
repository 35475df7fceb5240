"""Fits of A1*exp(-e^lrc1*t) + A2*exp(-e^lrc2*t) + C to relaxing traces.

For given rates the model is linear in A1, A2 and C, so a grid over the two
log rates needs nothing but sums over the samples: ``grid_fit`` is a single
partially aggregated pass. ``refine_fit`` starts from the best grid points and
iterates Levenberg-Marquardt on all five parameters. Sweeps too long for a task are
compressed first: their samples are summed against Chebyshev polynomials on a few dozen
blocks, from which the sums of any iteration follow to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sweepframe.functions.scalars import (
    first_number,
    one_exp,
    ratio,
    speed_label,
    tau,
    two_exp,
)
from sweepframe.functions.student import t_p_value, t_quantile
from sweepframe.operators.annotate import SWEEP_KEYS
from sweepframe.operators.keyed import attach, matched, split_lists
from sweepframe.session import GROUP_ROWS, limit, write_table

TERMS = ("A1", "lrc1", "A2", "lrc2", "C")
# Range of the starting log rates.
LRC1_GRID = (4.0, 4.5, 5.0, 5.5, 6.0)
LRC2_GRID = (1.5, 1.75, 2.0, 2.25, 2.5)
#: An accepted step this small (relative), or an improvement this small
#: (relative to the residual), ends the iteration.
STEP_TOLERANCE, GAIN_TOLERANCE = 1e-8, 1e-12
#: ... provided that the residual is at right angles to every slope up to this cosine.
LEVEL_TOLERANCE = 1e-3
#: Samples, once for each starting point, that a task iterates on at a time: some 20 MB with
#: all that is made from them, however many sweeps come in a batch.
SAMPLES_AT_ONCE = 128_000


# --- grid over the two log rates ------------------------------------------------


def grid_candidates(
    samples: DataFrame,
    keys: Sequence[str] = SWEEP_KEYS,
    t: str = "t_fit",
    y: str = "i_norm",
    lrc1: Sequence[float] = LRC1_GRID,
    lrc2: Sequence[float] = LRC2_GRID,
) -> DataFrame:
    """Per sweep an array with the solved fit of every grid point, best first.

    The grid lives in aggregate columns: samples are neither copied nor
    collected, and a sweep of any length is summed on the map side. A sweep
    without any value has ``n = 0`` and no candidate. The range of the times and the
    sum of squares come along.
    """
    rates = sorted({*lrc1, *lrc2})
    level = {r: F.exp(-F.lit(math.exp(r)) * F.col(t)) for r in rates}
    label = {r: f"_{k}" for k, r in enumerate(rates)}
    usable = F.col(y).isNotNull() & F.col(t).isNotNull()
    rows = samples.select(
        *keys,
        F.col(t).cast("double").alias("_t"),
        F.when(usable, F.col(y)).alias("_y"),
        *[F.when(usable, e).alias(f"_e{label[r]}") for r, e in level.items()],
    )
    usable_t = F.col("_y").isNotNull()
    e = {r: F.col(f"_e{label[r]}") for r in rates}
    wanted = [
        F.count("_y").alias("n"),
        F.min(F.when(usable_t, F.col("_t"))).alias("t_min"),
        F.max(F.when(usable_t, F.col("_t"))).alias("t_max"),
        F.sum("_y").alias("sy"),
        F.sum(F.col("_y") * F.col("_y")).alias("syy"),
    ]
    for r in rates:
        wanted += [
            F.sum(e[r]).alias(f"s{label[r]}"),
            F.sum(e[r] * e[r]).alias(f"q{label[r]}"),
            F.sum(e[r] * F.col("_y")).alias(f"p{label[r]}"),
        ]
    pairs = [(a, b) for a in lrc1 for b in lrc2 if a != b]
    crossed = sorted({(min(p), max(p)) for p in pairs})
    wanted += [
        F.sum(e[a] * e[b]).alias(f"x{label[a]}{label[b]}") for a, b in crossed
    ]
    sums = rows.groupBy(*keys).agg(*wanted)
    grid = F.array(
        *[
            F.struct(
                F.lit(a).alias("lrc1"),
                F.lit(b).alias("lrc2"),
                F.col(f"q{label[a]}").alias("m11"),
                F.col(f"x{label[min(a, b)]}{label[max(a, b)]}").alias("m12"),
                F.col(f"s{label[a]}").alias("m13"),
                F.col(f"q{label[b]}").alias("m22"),
                F.col(f"s{label[b]}").alias("m23"),
                F.col(f"p{label[a]}").alias("r1"),
                F.col(f"p{label[b]}").alias("r2"),
            )
            for a, b in pairs
        ]
    )
    stages = F.transform(F.transform(F.col("_grid"), _cofactors), _amplitudes)
    return sums.select(*keys, "n", "t_min", "t_max", "sy", "syy", grid.alias("_grid")).select(
        *keys,
        "n",
        "t_min",
        "t_max",
        "syy",
        F.array_sort(
            F.filter(F.transform(stages, _residual), lambda c: c["sse"].isNotNull())
        ).alias("candidates"),
    )


# Cramer's rule in three steps, each reading the fields of the one before, so that
# no intermediate is worked out twice.


def _cofactors(g: Column) -> Column:
    m33 = F.col("n")
    m11, m12, m13, m22, m23 = (g[c] for c in ("m11", "m12", "m13", "m22", "m23"))
    return F.struct(
        *[g[c].alias(c) for c in ("lrc1", "lrc2", "m11", "m12", "m13", "m22", "r1", "r2")],
        (m22 * m33 - m23 * m23).alias("k11"),
        (m13 * m23 - m12 * m33).alias("k12"),
        (m12 * m23 - m13 * m22).alias("k13"),
        (m11 * m33 - m13 * m13).alias("k22"),
        (m12 * m13 - m11 * m23).alias("k23"),
        (m11 * m22 - m12 * m12).alias("k33"),
    )


def _amplitudes(g: Column) -> Column:
    r1, r2, r3 = g["r1"], g["r2"], F.col("sy")
    det = g["m11"] * g["k11"] + g["m12"] * g["k12"] + g["m13"] * g["k13"]
    solvable = F.abs(det) > F.lit(1e-13) * g["m11"] * g["m22"] * F.col("n")
    safe = F.when(solvable, det)
    return F.struct(
        *[g[c].alias(c) for c in ("lrc1", "lrc2", "r1", "r2")],
        ((g["k11"] * r1 + g["k12"] * r2 + g["k13"] * r3) / safe).alias("A1"),
        ((g["k12"] * r1 + g["k22"] * r2 + g["k23"] * r3) / safe).alias("A2"),
        ((g["k13"] * r1 + g["k23"] * r2 + g["k33"] * r3) / safe).alias("C"),
    )


def _residual(g: Column) -> Column:
    left = F.col("syy") - g["A1"] * g["r1"] - g["A2"] * g["r2"] - g["C"] * F.col("sy")
    sse = F.greatest(left, F.when(g["C"].isNotNull(), F.lit(0.0)))
    # field order is sort order: residual first, then the rates as tie-break
    names = ("lrc1", "lrc2", "A1", "A2", "C")
    return F.struct(
        F.round(sse, 9).alias("sse_key"), *[g[c].alias(c) for c in names], sse.alias("sse")
    )


def grid_fit(
    samples: DataFrame,
    keys: Sequence[str] = SWEEP_KEYS,
    t: str = "t_fit",
    y: str = "i_norm",
    lrc1: Sequence[float] = LRC1_GRID,
    lrc2: Sequence[float] = LRC2_GRID,
) -> DataFrame:
    """Best grid point per sweep with its statistics; NULL if none is solvable."""
    best = F.get(F.col("candidates"), F.lit(0))
    solved = grid_candidates(samples, keys, t, y, lrc1, lrc2).select(
        *keys, "n", *[best[c].alias(c) for c in (*TERMS, "sse")]
    )
    return fit_stats(solved)


def fit_stats(fit: DataFrame, n_par: int = len(TERMS)) -> DataFrame:
    """Statistics that follow from the residual sum of squares."""
    n, sse = F.col("n"), F.col("sse")
    dof = n - n_par
    return fit.withColumns(
        {
            "sigma": F.sqrt(ratio(sse, F.greatest(dof, F.lit(0)))),
            "log_lik": -n / 2 * (math.log(2 * math.pi) + F.ln(sse / n) + 1),
            "deviance": sse,
            "df_residual": dof,
        }
    ).withColumns(
        {
            "aic": -2 * F.col("log_lik") + 2 * (n_par + 1),
            "bic": -2 * F.col("log_lik") + (n_par + 1) * F.ln(n),
        }
    )


# --- refinement ------------------------------------------------------------------

STATE = T.StructType(
    [
        T.StructField("p", T.ArrayType(T.DoubleType())),
        T.StructField("trial", T.ArrayType(T.DoubleType())),
        T.StructField("sse", T.DoubleType()),
        T.StructField("jtj", T.ArrayType(T.DoubleType())),
        T.StructField("jtr", T.ArrayType(T.DoubleType())),
        T.StructField("damping", T.DoubleType()),
        T.StructField("passes", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)
#: ... with the diagonal of the inverse of J'J, NULL where it has none.
SOLVED = T.StructType([*STATE.fields, T.StructField("unscaled", T.ArrayType(T.DoubleType()))])
_UPPER = [(a, b) for a in range(5) for b in range(a, 5)]


def normal_sums(t: np.ndarray, y: np.ndarray, p: np.ndarray):
    """Residual sum of squares, J'J and J'r at points ``p[k]``.

    ``t`` and ``y`` are one trace for all points, or one row per point.
    """
    k1, k2 = np.exp(p[:, 1:2]), np.exp(p[:, 3:4])
    jac = np.empty((len(p), 5, t.shape[-1]))
    np.exp(-k1 * t, out=jac[:, 0])
    np.exp(-k2 * t, out=jac[:, 2])
    np.multiply(jac[:, 0], (-p[:, 0:1] * k1) * t, out=jac[:, 1])
    np.multiply(jac[:, 2], (-p[:, 2:3] * k2) * t, out=jac[:, 3])
    jac[:, 4] = 1.0
    res = y - p[:, 0:1] * jac[:, 0] - p[:, 2:3] * jac[:, 2] - p[:, 4:5]
    jtj = jac @ jac.transpose(0, 2, 1)
    return (res * res).sum(axis=1), jtj, (jac @ res[:, :, None])[:, :, 0]


def fresh_state(points: np.ndarray) -> dict[str, np.ndarray]:
    """State of several independent iterations, one row each."""
    points = np.array(points, dtype=float).reshape(-1, 5)
    m = len(points)
    return {
        "p": points.copy(),
        "trial": points.copy(),
        "sse": np.full(m, np.inf),
        "jtj": np.zeros((m, 5, 5)),
        "jtr": np.zeros((m, 5)),
        "damping": np.full(m, 1e-3),
        "passes": np.zeros(m, dtype=int),
        "status": np.full(m, "running", dtype="U10"),
    }


def advance(s: dict[str, np.ndarray], k: np.ndarray, sse, jtj, jtr, max_passes: int, noise=0.0):
    """One Levenberg-Marquardt step of the running rows ``k``.

    Judges their trial points by the new sums, keeps or rejects them, and
    proposes the next trial points. ``noise``: rounding error of ``sse``, within which
    a residual is none and a gain is not measurable.
    """
    moved = s["passes"][k] > 0
    s["passes"][k] += 1
    ok = np.isfinite(sse) & np.isfinite(jtj).all(axis=(1, 2)) & (sse <= s["sse"][k] + noise)
    s["status"][k[~ok & ~moved]] = "failed"
    gain = s["sse"][k] - sse
    scale = np.abs(s["p"][k])
    # an amplitude that is none is only known to the rounding of the others
    most = scale[:, ::2].max(axis=1, keepdims=True)
    scale[:, ::2] = np.where(np.reshape(noise, (-1, 1)) > 0, most, scale[:, ::2])
    step = np.abs(s["trial"][k] - s["p"][k]) / (1e-8 + scale)
    short = step.max(axis=1) < STEP_TOLERANCE
    dry = (gain <= GAIN_TOLERANCE * sse) & (GAIN_TOLERANCE * sse >= noise)
    # no slope explains a noticeable part of the residual, or there is no residual
    size = np.einsum("kii->ki", jtj) * sse[:, None]
    none = sse <= np.maximum(1e-20 * jtj[:, 4, 4], 100 * noise)
    level = (jtr**2 <= LEVEL_TOLERANCE**2 * size).all(axis=1) | none
    good = k[ok]
    s["p"][good], s["sse"][good] = s["trial"][good], sse[ok]
    s["jtj"][good], s["jtr"][good] = jtj[ok], jtr[ok]
    s["damping"][k] = np.where(
        ok, np.maximum(s["damping"][k] / 10, 1e-12), s["damping"][k] * 10
    )
    s["status"][k[(s["damping"][k] > 1e12) | (ok & moved & short & ~level)]] = "stalled"
    s["status"][k[ok & moved & (short | dry) & level]] = "converged"
    running = k[s["status"][k] == "running"]
    s["status"][running[s["passes"][running] >= max_passes]] = "max_passes"
    running = running[s["passes"][running] < max_passes]
    if len(running):
        # unit diagonal plus damping: positive definite, so always solvable
        root = np.sqrt(np.maximum(np.einsum("kii->ki", s["jtj"][running]), 1e-12))
        scaled = s["jtj"][running] / (root[:, :, None] * root[:, None, :])
        scaled[:, range(5), range(5)] += s["damping"][running][:, None]
        delta = np.linalg.solve(scaled, (s["jtr"][running] / root)[:, :, None])[:, :, 0]
        s["trial"][running] = s["p"][running] + delta / root


def running_rows(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.flatnonzero(s["status"] == "running")


def refine_fit(
    samples: DataFrame,
    keys: Sequence[str] = SWEEP_KEYS,
    t: str = "t_fit",
    y: str = "i_norm",
    lrc1: Sequence[float] = LRC1_GRID,
    lrc2: Sequence[float] = LRC2_GRID,
    max_passes: int = 100,
) -> DataFrame:
    """Least-squares fit per sweep: the best of all solvable grid points refined.

    Sweeps up to the group limit are refined in one grouped pass, each in its
    own task slice. Longer sweeps are never gathered: one pass of sums compresses them to
    a few hundred weighted points, on which both ways take the same steps, and one more
    gives the exact sums at the end.

    Every sweep has a row. ``status`` is ``converged`` (nothing to gain, and the
    residual level), ``max_passes`` (the passes ended first), ``stalled`` (no step
    improves any more though the residual is not level) or ``failed`` (no values or no solvable grid point; ``error`` says so). Runs jobs.
    """
    keys = list(keys)
    spark = samples.sparkSession
    usable = F.col(y).isNotNull() & F.col(t).isNotNull()
    slim = samples.select(
        *keys,
        F.when(usable, F.col(t).cast("double")).alias("_t"),
        F.when(usable, F.col(y).cast("double")).alias("_y"),
    )
    # read by the grid and by the refinement: cut and normalise the traces once
    slim = write_table(slim, "fit-samples").df
    begin = write_table(
        grid_candidates(slim, keys, "_t", "_y", lrc1, lrc2).select(
            *keys,
            "n",
            "t_min",
            "t_max",
            "syy",
            F.transform("candidates", lambda c: F.array(*[c[x] for x in TERMS])).alias("starts"),
        ),
        "fit-starts",
    ).df
    small = F.col("n") <= limit(spark, GROUP_ROWS)
    longest = begin.agg(F.max("n")).first()[0] or 0
    if longest <= limit(spark, GROUP_ROWS):
        return _report(_refine_grouped(slim, begin, keys, max_passes), keys)
    states = _refine_compressed(slim, begin.filter(~small), keys, max_passes)
    short = write_table(begin.filter(small), "short-sweeps")
    if short.rows:
        kept = attach(slim, short.df.select(*keys), keys, "inner")
        states = states.unionByName(_refine_grouped(kept, short.df, keys, max_passes))
    return _report(states, keys)


def _listed(a: np.ndarray) -> list[float]:
    return [float(x) for x in np.ravel(a)]


def _row(s: dict[str, np.ndarray], k: int) -> dict:
    """One state row in the types of the state table."""
    return {
        "p": _listed(s["p"][k]), "trial": _listed(s["trial"][k]),
        "sse": float(s["sse"][k]), "jtj": _listed(s["jtj"][k]),
        "jtr": _listed(s["jtr"][k]), "damping": float(s["damping"][k]),
        "passes": int(s["passes"][k]), "status": str(s["status"][k]),
    }


def _solved_rows(rows: dict[str, np.ndarray], known: np.ndarray) -> pa.Array:
    """State rows as an Arrow array; those that are not ``known`` have no numbers."""
    fields, columns = list(to_arrow_type(SOLVED)), []
    for field in fields:
        v = rows[field.name]
        none = np.isnan(v).any(axis=1) if field.name == "unscaled" else ~known
        if field.name in ("passes", "status"):
            columns.append(pa.array(v, field.type))
        elif v.ndim == 1:
            columns.append(pa.array(v, field.type, mask=none))
        else:
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * math.prod(v.shape[1:]))
            columns.append(pa.ListArray.from_arrays(ends, pa.array(v.ravel()), field.type, mask=pa.array(none)))
    return pa.StructArray.from_arrays(columns, fields=fields)


def _refine_grouped(
    slim: DataFrame, begin: DataFrame, keys: list[str], max_passes: int
) -> DataFrame:
    """All iterations of a sweep at once, on its samples as two number arrays.

    Numbers stay in arrays from batch to batch, and a batch is worked off in slices, so a
    worker holds Spark's batch, a state row for each sweep of it, and one slice.
    """

    @F.arrow_udf(SOLVED)
    def fit(times: pa.Array, values: pa.Array, starts: pa.Array) -> pa.Array:
        ts, ys = split_lists(times), split_lists(values)
        counts = pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False)
        points = starts.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(TERMS))
        ends = np.cumsum(counts)
        out = {x: np.zeros((len(counts), *v.shape[1:]), v.dtype) for x, v in fresh_state(points[:0]).items()}
        out["status"][:], out["unscaled"] = "failed", np.full((len(counts), 5), np.nan)
        by_length: dict[int, list[int]] = {}
        for j in np.flatnonzero(counts):
            by_length.setdefault(len(ts[j]), []).append(int(j))
        for n, members in by_length.items():
            # traces of equal length advance together
            width = max(1, SAMPLES_AT_ONCE // (n * int(counts[members].max())))
            for first in range(0, len(members), width):
                chunk = members[first : first + width]
                t, y = (np.stack([x[j] for j in chunk]) for x in (ts, ys))
                owner = np.repeat(np.arange(len(chunk)), counts[chunk])
                s = fresh_state(np.concatenate([points[ends[j] - counts[j] : ends[j]] for j in chunk]))
                with np.errstate(all="ignore"):
                    while len(running := running_rows(s)):
                        slices = min(len(running), -(-len(running) * n // SAMPLES_AT_ONCE))
                        for k in np.array_split(running, slices):
                            sums = normal_sums(t[owner[k]], y[owner[k]], s["trial"][k])
                            advance(s, k, *sums, max_passes)
                quality = np.where(s["status"] == "failed", np.inf, s["sse"])
                # the first of the best points of each sweep
                best = np.lexsort((quality, owner))[np.cumsum(counts[chunk]) - counts[chunk]]
                for x, v in s.items():
                    out[x][chunk] = v[best]
                with np.errstate(all="ignore"):
                    out["unscaled"][chunk] = _inverse_diagonals(s["jtj"][best])
        return _solved_rows(out, counts > 0)

    # a fixed number of partitions: the work per byte is high, so small inputs
    # must not be merged into a few tasks
    spread = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # samples and starting points are dealt together and grouped once, so the samples
    # are shuffled once and sorted never; a sweep has one row of starting points
    columns = [*keys, "_t", "_y", "n", "starts"]
    points = begin.withColumns({"_t": F.lit(None).cast("double"), "_y": F.lit(None).cast("double")})
    rows = slim.withColumns(
        {"n": F.lit(None).cast("long"), "starts": F.lit(None).cast("array<array<double>>")}
    )
    traces = (
        rows.select(*columns)
        .unionByName(points.select(*columns))
        .repartition(spread, *keys)
        .groupBy(*keys)
        .agg(
            F.collect_list("_t").alias("_ts"),
            F.collect_list("_y").alias("_ys"),
            F.max("n").alias("n"),
            F.flatten(F.collect_list("starts")).alias("starts"),
        )
        .filter(F.col("n").isNotNull())
    )
    return traces.withColumn("_fit", fit("_ts", "_ys", "starts")).select(*keys, "n", "_fit.*")


# --- long sweeps ---------------------------------------------------------------------

#: Blocks double in length away from the first sample; the first is 2 ** -LEVELS of all.
LEVELS = 30
#: The block of samples at the very first time, which are kept as they are: a rate may be
#: so high that only they differ from the rest.
FIRST = -1
#: Chebyshev polynomials per block. On a block from a to 2a (times since the first
#: sample) exp(-k t) is exp(-1.5 k a) times a series whose m-th term is at most
#: 2 I_m(k a / 2). With 24 terms the rest is below 1e-18 of the largest value for every
#: rate k, as a block that is long for a rate lies where the exponential has died out.
TERMS_PER_BLOCK = 25
#: Rounding of sums over compressed samples, relative to their absolute values.
ROUNDING = 1e-15


def _moments(slim: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Per sweep and block: sums of the polynomials, plain (``m``) and times y (``v``)."""
    present = slim.filter(F.col("_y").isNotNull())
    rows = attach(present, ranges, keys, "inner")
    since, whole = F.col("_t") - F.col("t_min"), F.col("t_max") - F.col("t_min")
    level = F.greatest(F.lit(0), F.lit(LEVELS) + F.ceil(F.log2(since / whole)).cast("int"))
    block = F.when(since > 0, level).otherwise(FIRST)
    rows = rows.select(*keys, "_y", since.alias("_s"), whole.alias("_w"), block.alias("block"))
    high = F.when(F.col("block") == FIRST, 0.0).otherwise(F.col("_w") * F.pow(F.lit(2.0), F.col("block") - LEVELS))
    centre, half = (F.when(F.col("block") == 0, high / 2).otherwise(high * c) for c in (0.75, 0.25))
    place = F.when(high > 0, (F.col("_s") - centre) / half).otherwise(0.0)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), place)))
    rows = rows.select(*keys, "block", "_y", angle.alias("_a"))
    each = [F.cos(m * F.col("_a")) if m else F.lit(1.0) for m in range(TERMS_PER_BLOCK)]
    named = [F.sum(c).alias(f"_m{m}") for m, c in enumerate(each)]
    named += [F.sum(c * F.col("_y")).alias(f"_v{m}") for m, c in enumerate(each)]
    sums = rows.groupBy(*keys, "block").agg(*named)
    both = [F.array(*[f"_{x}{m}" for m in range(TERMS_PER_BLOCK)]).alias(x) for x in "mv"]
    return sums.select(*keys, "block", *both)


def weighted_points(block: np.ndarray, m: np.ndarray, v: np.ndarray, whole: float):
    """Times since the first sample, with weights for sums of g(t) and of y g(t).

    A sum over a block's samples is a sum over its Chebyshev nodes, exact for polynomials.
    """
    n = TERMS_PER_BLOCK
    angle = np.pi * (np.arange(n) + 0.5) / n
    to_nodes = np.cos(np.outer(angle, np.arange(n))) * (2 / n)
    to_nodes[:, 0] /= 2
    high = np.where(block == FIRST, 0.0, whole * 2.0 ** (block - LEVELS))
    centre = np.where(block == 0, high / 2, 0.75 * high)
    half = np.where(block == 0, high / 2, 0.25 * high)
    since = centre[:, None] + half[:, None] * np.cos(angle)
    return since.ravel(), (m @ to_nodes.T).ravel(), (v @ to_nodes.T).ravel()


def weighted_sums(t: np.ndarray, w: np.ndarray, v: np.ndarray, syy: float, p: np.ndarray):
    """What ``normal_sums`` gives at points ``p[k]``, from weighted points, and the
    rounding error of the residual."""
    k1, k2 = np.exp(p[:, 1:2]), np.exp(p[:, 3:4])
    jac = np.empty((len(p), 5, len(t)))
    np.exp(-k1 * t, out=jac[:, 0])
    np.exp(-k2 * t, out=jac[:, 2])
    np.multiply(jac[:, 0], (-p[:, 0:1] * k1) * t, out=jac[:, 1])
    np.multiply(jac[:, 2], (-p[:, 2:3] * k2) * t, out=jac[:, 3])
    jac[:, 4] = 1.0
    model = p[:, 0:1] * jac[:, 0] + p[:, 2:3] * jac[:, 2] + p[:, 4:5]
    jtj = (jac * w) @ jac.transpose(0, 2, 1)
    jtr = jac @ v - (jac @ (w * model)[:, :, None])[:, :, 0]
    sse = syy - 2 * model @ v + model**2 @ w
    noise = ROUNDING * (syy + 2 * np.abs(model) @ np.abs(v) + model**2 @ np.abs(w))
    return sse, jtj, jtr, noise


def _refine_compressed(
    slim: DataFrame, begin: DataFrame, keys: list[str], max_passes: int
) -> DataFrame:
    """All iterations of a sweep on its weighted points; the samples are read twice."""
    state_type = to_arrow_type(STATE)
    nothing = dict.fromkeys(STATE.names) | {"passes": 0, "status": "failed"}

    @F.arrow_udf(STATE)
    def fit(blocks: pa.Array, first: pa.Array, last: pa.Array, syy: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for row in zip(blocks, first, last, syy, starts):
            # one sweep's blocks at a time as Python's numbers, which take several times the room
            own, t0, t1, yy, points = (x.as_py() for x in row)
            if not points or not own:
                out.append(nothing)
                continue
            numbers = [np.array([b[c] for b in own], float) for c in ("block", "m", "v")]
            since, w, v = weighted_points(*numbers, t1 - t0)
            s = fresh_state(np.array(points))
            with np.errstate(all="ignore"):
                while len(k := running_rows(s)):
                    *sums, noise = weighted_sums(t0 + since, w, v, yy, s["trial"][k])
                    advance(s, k, *sums, max_passes, noise)
            quality = np.where(s["status"] == "failed", np.inf, s["sse"])
            out.append(_row(s, int(np.argmin(quality))))
        return pa.array(out, state_type)

    moments = write_table(_moments(slim, begin.select(*keys, "t_min", "t_max"), keys), "moments").df
    # at most LEVELS + 2 blocks a sweep
    blocks = moments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "m", "v"))).alias("blocks"))
    found = matched(begin, blocks, keys).withColumn("_fit", fit("blocks", "t_min", "t_max", "syy", "starts"))
    states = write_table(found.select(*keys, "n", "_fit.*"), "fit-state").df
    return _exact(slim, states, keys)


def _exact(slim: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """``states`` with the sums taken from the samples themselves."""
    points = states.filter(F.col("p").isNotNull()).select(
        *keys, F.lit(0).alias("start"), *[F.col("p")[k].alias(f"_p{k}") for k in range(5)]
    )
    sums = _pass_sums(slim.filter(F.col("_y").isNotNull()), points, keys).drop("start")
    joined = matched(states, sums, keys)
    at = {pair: 1 + m for m, pair in enumerate(_UPPER)}
    jtj = F.array(*[F.col("sums")[at[min(a, b), max(a, b)]] for a in range(5) for b in range(5)])
    sse, size = F.col("sums")[0], [F.col("sums")[at[k, k]] for k in range(5)]
    slope = [F.col("sums")[16 + k] for k in range(5)]
    level = reduce(
        lambda a, b: a & b, [g * g <= LEVEL_TOLERANCE**2 * d * sse for g, d in zip(slope, size)]
    ) | (sse <= 1e-20 * size[4])
    changed = {
        "jtj": jtj,
        "jtr": F.slice("sums", 17, 5),
        "sse": sse,
        "status": F.when((F.col("status") == "converged") & ~level, "stalled").otherwise(F.col("status")),
    }
    known = F.col("sums").isNotNull()
    summed = joined.withColumns({c: F.when(known, x).otherwise(F.col(c)) for c, x in changed.items()})
    inverse = inverse_diagonal(F.when(F.col("status") != "failed", F.col("jtj")))
    return summed.drop("sums").withColumn("unscaled", inverse)


def _pass_sums(rows: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of one iteration: residual, J'J (upper half) and J'r per point."""
    by_sweep = points.groupBy(*keys).agg(
        F.collect_list(F.struct("start", *[f"_p{k}" for k in range(5)])).alias("_points")
    )
    x = attach(rows, by_sweep, keys, "inner").select(
        *keys, "_t", "_y", F.inline("_points")
    )
    p = [F.col(f"_p{k}") for k in range(5)]
    e1, e2 = F.exp(-F.exp(p[1]) * F.col("_t")), F.exp(-F.exp(p[3]) * F.col("_t"))
    x = x.withColumns({"_e1": e1, "_e2": e2})
    jac = [
        F.col("_e1"),
        -p[0] * F.exp(p[1]) * F.col("_t") * F.col("_e1"),
        F.col("_e2"),
        -p[2] * F.exp(p[3]) * F.col("_t") * F.col("_e2"),
        F.lit(1.0),
    ]
    res = F.col("_y") - (p[0] * F.col("_e1") + p[2] * F.col("_e2") + p[4])
    x = x.withColumns({f"_j{k}": j for k, j in enumerate(jac)} | {"_r": res})
    j, r = [F.col(f"_j{k}") for k in range(5)], F.col("_r")
    sums = [r * r, *[j[a] * j[b] for a, b in _UPPER], *[c * r for c in j]]
    named = [F.sum(s).alias(f"_s{k}") for k, s in enumerate(sums)]
    return (
        x.groupBy(*keys, "start")
        .agg(*named)
        .select(
            *keys, "start", F.array(*[f"_s{k}" for k in range(len(sums))]).alias("sums")
        )
    )


def _report(states: DataFrame, keys: list[str]) -> DataFrame:
    """Named parameters, their variances and the fit statistics."""
    ok = F.col("status") != "failed"
    terms = {x: F.when(ok, F.get("p", F.lit(k))) for k, x in enumerate(TERMS)}
    named = states.select(
        *keys, "n", *[c.alias(x) for x, c in terms.items()],
        F.when(ok, F.col("sse")).alias("sse"), "passes", "status",
        F.when(~ok & (F.col("n") == 0), "no values")
        .when(~ok, "no usable starting point")
        .alias("error"),
        (F.col("status") == "converged").alias("is_conv"),
        F.when(ok, F.col("unscaled")).alias("_unscaled"),
    )
    out = fit_stats(named)
    variance = F.col("sigma") * F.col("sigma")
    return out.withColumn(
        "std_errors", F.transform("_unscaled", lambda u: F.sqrt(u * variance))
    ).drop("_unscaled")


def _inverse_diagonals(m: np.ndarray) -> np.ndarray:
    """Diagonals of the inverses of 5x5 matrices ``m[k]``; NaN where there is none."""
    diagonal = np.einsum("kii->ki", m)
    root = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    scaled = m / (root[:, :, None] * root[:, None, :])
    ok = np.isfinite(scaled).all(axis=(1, 2))
    # beyond this condition the inverse is rounding noise
    ok[ok] = ~(np.linalg.cond(scaled[ok]) > 1e14)
    out = np.full(diagonal.shape, np.nan)
    out[ok] = np.einsum("kii->ki", np.linalg.inv(scaled[ok])) / root[ok] ** 2
    out[~(np.isfinite(out) & (out >= 0)).all(axis=1)] = np.nan
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse_diagonal(jtj: pd.Series) -> pd.Series:
    """Diagonal of the inverse of each 5x5 matrix; NULL where it has none."""

    def invert(flat):
        if flat is None:
            return None
        (diagonal,) = _inverse_diagonals(np.array(flat, dtype=float).reshape(1, 5, 5))
        return None if np.isnan(diagonal).any() else diagonal

    return jtj.map(invert)


# --- tables made from fits -------------------------------------------------------


def fit_terms(
    fit: DataFrame, keys: Sequence[str] = SWEEP_KEYS, level: float = 0.95
) -> DataFrame:
    """One row per parameter with error, t statistic, p value and limits."""
    rows = [
        F.struct(
            F.lit(x).alias("term"),
            F.col(x).alias("estimate"),
            F.get("std_errors", F.lit(k)).alias("std_error"),
        )
        for k, x in enumerate(TERMS)
    ]
    terms = fit.select(
        *keys, F.col("df_residual").cast("double"), F.inline(F.array(*rows))
    ).withColumn("statistic", ratio("estimate", "std_error"))
    width = t_quantile(F.lit((1 + level) / 2), F.col("df_residual")) * F.col("std_error")
    return (
        terms.withColumn("p_value", t_p_value("statistic", "df_residual"))
        .withColumn("_width", width)
        .withColumns(
            {
                "conf_lo": F.col("estimate") - F.col("_width"),
                "conf_hi": F.col("estimate") + F.col("_width"),
            }
        )
        .drop("_width")
    )


def components(terms: DataFrame, keys: Sequence[str] = SWEEP_KEYS) -> DataFrame:
    """Two rows per sweep, fast and slow, each with amplitude, rate, tau and C.

    The five terms of a sweep are brought together by one small aggregate.
    """
    number, kind = first_number("term"), F.substring("term", 1, 1)

    def part(letter: str, k: int) -> Column:
        return F.max(F.when((kind == letter) & (number == k), F.col("estimate")))

    wide = terms.groupBy(*keys).agg(
        F.max(F.when(F.col("term") == "C", F.col("estimate"))).alias("C"),
        *[part(x, k).alias(f"_{x}{k}") for x in "Al" for k in (1, 2)],
    )
    both = [
        F.struct(
            tau(F.col(f"_l{k}")).alias("tau"),
            F.lit(k).alias("component"),
            F.col(f"_A{k}").alias("A"),
            F.col(f"_l{k}").alias("l"),
        )
        for k in (1, 2)
    ]
    ranked = wide.select(
        *keys, "C", F.posexplode(F.array_sort(F.array(*both))).alias("_rank", "_part")
    )
    return ranked.select(
        *keys, "C", "_part.*", speed_label(F.col("_rank") + 1).alias("speed")
    )


def time_constants(terms: DataFrame, keys: Sequence[str] = SWEEP_KEYS) -> DataFrame:
    """Time constants with limits, labelled fast and slow.

    The transformation reverses order, so the limits change places. A limit too
    large for a number is NULL.
    """
    rates = terms.filter(F.col("term").isin("lrc1", "lrc2"))

    def finite(x: Column) -> Column:
        return F.when(F.abs(x) < math.inf, x)

    as_tau = F.struct(
        tau("estimate").alias("tau"),
        "term",
        finite(tau("conf_hi")).alias("conf_lo"),
        finite(tau("conf_lo")).alias("conf_hi"),
    )
    # two rows per sweep by construction of the term table
    pair = rates.groupBy(*keys).agg(F.array_sort(F.collect_list(as_tau)).alias("_pair"))
    return pair.select(*keys, F.posexplode("_pair").alias("_rank", "_row")).select(
        *keys, "_row.*", speed_label(F.col("_rank") + 1).alias("component")
    )


def fitted_curve(
    fit: DataFrame, grid: Column, keys: Sequence[str] = SWEEP_KEYS
) -> DataFrame:
    """Fitted trace on a time grid: a fixed number of rows per sweep."""
    return fit.select(*keys, *TERMS, F.explode(grid).alias("t")).select(
        *keys, "t", two_exp("t", *TERMS[:4], "C").alias("fitted")
    )


def component_curves(
    parts: DataFrame, grid: Column, keys: Sequence[str] = SWEEP_KEYS
) -> DataFrame:
    """Curve of each single component on top of the constant."""
    return parts.select(*keys, "speed", "A", "l", "C", F.explode(grid).alias("t")).select(
        *keys, "speed", "t", one_exp("t", "A", "l", "C").alias("fitted")
    )
