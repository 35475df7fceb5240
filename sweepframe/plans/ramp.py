"""Ramp protocol: from samples to cohort I-V curves and recording quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import nernst
from sweepframe.operators.annotate import correct_junction, cut, flip
from sweepframe.operators.cohort import average_sweeps, counts_of_ids, id_listing, mean_se
from sweepframe.operators.features import mean_where
from sweepframe.operators.normalise import (
    flag_pairs,
    pair_baseline,
    percent_block,
    to_baseline,
)
from sweepframe.protocol import Window
from sweepframe.session import write_table
from sweepframe.sources.traces import add_condition

RAMP = Window(0.4, 1.4)
BASELINE_BAND = Window(99.5, 100.5)
ZERO_BAND = Window(-0.2, 0.2)
NO_CURRENT = Window(-1.0, 1.0)


@dataclass(frozen=True)
class RampAnalysis:
    """Tables of the ramp analysis, each at its own level."""

    by_id: DataFrame
    by_channel: DataFrame
    measures: DataFrame
    quality: DataFrame


def prepare(samples: DataFrame, potentials: DataFrame | None = None) -> DataFrame:
    """Ramp part of each sweep in physiological sign, junction corrected."""
    return add_condition(correct_junction(flip(cut(samples, RAMP)), potentials))


def curves_by_id(prepared: DataFrame) -> DataFrame:
    """One average curve per recording, raw and relative to +100 mV at baseline."""
    return relative_to_baseline(average_sweeps(prepared))


def relative_to_baseline(averaged: DataFrame) -> DataFrame:
    """Averaged curves with the current relative to +100 mV at baseline."""
    baseline = BASELINE_BAND.holds("v_corr") & (F.col("cond") == "baseline")
    return to_baseline(averaged, ["id"], baseline)


def curves_by_channel(by_id: DataFrame) -> DataFrame:
    """Cohort curves with standard errors."""
    keys = ["channel", "Pip", "cond", "sample_idx"]
    return mean_se(by_id, keys, ["i", "i_norm"], ["v_corr", "ek", "t"])


def measures(by_id: DataFrame) -> DataFrame:
    """Current at 0 mV and zero-current potential per recording, block, pair flag."""
    avg = by_id.groupBy("id", "channel", "Pip", "cond").agg(
        mean_where("i", ZERO_BAND.holds("v_corr")).alias("i_0"),
        mean_where("v_corr", NO_CURRENT.holds("i")).alias("mp"),
    )
    return flag_pairs(percent_block(avg))


def quality(measured: DataFrame) -> DataFrame:
    """Baseline measures with the blocked measures beside them."""
    return pair_baseline(measured.drop("n_baseline"))


def analyse(samples: DataFrame, potentials: DataFrame | None = None) -> RampAnalysis:
    """All tables from one pass over the samples. Runs jobs.

    The averaged curves and the measures are written once; everything else reads them.
    """
    averaged = write_table(average_sweeps(prepare(samples, potentials)), "averaged").df
    by_id = write_table(relative_to_baseline(averaged), "curves-by-id").df
    measured = write_table(measures(by_id), "ramp-measures").df
    return RampAnalysis(by_id, curves_by_channel(by_id), measured, quality(measured))


def pairs_per_group(quality_table: DataFrame, channel: str) -> DataFrame:
    """Number of complete pairs per solution of one channel."""
    return counts_of_ids(
        quality_table.filter(F.col("block_measured") & (F.col("channel") == channel)),
        ["channel", "Pip"],
    )


def complete_ids(quality_table: DataFrame) -> DataFrame:
    """Ids with a complete pair, sorted by solution."""
    pairs = quality_table.filter("block_measured")
    return id_listing(pairs, ["channel", "Pip"], "id", ["Pip", "channel", "id"])


def quality_scatter(quality_table: DataFrame, channel: str) -> DataFrame:
    """Points of the quality plot that lie inside its axis limits."""
    low, zero = nernst(140.0, 5.0), F.lit(0.0)
    return quality_table.filter(
        (F.col("channel") == channel)
        & F.col("block_measured")
        & F.col("mp").between(low, zero)
        & F.col("mp_treated").between(low, zero)
    )
