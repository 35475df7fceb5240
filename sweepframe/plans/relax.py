"""Relaxation fits of the test pulse and of the tail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.scalars import step_grid
from sweepframe.operators.annotate import SWEEP_KEYS, flip, step_voltage
from sweepframe.operators.expfit import (
    component_curves,
    components,
    fit_terms,
    fitted_curve,
    refine_fit,
    time_constants,
)
from sweepframe.operators.keyed import matched
from sweepframe.operators.normalise import phase_norm, tail_phase_norm
from sweepframe.protocol import Protocol
from sweepframe.session import write_table
from sweepframe.sources.tables import write_summaries

#: Prediction grid: 0 to 0.7 s in steps of 0.1 ms.
GRID_STEPS, GRID_STEP = 7000, 0.0001


@dataclass(frozen=True)
class RelaxationFits:
    fits: DataFrame
    terms: DataFrame
    by_component: DataFrame
    taus: DataFrame

    def curves(self, keys: Sequence[str] = SWEEP_KEYS) -> DataFrame:
        """Fitted trace of every sweep on the prediction grid."""
        return fitted_curve(self.fits, step_grid(0, GRID_STEPS, GRID_STEP), keys)

    def component_curves(self, keys: Sequence[str] = SWEEP_KEYS) -> DataFrame:
        grid = step_grid(0, GRID_STEPS, GRID_STEP)
        return component_curves(self.by_component, grid, keys)

    def tables(
        self, meta: DataFrame | None = None, by: Sequence[str] = ("recording",)
    ) -> dict[str, DataFrame]:
        """The three tables kept per recording, without arrays, ``meta`` beside them.

        ``meta`` has one row per recording.
        """
        parts = {
            "glance": self.fits.drop("std_errors"),
            "estimates": self.terms,
            "by_component": self.by_component,
        }
        if meta is None:
            return parts
        return {name: matched(df, meta, by) for name, df in parts.items()}

    def write(
        self, folder: str, meta: DataFrame | None = None, csv: bool = False,
        by: str = "recording",
    ) -> None:
        """Write those tables below ``folder``; recordings already there are replaced."""
        for name, df in self.tables(meta, [by]).items():
            write_summaries(df, f"{folder.rstrip('/')}/{name}", by, csv)


def test_pulse(
    samples: DataFrame, p: Protocol, keys: Sequence[str] = SWEEP_KEYS, invert: bool = True
) -> DataFrame:
    """Normalised deactivation on the test pulse, steps below -20 mV.

    ``invert``: the samples have the sign of the recording.
    """
    return phase_norm(
        flip(samples) if invert else samples, p.test_phase(), p.settled(p.t_post), p.onset(p.t_test), p.t_test, keys,
        p.t_offset, extra={"v_pulse": step_voltage(p)}, only=F.col("v_pulse") < -20,
    )


def tail(
    samples: DataFrame, p: Protocol, keys: Sequence[str] = SWEEP_KEYS, invert: bool = True
) -> DataFrame:
    """Normalised tails after steps above 0 mV.

    The zero comes from the reference sweep, whatever its own step voltage.
    ``invert``: the samples have the sign of the recording.
    """
    return tail_phase_norm(
        flip(samples) if invert else samples, p, keys, extra={"v_pulse": step_voltage(p)}, only=F.col("v_pulse") > 0
    )


def fit(relaxation: DataFrame, keys: Sequence[str] = SWEEP_KEYS) -> RelaxationFits:
    """Fit every sweep and derive the term, component and time-constant tables."""
    fits = write_table(refine_fit(relaxation, keys), "fits").df
    terms = write_table(fit_terms(fits, keys), "terms").df
    return RelaxationFits(fits, terms, components(terms, keys), time_constants(terms, keys))
