"""Spark jobs over sampled traces: recordings made of sweeps made of samples.

Levels of data, one DataFrame each:

* sample:    recording, sweep, sample_idx, t (s), i (current), v (voltage)
* sweep:     one row per (recording, sweep) with window features
* recording: one row per recording (or per cell id and condition)
* cohort:    one row per experimental group
"""

from sweepframe.protocol import CLASSIC, PREPULSE, RELAXATION, Protocol, Window

__all__ = ["CLASSIC", "PREPULSE", "RELAXATION", "Protocol", "Window"]
