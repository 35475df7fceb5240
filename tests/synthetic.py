"""Synthetic recordings with known answers."""

import numpy as np
import pandas as pd

from sweepframe import Protocol

DT = 2e-4
N = 10_000  # 2 s per sweep


def protocol(**changes) -> Protocol:
    defaults = dict(dt=DT, probe=1.0, ref_sweep=3, sg_length=101)
    return Protocol(**(defaults | changes))


def step_sweep(v: float, rate: float = 6.0) -> pd.DataFrame:
    """Classic step: activation during the test pulse, decay during the tail."""
    idx = np.arange(N)
    t = idx * DT
    volt = np.where((t >= 0.6) & (t < 1.3), v, -80.0)
    test = np.clip(t - 0.6, 0, None)
    post = np.clip(t - 1.3, 0, None)
    amp = (v + 130) / 10
    current = np.where(
        t < 0.6,
        0.5,
        np.where(
            t < 1.3,
            amp * (0.2 + 0.8 * (1 - np.exp(-rate * test))),
            amp * 0.5 * np.exp(-8 * post) + 0.1,
        ),
    )
    return pd.DataFrame({"sample_idx": idx, "t": t, "i": current, "v": volt})


def recording(name: str, steps=(-120.0, 0.0, 60.0)) -> pd.DataFrame:
    parts = []
    for k, v in enumerate(steps, start=1):
        part = step_sweep(v)
        part.insert(0, "sweep", k)
        parts.append(part)
    out = pd.concat(parts, ignore_index=True)
    out.insert(0, "recording", name)
    return out


def biexp(n=3000, a1=0.65, l1=5.0, a2=0.35, l2=2.0, c=0.0, noise=0.0, seed=0):
    t = np.arange(n) * DT + 0.001
    y = a1 * np.exp(-np.exp(l1) * t) + a2 * np.exp(-np.exp(l2) * t) + c
    if noise:
        y = y + np.random.default_rng(seed).normal(0, noise, n)
    return t, y
