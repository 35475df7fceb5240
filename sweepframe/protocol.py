"""Step-protocol description: time anchors and the windows derived from them.

All times are seconds from the start of the sweep. Windows are open at both
ends, so a sample that sits exactly on an edge is outside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """Open interval on one column."""

    lo: float
    hi: float

    def holds(self, col: Column | str) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return (c > F.lit(self.lo)) & (c < F.lit(self.hi))


@dataclass(frozen=True)
class Protocol:
    """Constants of one step protocol.

    ``probe`` is the time at which the step voltage is read, ``dt`` the sample
    step (half of it is the tolerance when looking for the probe sample) and
    ``ref_sweep`` the sweep whose relaxed tail sets the zero of all tails.
    """

    t_pre: float = 0.1
    t_test: float = 0.6
    t_post: float = 1.3
    t_steady: float = 1.9
    probe: float = 1.0
    dt: float = 5e-5
    ref_sweep: int = 24
    t_offset: float = 0.001
    has_prepulse: bool = False
    sg_order: int = 3
    sg_length: int = 101
    timepoints_ms: dict[str, float] = field(
        default_factory=lambda: {
            "i_inst": 3.0,
            "i_50": 50.0,
            "i_100": 100.0,
            "i_150": 150.0,
            "i_200": 200.0,
            "i_400": 400.0,
            "i_ss": 600.0,
        }
    )

    def onset(self, anchor: float) -> Window:
        """First clean millisecond after a voltage jump."""
        return Window(anchor + 0.001, anchor + 0.002)

    def settled(self, anchor: float) -> Window:
        """Nine milliseconds that end one before the next jump."""
        return Window(anchor - 0.01, anchor - 0.001)

    def feature_windows(self) -> dict[str, Window]:
        at = {"i_inst": self.onset(self.t_test)}
        for ms in (50, 100, 150, 200, 400):
            start = self.t_test + ms / 1000
            at[f"i_{ms}"] = Window(start, start + 0.001)
        at["i_ss"] = self.settled(self.t_post)
        at["i_tail_ss"] = self.settled(self.t_steady)
        at["i_tail"] = self.onset(self.t_post)
        if self.has_prepulse:
            at["i_inst_pre"] = self.onset(self.t_pre)
            at["i_ss_pre"] = self.settled(self.t_test)
        return at

    def pre_phase(self) -> Window:
        return Window(self.t_pre + 0.001, self.t_test)

    def test_phase(self) -> Window:
        return Window(self.t_test + 0.001, self.t_post)

    def tail_phase(self) -> Window:
        return Window(self.t_post + 0.001, self.t_steady)


CLASSIC = Protocol(probe=1.0)
PREPULSE = Protocol(probe=0.65, has_prepulse=True)
#: Relaxation fits read the step 0.2 s into the test pulse.
RELAXATION = Protocol(probe=0.8)
