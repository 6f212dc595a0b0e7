"""Trust in position fixes as a state machine: TRUSTED, SUSPECT, LOST, RECOVERING.

The next state depends on the one before, so this is a kernel over one trip in order of time; trips run side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "trip_id long, seq int, t double, accepted boolean, state string"


#: Where a rejected fix leads; from SUSPECT only after ``bad`` of them in a row.
ON_REJECTED = {"TRUSTED": "SUSPECT", "SUSPECT": "LOST", "RECOVERING": "LOST", "LOST": "LOST"}


class Monitor:
    """Starts without trust; ``good`` accepted fixes in a row give it, doubts and silence of over ``gap`` seconds take it."""

    def __init__(self, bad: int = 3, good: int = 4, gap: float = 5.0):
        self.bad, self.good, self.gap = bad, good, gap
        self.state, self.rejected, self.accepted, self.last = "LOST", 0, 0, None

    def silent(self, t: float) -> bool:
        """Whether the time since the last fix takes what trust there is."""
        quiet = self.last is not None and t - self.last > self.gap and self.state != "LOST"
        if quiet:
            self.state, self.accepted = "LOST", 0
        return quiet

    def update(self, t: float, ok: bool) -> str:
        self.last = t
        if ok:
            self.accepted, self.rejected = self.accepted + 1, 0
            if self.state != "TRUSTED":
                self.state = "TRUSTED" if self.accepted >= self.good else "RECOVERING"
        else:
            self.accepted, self.rejected = 0, self.rejected + 1
            if self.state != "SUSPECT" or self.rejected >= self.bad:
                self.state = ON_REJECTED[self.state]
        return self.state


def histories(df: DataFrame, bad: int = 3, good: int = 4, gap: float = 5.0) -> DataFrame:
    """State after each fix (trip_id, seq, t, accepted)."""

    def run(trip: pd.DataFrame) -> pd.DataFrame:
        trip = trip.sort_values(["t", "seq"])
        monitor, states = Monitor(bad, good, gap), []
        for t, ok in zip(trip["t"], trip["accepted"], strict=True):
            monitor.silent(t)
            states.append(monitor.update(t, bool(ok)))
        return trip.assign(state=states)[["trip_id", "seq", "t", "accepted", "state"]]

    return df.select("trip_id", "seq", "t", "accepted").groupBy("trip_id").applyInPandas(run, SCHEMA)
