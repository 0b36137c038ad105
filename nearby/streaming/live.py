"""Streams: positions tracked per car, alerts, a bounded deck of stops, and feeds refreshed into a table.

State is per car and small (the last fix and sums, or at most 16 stops). Late fixes within the watermark
are put in order inside a batch; what comes later than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nearby.operators import drive
from nearby.operators.drive import MOST_AHEAD
from nearby.streaming.refresh import newest, refresh_stream, versions

__all__ = ["alert_stream", "deck_stream", "newest", "refresh_stream", "track_stream", "versions"]

TRACK_STATE = "at double, lat double, lon double, odometer double, speed double, heading double, from_lat double, from_lon double"
ALERT_STATE = "run int, arrived boolean, last double"


def ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(["fix_at", "event_id"], kind="stable")


def stepping(new: tuple, step: Callable, out: Callable, columns: list[str]) -> Callable:
    """The step of a batch operator over a car's new rows, from and to the car's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, rows = state.get if state.exists else new, []
        for row in ordered(batches).itertuples(index=False):
            kept, made = step(kept, row)
            rows += out(row, made)
        state.update(kept)
        yield pd.DataFrame(rows, columns=columns)

    return run


def track_stream(fixes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The rows of ``drive.track`` for a stream of fixes (car, fix_at, event_id, lat, lon, gps_heading, gps_speed)."""
    keyed = drive.with_gps(fixes).where("lat is not null and lon is not null").withWatermark("fix_at", late).groupBy("car")
    columns = [c.split()[0] for c in drive.TRACKED.split(", ")]
    return keyed.applyInPandasWithState(stepping(drive.NEW_TRACK, drive.track_step, drive.tracked_row, columns), drive.TRACKED, TRACK_STATE, "append", GroupStateTimeout.NoTimeout)


def alert_stream(located: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The rows of ``drive.route_alerts`` for a stream of located fixes (car, fix_at, event_id, off, left)."""
    keyed = located.withWatermark("fix_at", late).groupBy("car")
    columns = [c.split()[0] for c in drive.ALERTED.split(", ")]
    return keyed.applyInPandasWithState(stepping(drive.NEW_ALERTS, drive.alert_step, drive.alert_row, columns), drive.ALERTED, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)


#: What is kept of a car's deck: its stops, their scores, the odometer at which each is passed, and the odometer.
DECK_STATE = "ids array<string>, scores array<double>, marks array<double>, odometer double"
#: A car that says nothing for so long is forgotten.
IDLE = 6 * 3600 * 1000


def step_deck(k: int, margin: float, far: float) -> Callable:
    """``drive.deck_step`` over a car's new rows in order, from and to the car's state."""
    step = drive.deck_step(k, margin, far)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, out = drive.NEW_DECK, []
        if state.exists:
            ids, scores, marks, odometer = state.get
            kept = tuple(zip(ids, scores, marks)), odometer
        rows = pd.concat(list(batches), ignore_index=True).sort_values(drive.DECK_ORDER, ascending=drive.DECK_ASCENDING, kind="stable")
        for row in rows.itertuples(index=False):
            kept, moves = step(kept, row)
            out += [(key[0], row.tick, *m) for m in moves]
        held, odometer = kept
        state.update(([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], odometer))
        state.setTimeoutDuration(IDLE)
        yield pd.DataFrame(out, columns=["car", "tick", "id", "move"])

    return run


def deck_stream(candidates: DataFrame, positions: DataFrame | None = None, k: int = MOST_AHEAD, margin: float = 1.0, far: float = 7.0) -> DataFrame:
    """The rows of ``drive.deck_moves`` for two streams, candidates (car, tick, id, value, ahead) and positions (car, tick, odometer).

    Both feed one state for each car. Rows of a batch are put in order; what a later batch brings for an earlier tick counts
    when it comes. Cars that are silent for ``IDLE`` milliseconds are forgotten.
    """
    return drive.deck_events(candidates, positions).groupBy("car").applyInPandasWithState(step_deck(k, margin, far), drive.MOVES, DECK_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
