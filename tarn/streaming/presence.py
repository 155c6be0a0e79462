"""Users of the portal as stream state that ends: on a shutdown, and when a user has been silent by the clock."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K

# What runs in the tasks travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIVE, GONE, IDLE, SHUTDOWN = "live", "gone", "idle", "shutdown"
# Times are microseconds: ``first`` and ``last`` heartbeat of a stretch, and how many there were; none is a shutdown.
STRETCH = "first BIGINT, last BIGINT, beats BIGINT"
# All that a user in the portal holds, read and written at once as one JSON text, which costs less than a list of rows:
# ``settled``; ``until``, the clock at which that no longer counts; ``due``, the one at which the user ends; ``timer``, the one
# at which that is looked at, these three in milliseconds; and the stretches.
HELD = "held STRING"
OUTPUT = "usuario STRING, event STRING, first BIGINT, last BIGINT, beats BIGINT"


def sessions(stretches: list[tuple], silence: int) -> list[tuple]:
    """(first, last, beats, ended by a shutdown) in order of time; a shutdown at the time of a heartbeat comes after it."""
    out: list[list] = []
    is_open = False
    for first, last, beats in sorted(stretches, key=lambda s: (s[0], s[2] == 0)):
        if not beats:
            if is_open and first - out[-1][1] <= silence:  # later, the session has ended by itself
                out[-1][3] = first
            is_open = False
        elif is_open and first - out[-1][1] <= silence:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] += beats
        else:
            out.append([first, last, beats, None])
            is_open = True
    return [tuple(s) for s in out]


class Presence(StatefulProcessor):
    """The open stretches of a user, the time up to which all is settled, and one timer.

    A user's heartbeats may come in any order within ``delay`` of the newest one; what is older than that is
    dropped.  Stretches that old are merged and finished sessions put out.  The timer ends the user
    ``silence`` after the newest heartbeat by the clock, and not before ``patience`` has passed since any came; then
    nothing of the user stays but, for ``mark`` by the clock, the time up to which all is settled, against stragglers.
    Heartbeats only move the time that is due, and a timer that fires before it is set anew: so a user costs one read
    and one write of the state in each micro-batch.
    """

    def __init__(self, silence: int, delay: int, patience: int, mark: int) -> None:
        self.silence, self.delay, self.patience, self.mark = silence * 1_000_000, delay * 1_000_000, patience * 1000, mark * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)
        # Of users who are not there.
        self.settled = handle.getValueState("settled", "at BIGINT", ttlDurationMs=self.mark)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.held.get()
        settled, until, _, timer, stretches = json.loads(held[0]) if held else (*(self.settled.get() or (None,)), None, None, None, [])
        if until is not None and until <= now:
            settled = until = None
        kept = [tuple(s) for s in stretches]
        kept += [(r.at, r.at, 0 if r.gone else 1) for r in rows if settled is None or r.at > settled]
        if not kept:
            return
        newest = max(last for _, last, _ in kept)
        horizon = newest - self.delay
        found = sessions(kept, self.silence)
        done = [s for s in found if max(s[1] + self.silence, s[3] or 0) < horizon or (s[3] is not None and s[3] < horizon)]
        if done:
            settled, until = max(s[3] or s[1] for s in done), now + self.mark
            kept = [s for s in kept if s[1] > settled]
        elif held is None and settled is not None:
            until = now + self.mark
        # The newest one always stays.
        last = max(kept, key=lambda s: (s[1], s[2] == 0))
        # Who was shut down stays no longer than a straggler may be late.
        due = max((newest + (self.silence if last[2] else self.delay)) // 1000 + 1, now + self.patience)
        if timer is None or timer > due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.held.update((json.dumps((settled, until, due, timer, merged(kept, horizon, self.silence))),))
        yield from self.finished(key, done)
        yield Row(usuario=key[0], event=LIVE if last[2] else GONE, first=last[0], last=last[1], beats=last[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held is None:
            return
        settled, until, due, _, stretches = json.loads(held[0])
        if due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
            self.held.update((json.dumps((settled, until, due, due, stretches)),))
            return
        kept = [tuple(s) for s in stretches]
        newest = max(last for _, last, _ in kept)
        self.held.clear()
        self.settled.update((newest,))
        yield from self.finished(key, sessions(kept, self.silence))
        yield Row(usuario=key[0], event=GONE, first=newest, last=newest, beats=0)

    def finished(self, key, done: list[tuple]) -> Iterator[Row]:
        for first, last, beats, end in done:
            yield Row(usuario=key[0], event=IDLE if end is None else SHUTDOWN, first=first, last=last, beats=beats)

    def close(self) -> None:
        pass


def merged(stretches: list[tuple], horizon: int, silence: int) -> list[tuple]:
    """Stretches that no straggler can come between become one, so that an open session does not grow with its heartbeats."""
    out: list[list] = []
    for first, last, beats in sorted(stretches, key=lambda s: (s[0], s[2] == 0)):
        if out and beats and out[-1][2] and last < horizon and first - out[-1][1] <= silence:
            out[-1][1], out[-1][2] = max(out[-1][1], last), out[-1][2] + beats
        else:
            out.append([first, last, beats])
    return [tuple(s) for s in out]


def presence(
    heartbeats: DataFrame, silence: int = K.IDLE_SECONDS, delay: int = 600, patience: int = 600, mark: int = 600,
    mode: str = "Update",
) -> DataFrame:
    """What happens to each user, as ``usuario, event, session_start, last_seen, beats``, for a sink of that mode.

    ``live`` and ``gone`` rows say after every micro-batch whether the user is there; ``idle`` and ``shutdown`` rows are the
    finished sessions, each once.  ``heartbeats`` has ``usuario`` and ``ts`` and may have ``gone``, a shutdown.  An idle row
    comes out when the clock says so, also while no other user sends anything; a stream that catches up with old
    heartbeats waits ``patience`` seconds for the next ones.  All four bounds are seconds.
    """
    gone = F.coalesce("gone", F.lit(False)) if "gone" in heartbeats.columns else F.lit(False)
    rows = heartbeats.select("usuario", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), gone.alias("gone"))
    events = rows.groupBy("usuario").transformWithState(
        statefulProcessor=Presence(silence, delay, patience, mark), outputStructType=OUTPUT, outputMode=mode, timeMode="ProcessingTime")
    return events.select(
        "usuario", "event", F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("last").alias("last_seen"), "beats")


def ended_sessions(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(IDLE, SHUTDOWN))


def users_now(events: DataFrame) -> DataFrame:
    """``usuario, last_seen, gone`` to be landed by user in the order of both; the table needs no row of a user who is gone."""
    return events.where(F.col("event").isin(LIVE, GONE)).select("usuario", "last_seen", (F.col("event") == GONE).alias("gone"))
