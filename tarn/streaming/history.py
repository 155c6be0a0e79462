"""The newest points of every series, kept as stream state."""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K

# What runs in the tasks travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Times are microseconds here: the state gives timestamps back without a zone.
POINT = "at BIGINT, point_id BIGINT, value DOUBLE"
ROW = f"series STRING, {POINT}, gone BOOLEAN"
# What a series holds, read and written at once as one JSON text, which costs less than a list of rows: its last shutdown;
# the clock, in milliseconds, at which that is forgotten; and the points.
HELD = "held STRING"
OUTPUT = "series STRING, version BIGINT, points ARRAY<STRUCT<at: BIGINT, point_id: BIGINT, value: DOUBLE>>"


def cut_block(block: pd.DataFrame, n: int) -> pd.DataFrame:
    """The newest ``n`` points and the last shutdown of each series in one block."""
    ordered = block.sort_values(["at", "point_id"], kind="stable")
    return ordered[ordered.groupby(["series", "gone"], sort=False, dropna=False).cumcount(ascending=False) < n]


class KeepNewest(StatefulProcessor):
    """Holds at most ``n`` points per series, and when it was shut down last.

    A shutdown hides the points up to its time, whenever they arrive.  With ``keep``, a series that gets no
    point for that many seconds is forgotten, and so is a shutdown that old.
    """

    def __init__(self, n: int, keep: int | None = None) -> None:
        self.n, self.keep = n, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.keep is None else self.keep * 1000
        self.held = handle.getValueState("held", HELD, ttlDurationMs=ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get()
        ended, until, points = json.loads(held[0]) if held else (None, None, [])
        now = None if self.keep is None else timerValues.getCurrentProcessingTimeInMs()
        if until is not None and until <= now:
            ended = None
        was, newest = ended, [tuple(p) for p in points]
        heapq.heapify(newest)
        version = max([p[0] for p in newest] + ([ended] if ended is not None else []), default=None)
        for row in rows:
            version = row.at if version is None else max(version, row.at)
            if row.gone:
                ended = row.at if ended is None else max(ended, row.at)
            elif len(newest) < self.n:
                heapq.heappush(newest, (row.at, row.point_id, row.value))
            else:
                heapq.heappushpop(newest, (row.at, row.point_id, row.value))
        kept = sorted(p for p in newest if ended is None or p[0] > ended)
        if ended != was:
            until = None if self.keep is None else now + self.keep * 1000
        self.held.update((json.dumps((ended, until, kept)),))
        yield Row(series=key[0], version=version, points=[Row(at=t, point_id=i, value=v) for t, i, v in kept])

    def close(self) -> None:
        pass


def rolling_history(points: DataFrame, n: int = K.HISTORY_POINTS, keep: int | None = None) -> DataFrame:
    """The newest ``n`` points of each series after every micro-batch, for update mode.

    The state is ``n`` points and one time for each series: of every series ever seen without ``keep``, and with
    it of those that had a point within as many seconds by the clock.  A later point of a forgotten series starts it anew.

    ``points`` has ``series, ts, point_id, value`` and may have ``gone``.  Before
    the shuffle every Arrow block is cut to ``n`` points per series, so a series
    with very many points does not send them all to the task that keeps it.
    """
    gone = F.coalesce("gone", F.lit(False)) if "gone" in points.columns else F.lit(False)
    rows = points.select(
        "series", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "point_id",
        F.col("value").cast("double").alias("value"), gone.alias("gone"),
    )

    def cut(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            yield cut_block(block, n)

    return (
        rows.mapInPandas(cut, ROW)
        .groupBy("series")
        .transformWithState(
            statefulProcessor=KeepNewest(n, keep), outputStructType=OUTPUT, outputMode="Update",
            timeMode="None" if keep is None else "ProcessingTime",
        )
    )


def history_points(kept: DataFrame) -> DataFrame:
    """The kept points as rows."""
    points = kept.select("series", F.explode("points").alias("p"))
    return points.select("series", F.timestamp_micros("p.at").alias("ts"), "p.point_id", "p.value")
