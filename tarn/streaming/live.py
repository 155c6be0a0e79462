"""Stream forms of the metrics, session, landing and application operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.usage import latest_per_role, metrics_of_roles
from ..sources.payloads import app_pictures, snapshots_of, with_files


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone; plain ones count as session time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def metrics_stream(samples: DataFrame, order: list[str], delay: str) -> DataFrame:
    """Workspace metrics of each user for every three-second window, for update mode.

    A window comes out with every micro-batch that adds to it, so the last one is
    seen at once; landed by user and window with ``version``, its newest sample, the
    table holds each window as it is by now.  Samples that are later than ``delay`` are dropped.
    """
    newest = (
        event_time(samples)
        .withWatermark("ts", delay)
        .groupBy("usuario", F.window("ts", f"{K.METRICS_SECONDS} seconds").alias("w"))
        .agg(*latest_per_role(order), F.max(F.struct(*order)).alias("version"))
        .withColumn("window_start", F.col("w.start"))
    )
    return metrics_of_roles(newest, ["usuario", "window_start", "version"])


def idle_sessions(heartbeats: DataFrame, delay: str) -> DataFrame:
    """A row for each session once its user has been silent for the timeout.

    In append mode the row comes out when the watermark passes the last
    heartbeat plus the timeout: that is the moment the user counts as idle.  The
    watermark is that of all users, so ``delay`` has to cover how late a heartbeat may
    arrive behind those of others; later ones are dropped.
    """
    return (
        event_time(heartbeats)
        .withWatermark("ts", delay)
        .groupBy("usuario", F.session_window("ts", f"{K.IDLE_SECONDS} seconds").alias("s"))
        .agg(F.max("ts").alias("last_seen"), F.count("*").alias("beats"))
        .select("usuario", F.col("s.start").alias("session_start"), "last_seen", "beats")
    )


def last_seen(heartbeats: DataFrame) -> DataFrame:
    """Latest heartbeat of each user, for update mode.

    A row with ``gone`` set is a shutdown.  The user stays forgotten until a
    later heartbeat; ``present`` drops forgotten users when reading.
    """
    gone = F.coalesce("gone", F.lit(False)) if "gone" in heartbeats.columns else F.lit(False)
    return (
        event_time(heartbeats)
        .withColumn("gone", gone)
        .groupBy("usuario")
        .agg(F.max("ts").alias("last_seen"), F.max_by("gone", F.struct("ts", "gone")).alias("gone"))
    )


def app_status(payloads: DataFrame) -> DataFrame:
    """The picture that every poll gives of its master's applications.

    Landed by ``master`` in the order of ``snapshot_id``, the table holds the last complete poll of each master and
    nothing else: an application that it does not name is gone.  ``pictured_apps`` gives the applications.
    ``payloads`` is a stream of whole texts; ``broken_polls`` gives those left out here.
    """
    return app_pictures(snapshots_of(with_files(payloads))[0])


def broken_polls(payloads: DataFrame) -> DataFrame:
    return snapshots_of(with_files(payloads))[1]


def present(users: DataFrame) -> DataFrame:
    return users.where(~F.col("gone")).drop("gone")
