"""Heartbeats, idle users and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K


def last_seen(heartbeats: DataFrame) -> DataFrame:
    return heartbeats.groupBy("usuario").agg(F.max("ts").alias("last_seen"))


def idle_at(heartbeats: DataFrame, now, seconds: int = K.IDLE_SECONDS) -> DataFrame:
    """Users whose last heartbeat lies more than ``seconds`` before ``now``."""
    timeout = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return last_seen(heartbeats).where(F.col("last_seen") < now - timeout)


def idle_gaps(heartbeats: DataFrame, seconds: int = K.IDLE_SECONDS) -> DataFrame:
    """Sessions of each user: a silence of more than ``seconds`` starts a new one.

    Heartbeats less than ``seconds`` apart never belong to two sessions, so all
    heartbeats in one cell of that width are first merged into their earliest
    and latest.  That merge happens in part before the shuffle.  What is ordered
    per user afterwards is bounded by the time span, however many heartbeats the
    user sent.
    """
    micros = seconds * 1_000_000
    kind = dict(heartbeats.dtypes)["ts"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cells = (
        heartbeats.select("usuario", at.alias("at"))
        .groupBy("usuario", (F.col("at") - F.pmod("at", F.lit(micros))).alias("cell"))
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("beats"))
    )
    by_time = W.partitionBy("usuario").orderBy("cell")
    silence = F.col("first_at") - F.lag("last_at").over(by_time)
    starts = F.when(silence.isNull() | (silence > micros), 1).otherwise(0)
    numbered = cells.withColumn("starts", starts).withColumn(
        "session",
        F.sum("starts").over(by_time.rowsBetween(W.unboundedPreceding, 0)),
    )
    return numbered.groupBy("usuario", "session").agg(
        F.timestamp_micros(F.min("first_at")).cast(kind).alias("session_start"),
        F.timestamp_micros(F.max("last_at")).cast(kind).alias("last_seen"),
        F.sum("beats").alias("beats"),
    )
