"""Spark applications, their jobs and their progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import driver_link, format_duration
from ..functions.usage import app_state_class, job_state_class, or_zero, task_percent, task_total


def rows_for_state(apps: DataFrame, *states: str) -> DataFrame:
    return apps.where(F.col("state").isin(*states))


def app_state_counts(apps: DataFrame) -> DataFrame:
    return apps.groupBy("state", app_state_class("state").alias("class")).agg(F.count("*").alias("apps"))


def recent_completed(apps: DataFrame, n: int = K.RECENT_COMPLETED) -> DataFrame:
    """The ``n`` completed applications that started last."""
    return (
        rows_for_state(apps, K.GOOD_STATE, *K.BAD_STATES)
        .orderBy(F.desc("start_ts"), "app_id")
        .limit(n)
        .withColumn("duration", format_duration("duration_ms"))
    )


def with_progress(jobs: DataFrame) -> DataFrame:
    """Task totals, percentages and state class of each job."""
    active = F.col("active_raw") if "active_raw" in jobs.columns else F.lit(None).cast("bigint")
    return (
        jobs.withColumn("total", task_total("num_tasks"))
        .withColumn("completed", or_zero("completed_raw"))
        .withColumn("active", or_zero(active))
        .withColumn("completed_percent", task_percent("completed_raw", "num_tasks"))
        .withColumn("active_percent", task_percent(active, "num_tasks"))
        .withColumn("status_class", job_state_class("status"))
    )


def jobs_newest_first(jobs: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """All jobs, the newest of each application first.

    The range partitioning behind this sort cuts inside an application, so one
    with very many jobs is spread over tasks.
    """
    return jobs.orderBy("app_id", F.desc("job_id"), *(ties or []))


def app_progress(apps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of every application; one without jobs keeps one row of NULLs.

    Written as the jobs joined to their application plus the applications
    without jobs, so that Spark can split the jobs of a hot application, which an
    outer join of the applications would not allow.  The applications are dealt
    out evenly first: Spark splits no join whose other side comes grouped by the key.
    """
    progress = with_progress(jobs)
    columns = [c for c in progress.columns if c != "app_id"]
    matched = progress.join(apps.hint("rebalance"), "app_id").select(*apps.columns, *columns)
    waiting = apps.join(jobs.select("app_id").distinct(), "app_id", "left_anti")
    types = dict(progress.dtypes)
    nulls = [F.lit(None).cast(types[c]).alias(c) for c in columns]
    return matched.unionByName(waiting.select(*apps.columns, *nulls))


def app_totals(apps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs and tasks of each application, summed before the join."""
    zero = F.lit(0).cast("bigint")
    totals = (
        with_progress(jobs)
        .groupBy("app_id")
        .agg(
            F.count("*").alias("jobs"),
            F.sum("total").alias("tasks"),
            F.sum("completed").alias("completed"),
            F.sum("active").alias("active"),
        )
    )
    return apps.join(totals, "app_id", "left").select(
        *apps.columns, *[F.coalesce(c, zero).alias(c) for c in ("jobs", "tasks", "completed", "active")]
    )


def driver_links(app_pages: DataFrame, html: str = "html") -> DataFrame:
    return app_pages.withColumn("driver_url", driver_link(html)).drop(html)
