"""Workspace CPU and memory from container samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rounding import round_2
from ..functions.usage import BYTES_PER_MB, clamp_100, cpu_percent, or_zero, real_memory
from .keyed import newest_n

SAMPLE_FIELDS = ("mem_usage", "mem_cache", "mem_limit", "cpu_delta", "system_delta", "nano_cpus")


def _slot(role: str) -> str:
    return role.replace("-", "_")


def latest_per_role(order: list[str]) -> list[Column]:
    """Aggregates that keep the newest sample of each role."""
    sample = F.struct(*SAMPLE_FIELDS)
    rank = F.struct(*order)
    # Used where an aggregation is the only way, as in a stream.
    return [
        F.max_by(F.when(F.col("role") == role, sample), F.when(F.col("role") == role, rank)).alias(_slot(role))
        for role in K.ROLES
    ]


def metrics_of_roles(newest: DataFrame, keys: list[str]) -> DataFrame:
    """Workspace metrics from the newest sample of each role; NULL while offline.

    The sums become columns before they are rounded, so each is computed once.
    """
    slots = [_slot(r) for r in K.ROLES]

    def total(of) -> Column:
        return reduce(lambda a, b: a + b, [of(s) for s in slots])

    used = total(lambda s: real_memory(f"{s}.mem_usage", f"{s}.mem_cache"))
    limit = total(lambda s: or_zero(f"{s}.mem_limit"))
    cpu = total(lambda s: cpu_percent(f"{s}.cpu_delta", f"{s}.system_delta", f"{s}.nano_cpus"))
    online = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in slots])
    sums = newest.select(
        *keys,
        online.alias("online"),
        F.when(online, used).alias("used"),
        F.when(online, F.greatest(limit, F.lit(1).cast("bigint"))).alias("limit"),
        F.when(online, cpu).alias("cpu"),
    )
    ratios = sums.select(
        *keys, "online", "cpu",
        (F.col("used") / F.lit(BYTES_PER_MB)).alias("used_mb"),
        (F.col("limit") / F.lit(BYTES_PER_MB)).alias("limit_mb"),
        (F.col("used") / F.col("limit") * F.lit(100.0)).alias("percent"),
    )
    return ratios.select(
        *keys,
        F.when(F.col("online"), "online").otherwise("offline").alias("status"),
        clamp_100(round_2("cpu")).alias("cpu_percent"),
        round_2("used_mb").alias("memory_usage_mb"),
        round_2("limit_mb").alias("memory_limit_mb"),
        round_2("percent").alias("memory_percent"),
    )


def as_of(samples: DataFrame, at: Column, within: int | dict[str, int] = K.PRESENT_SECONDS, ts: str = "ts") -> DataFrame:
    """The samples that tell what was there at the instant ``at``: none later, and none older than ``within`` seconds.

    A container that is gone sends no samples, so a role whose newest one is older does not exist any more.
    ``within`` may differ by role; a role that it does not name counts with the bound of all, if there is one under ``""``.
    """
    bounds = within if isinstance(within, dict) else {"": within}
    seconds = F.lit(bounds.get("")).cast("int")
    for role, bound in bounds.items():
        if role:
            seconds = F.when(F.col("role") == role, F.lit(bound)).otherwise(seconds)
    oldest = at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return samples.where((F.col(ts) <= at) & (F.col(ts) >= oldest))


def workspace_metrics(samples: DataFrame, order: list[str], users: DataFrame | None = None) -> DataFrame:
    """Metrics of each user from the newest sample of the editor and the worker.

    Every task first cuts its samples to the newest of each user and role, so
    little is shuffled.  With ``users``, a user without samples is offline.  A sample counts however old it is; cut to
    an instant by ``as_of``, the samples give the metrics of the containers that exist then.
    """
    newest = newest_n(samples.where(F.col("role").isin(*K.ROLES)), ["usuario", "role"], order, 1)
    sample = F.struct(*SAMPLE_FIELDS)
    by_role = newest.groupBy("usuario").agg(
        *[F.any_value(F.when(F.col("role") == r, sample), ignoreNulls=True).alias(_slot(r)) for r in K.ROLES]
    )
    if users is not None:
        by_role = users.select("usuario").join(by_role, "usuario", "left")
    return metrics_of_roles(by_role, ["usuario"])


def online_status(samples: DataFrame, users: DataFrame) -> DataFrame:
    """Whether any container of each user was found: in all samples, or at an instant if they are cut by ``as_of``."""
    seen = samples.select("usuario").distinct().withColumn("found", F.lit(True))
    return users.select("usuario").join(seen, "usuario", "left").select(
        "usuario", F.when(F.col("found"), "online").otherwise("offline").alias("status")
    )


def last_n(samples: DataFrame, series: list[str], order: list[str], n: int = K.HISTORY_POINTS) -> DataFrame:
    """The newest ``n`` points of each series."""
    return newest_n(samples, series, order, n)


def counter_delta(
    samples: DataFrame, series: list[str], ts: str, order: list[str], counters: list[str], cell: str = "hour",
) -> DataFrame:
    """Each cumulative counter minus its previous value; the first counts from zero.

    Every series is cut into time cells, so a task orders one cell of a series and
    never a whole one.  The last values of each cell are found by an aggregate that
    combines in every task; over this small table each cell takes those of the cell
    before, and its first row counts from them.  ``order`` has to begin with ``ts``.
    """
    key = [*series, "_cell"]
    rows = samples.withColumn("_cell", F.date_trunc(cell, ts))
    ends = rows.groupBy(*key).agg(F.max_by(F.struct(*[or_zero(c).alias(c) for c in counters]), F.struct(*order)).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(W.partitionBy(*series).orderBy("_cell"))).drop("_end")
    renamed = before.select(*[F.col(k).alias(f"_of_{k}") for k in key], "_before")
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_of_{k}"]) for k in key])
    inside = W.partitionBy(*key).orderBy(*order)

    def step(c: str) -> Column:
        last = F.coalesce(F.lag(or_zero(c)).over(inside), F.col(f"_before.{c}"), or_zero(F.lit(None)))
        return (or_zero(c) - last).alias(f"{c}_step")

    return rows.join(renamed, same).select(*samples.columns, *[step(c) for c in counters])
