"""Expressions over resource counters and application states."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import as_col
from .rounding import hundredths

BYTES_PER_MB = float(1024**2)


def or_zero(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0).cast("bigint"))


def real_memory(usage: Column | str, cache: Column | str) -> Column:
    """Memory in use without the page cache, never below zero."""
    return F.greatest(F.lit(0).cast("bigint"), or_zero(usage) - or_zero(cache))


def cpu_sample_valid(cpu_delta: Column | str, system_delta: Column | str) -> Column:
    return (or_zero(cpu_delta) > 0) & (or_zero(system_delta) > 0)


def allocated_cores(nano_cpus: Column | str) -> Column:
    nano = or_zero(nano_cpus)
    return F.when(nano > 0, nano / F.lit(float(K.NANO))).otherwise(F.lit(K.DEFAULT_CORES))


def cpu_percent(cpu_delta: Column | str, system_delta: Column | str, nano_cpus: Column | str) -> Column:
    """Share of the allocated cores used since the last sample, in percent."""
    share = or_zero(cpu_delta) / F.nullif(or_zero(system_delta).cast("double"), F.lit(0.0))
    percent = share * F.lit(100.0) / allocated_cores(nano_cpus)
    return F.when(cpu_sample_valid(cpu_delta, system_delta), percent).otherwise(F.lit(0.0))


def clamp_100(x: Column | str) -> Column:
    # Not least(): that would turn a missing value into the limit.
    c = as_col(x)
    return F.when(c > K.MAX_PERCENT, K.MAX_PERCENT).otherwise(c)


def to_gb(size_bytes: Column | str) -> Column:
    """Gigabytes with two decimals, from whole bytes."""
    return hundredths(size_bytes, F.lit(30)) / F.lit(100.0)


def to_cores(nano_cpus: Column | str) -> Column:
    return as_col(nano_cpus) / F.lit(float(K.NANO))


def app_state_class(state: Column | str) -> Column:
    s = as_col(state)
    return F.when(s == K.GOOD_STATE, "good").when(s.isin(*K.BAD_STATES), "bad").otherwise("pending")


def job_state_class(status: Column | str) -> Column:
    s = as_col(status)
    return F.when(s == "SUCCEEDED", "succeeded").when(s == "RUNNING", "running").otherwise("other")


def task_total(num_tasks: Column | str) -> Column:
    n = as_col(num_tasks)
    return F.coalesce(F.nullif(n, F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))


def task_percent(done: Column | str, num_tasks: Column | str) -> Column:
    return or_zero(done) / task_total(num_tasks) * F.lit(100.0)


def profile_spec(profile: Column | str) -> Column:
    """Cores and memory of a profile; any unknown name means the first one."""
    def spec(row: tuple) -> Column:
        _, cores, editor_gb, worker_gb, _, _ = row
        return F.struct(
            F.lit(cores).cast("bigint").alias("cores"),
            F.lit(editor_gb).cast("bigint").alias("editor_gb"),
            F.lit(worker_gb).cast("bigint").alias("worker_gb"),
        )

    default, *others = K.PROFILES
    chain = None
    for row in others:
        hit = as_col(profile) == row[0]
        chain = F.when(hit, spec(row)) if chain is None else chain.when(hit, spec(row))
    return chain.otherwise(spec(default))
