"""Free capacity of hosts and the hardware profiles that still fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.usage import or_zero, profile_spec, to_cores, to_gb


def running(containers: DataFrame) -> DataFrame:
    return containers.where(F.col("status") == K.RUNNING)


def workspace_containers(containers: DataFrame) -> DataFrame:
    name = F.col("name")
    return containers.where(name.startswith(K.EDITOR_PREFIX) | name.startswith(K.WORKER_PREFIX))


def find_first(containers: DataFrame, text: str, by: list[str]) -> DataFrame:
    """First running container, by name, whose name contains ``text``, per group."""
    return (
        running(containers)
        .where(F.col("name").contains(text))
        .groupBy(*by)
        .agg(F.min("name").alias("name"))
    )


def reserved(containers: DataFrame) -> DataFrame:
    """Cores and memory reserved by running workspaces, per host."""
    return (
        workspace_containers(running(containers))
        .groupBy("host_id")
        .agg(
            F.sum(or_zero("nano_cpus")).alias("reserved_nano"),
            F.sum(or_zero("mem_limit_bytes")).alias("reserved_bytes"),
        )
    )


def host_capacity(hosts: DataFrame, containers: DataFrame) -> DataFrame:
    """Total, reserved and free cores and memory; never below zero.

    Containers are summed per host before the join, so the join sees one row
    per host on either side.
    """
    zero = F.lit(0).cast("bigint")
    joined = hosts.join(reserved(containers), "host_id", "left")
    nano = F.coalesce("reserved_nano", zero)
    used = F.coalesce("reserved_bytes", zero)
    free_nano = F.greatest(zero, F.col("total_cpus") * F.lit(K.NANO).cast("bigint") - nano)
    free_bytes = F.greatest(zero, F.col("total_mem_bytes") - used)
    return joined.select(
        "host_id",
        "total_cpus",
        to_gb("total_mem_bytes").alias("total_mem_gb"),
        to_cores(nano).alias("allocated_cpus"),
        to_gb(used).alias("allocated_mem_gb"),
        to_cores(free_nano).alias("available_cpus"),
        to_gb(free_bytes).alias("available_mem_gb"),
    )


def _profiles():
    """The profiles as a constant array, so no join is needed to try them all."""
    rows = [
        F.struct(
            F.lit(name).alias("profile"),
            F.lit(float(cores)).alias("need_cpus"),
            F.lit(float(gb)).alias("need_mem_gb"),
        )
        for name, _, _, _, cores, gb in K.PROFILES
    ]
    return F.array(*rows)


def profile_fit(capacity: DataFrame) -> DataFrame:
    """Every profile tested against the free resources of every host."""
    fits = (F.col("available_cpus") >= F.col("p.need_cpus")) & (
        F.col("available_mem_gb") >= F.col("p.need_mem_gb")
    )
    return capacity.withColumn("p", F.explode(_profiles())).select(
        "host_id", "p.profile", "available_cpus", "available_mem_gb", fits.alias("fits")
    )


def eligible(capacity: DataFrame, profile: str) -> DataFrame:
    """Hosts that can still take ``profile``."""
    return profile_fit(capacity).where((F.col("profile") == profile) & F.col("fits")).drop("fits")


def with_profile_spec(df: DataFrame, profile: str = "profile") -> DataFrame:
    return df.withColumn("spec", profile_spec(profile)).select("*", "spec.*").drop("spec")
