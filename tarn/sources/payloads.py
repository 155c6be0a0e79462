"""Landed JSON payloads: container statistics, cluster snapshots, driver jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.usage import or_zero

_CPU = "STRUCT<cpu_usage: STRUCT<total_usage: BIGINT>, system_cpu_usage: BIGINT>"

STATS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, usuario STRING, role STRING, nano_cpus BIGINT, "
    "stats STRUCT<memory_stats: STRUCT<usage: BIGINT, `limit`: BIGINT, stats: STRUCT<cache: BIGINT>>, "
    f"cpu_stats: {_CPU}, precpu_stats: {_CPU}>"
)

_WORKER = (
    "STRUCT<id: STRING, host: STRING, port: BIGINT, cores: BIGINT, coresused: BIGINT, "
    "memory: BIGINT, memoryused: BIGINT>"
)
_APP = (
    "STRUCT<id: STRING, name: STRING, user: STRING, cores: BIGINT, memoryperslave: BIGINT, "
    "duration: BIGINT, state: STRING, starttime: BIGINT>"
)

SNAPSHOT_SCHEMA = (
    f"snapshot_id BIGINT, url STRING, workers ARRAY<{_WORKER}>, activeapps ARRAY<{_APP}>, completedapps ARRAY<{_APP}>"
)

JOBS_SCHEMA = (
    "jobs ARRAY<STRUCT<jobId: BIGINT, name: STRING, status: STRING, numTasks: BIGINT, "
    "numCompletedTasks: BIGINT, numActiveTasks: BIGINT>>"
)

# Where the driver's interface keeps an application's id in the path of its jobs.
APP_IN_PATH = r"/applications/([^/]+)/"

_BROKEN = "_broken"


def read_texts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Payload texts with their file: each file is one payload, as services send it, or with ``lines`` each line."""
    return with_files(spark.read.option("recursiveFileLookup", True).text(path, wholetext=not lines))


def with_files(texts: DataFrame) -> DataFrame:
    return texts.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.unix_millis(F.col("_metadata.file_modification_time")).alias("arrived"),
    ).where(F.trim("value") != "")


def parsed(texts: DataFrame, schema: str, value: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Payloads that fit ``schema``, as its columns after ``file`` and ``arrived``; and the others as they came.

    A text that is cut off, or has a value of another type anywhere, is broken as a whole:
    its missing parts would read as zeros.
    """
    shape = f"{schema}, {_BROKEN} STRING"
    body = F.col("value") if value is None else value
    read = texts.withColumn("_p", F.from_json(body, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
    good = F.col("_p").isNotNull() & F.col(f"_p.{_BROKEN}").isNull()
    return (
        read.where(good).select("file", "arrived", "_p.*").drop(_BROKEN),
        read.where(~good).select("file", "value"),
    )


def read_container_stats(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row per container sample, every missing level as zero; and the broken payloads."""
    raw, broken = parsed(read_texts(spark, path, lines), STATS_SCHEMA)
    return flatten_container_stats(raw), broken


def flatten_container_stats(raw: DataFrame) -> DataFrame:
    def stat(name: str) -> Column:
        return or_zero(F.col(f"stats.{name}"))

    return raw.select(
        "event_id", "ts", "usuario", "role",
        stat("memory_stats.usage").alias("mem_usage"),
        stat("memory_stats.stats.cache").alias("mem_cache"),
        stat("memory_stats.limit").alias("mem_limit"),
        (stat("cpu_stats.cpu_usage.total_usage") - stat("precpu_stats.cpu_usage.total_usage")).alias("cpu_delta"),
        (stat("cpu_stats.system_cpu_usage") - stat("precpu_stats.system_cpu_usage")).alias("system_delta"),
        or_zero("nano_cpus").alias("nano_cpus"),
    )


def snapshots_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polls from payload texts, streams included; and the broken ones.

    A poll without a number takes the time its file arrived, and one without a master's address the folder of its file.
    """
    raw, broken = parsed(texts, SNAPSHOT_SCHEMA)
    master = F.coalesce("url", F.try_element_at(F.split("file", "/"), F.lit(-2)))
    return raw.withColumns({"snapshot_id": F.coalesce("snapshot_id", "arrived"), "master": master}).drop("file", "arrived", "url"), broken


def snapshot_workers(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("snapshot_id", F.explode("workers").alias("w")).select(
        "snapshot_id", "w.id", "w.host", "w.port", "w.cores", "w.coresused", "w.memory", "w.memoryused"
    )


def app_pictures(snapshots: DataFrame) -> DataFrame:
    """One row for each poll of a master, with all its applications, active and completed, under the names the operators take."""
    empty = F.array().cast(f"ARRAY<{_APP}>")

    def marked(column: str, active: bool) -> Column:
        return F.transform(F.coalesce(F.col(column), empty), lambda a: F.struct(
            F.lit(active).alias("active"), a["id"].alias("app_id"), a["name"].alias("name"), a["user"].alias("user_id"),
            a["cores"].alias("cores"), a["memoryperslave"].alias("memoryperslave"), a["state"].alias("state"),
            a["duration"].alias("duration_ms"), F.timestamp_millis(a["starttime"]).alias("start_ts")))

    return snapshots.select("master", "snapshot_id", F.concat(marked("activeapps", True), marked("completedapps", False)).alias("apps"))


def pictured_apps(pictures: DataFrame) -> DataFrame:
    """The applications of each picture; an empty picture has none."""
    return pictures.select("master", "snapshot_id", F.inline("apps"))


def snapshot_apps(snapshots: DataFrame) -> DataFrame:
    """All applications of all polls."""
    return pictured_apps(app_pictures(snapshots)).drop("master")


def active_apps(apps: DataFrame) -> DataFrame:
    return apps.where("active").select("snapshot_id", "app_id", "name", "user_id", "cores", "memoryperslave", "duration_ms")


def completed_apps(apps: DataFrame) -> DataFrame:
    return apps.where(~F.col("active")).select("snapshot_id", "app_id", "name", "user_id", "state", "duration_ms", "start_ts")


def read_cluster_snapshots(
    spark: SparkSession, path: str, lines: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Workers, active and completed applications, a missing array as empty; and the broken payloads."""
    raw, broken = snapshots_of(read_texts(spark, path, lines))
    apps = snapshot_apps(raw)
    return snapshot_workers(raw), active_apps(apps), completed_apps(apps), broken


def read_app_jobs(
    spark: SparkSession, path: str, app_in_path: str = APP_IN_PATH, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """One row per job of every application; and the broken payloads.

    A payload is the array of an application's jobs; the application is named in the path of the file.
    """
    texts = read_texts(spark, path, lines)
    raw, broken = parsed(texts, JOBS_SCHEMA, F.concat(F.lit('{"jobs": '), F.col("value"), F.lit("}")))
    app = F.url_decode(F.regexp_extract("file", app_in_path, 1))
    return raw.select(app.alias("app_id"), F.explode("jobs").alias("j")).select(
        "app_id",
        F.col("j.jobId").alias("job_id"),
        F.col("j.name").alias("job_name"),
        F.col("j.status").alias("status"),
        F.col("j.numTasks").alias("num_tasks"),
        F.col("j.numCompletedTasks").alias("completed_raw"),
        F.col("j.numActiveTasks").alias("active_raw"),
    ), broken


def first_driver_app(payloads: DataFrame, apps: str = "apps") -> DataFrame:
    """Id of the first application a driver reports; NULL when it reports none."""
    return payloads.withColumn(
        "driver_app_id", F.when(F.size(apps) > 0, F.try_element_at(F.col(apps), F.lit(1))["id"])
    ).drop(apps)
