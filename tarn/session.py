"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the operators are written for.  All can be changed at run time.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Split hot keys of sort-merge joins and let the shuffle sizes pick the join.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Settings a stream takes over when it starts.
STREAM_SETTINGS = {
    # Merge sessions of one task before they are shuffled, so that a user with
    # very many heartbeats sends sessions and not heartbeats.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# State kept off the heap and recovered by change log.
ROCKSDB_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


@contextmanager
def stream_settings(spark: SparkSession, state_partitions: int | None = None) -> Iterator[None]:
    """Settings for streams started inside; the session gets its own back.

    The number of state partitions stays fixed for the life of a checkpoint and
    is never adapted, so by default there is one for each core of the cluster.
    All state goes to RocksDB, so that what is tested is what runs on a cluster.
    """
    wanted = {
        **STREAM_SETTINGS,
        **ROCKSDB_SETTINGS,
        "spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def local_session(
    cores: int | str = "*", name: str = "tarn", memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A single-machine session for tests and the bench; ``shared`` is its folder for what is written in between."""
    shuffle = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="tarn-"))
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path that every executor can reach, below ``spark.checkpoint.dir``.

    A session made elsewhere without that setting gets one only where driver and
    executors are one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
