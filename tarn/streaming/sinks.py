"""Starting and ending streams.  Results go to shared files, never to the driver."""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import stream_settings
from ..sources.landing import BUCKETS, committed, land


def read_files(
    spark: SparkSession, path: str, fmt: str = "parquet", schema=None, max_files: int | None = None, **options
) -> DataFrame:
    """A stream of the files at ``path``; Parquet takes its schema from a footer."""
    shape = schema if schema is not None else spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(shape).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def drop_stream(
    spark: SparkSession, drop_path: str, bucket: str, uploader: str, max_files: int | None = None, max_age: str = "30d"
) -> DataFrame:
    """Inventory rows of the files that arrive in and below a drop folder, under their bare names; contents are not read.

    The checkpoint knows which files were seen, so a poll asks neither the table nor again for old files.  It forgets
    what lies more than ``max_age`` behind the newest file, and such a file does not count as new either.
    As with any Spark reader, empty files and names that begin with a dot or an underscore are not there.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFileAge", max_age).schema(
        "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(drop_path).select(
        F.lit(bucket).alias("bucket"), F.substring_index("path", "/", -1).alias("key"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"), F.lit(uploader).alias("uploader"))


def append_files(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Append final rows to Parquet files; without ``every`` it stops when caught up."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    with stream_settings(stream.sparkSession):
        return _triggered(writer, every).start(path)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id of the query that the checkpoint belongs to, as Spark keeps it there; it lives as long as the batch numbers do."""
    try:
        text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(text[0])["id"]


def land_latest(
    stream: DataFrame, table: str, checkpoint: str, key: list[str], order: list[str],
    mode: str = "update", every: str | None = None, keyed: bool = False, buckets: int = BUCKETS, forget: str | None = None,
    on_changes=None,
) -> StreamingQuery:
    """Merge each micro-batch into a landed table under its number.

    A micro-batch that runs again writes the same buckets again, or nothing if it was done.  The table
    belongs to the checkpoint, as the batch numbers come from it; a stream with another one is refused.  With
    ``keyed`` the stream gives each key once per batch already; ``forget`` and ``on_changes`` are those of ``land``.
    """
    spark = stream.sparkSession
    last = committed(spark, table)
    if last is not None and last["owner"] != checkpoint_id(spark, checkpoint):
        raise ValueError(f"{table} belongs to another checkpoint; this one would number its batches anew")

    def merge(batch: DataFrame, batch_id: int) -> None:
        owner = checkpoint_id(batch.sparkSession, checkpoint)
        land(batch, table, key, order, batch_id, owner, buckets, keyed, forget, on_changes)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(merge)
    with stream_settings(spark):
        return _triggered(writer, every).start()


def _triggered(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def finish(query: StreamingQuery) -> None:
    """Wait for a stream that stops when caught up, and raise its error if any."""
    query.awaitTermination()


def until_quiet(query: StreamingQuery, seconds: float = 600, rows_left: int = 0) -> None:
    """Stop a stream once it has read something and its state holds no more than ``rows_left`` rows; raise when that takes too long."""
    end, rows = time.monotonic() + seconds, 0
    while time.monotonic() < end:
        if query.exception() is not None:
            raise query.exception()
        for progress in query.recentProgress:
            rows = max(rows, progress["numInputRows"])
        last = query.lastProgress
        if rows and last and not last["numInputRows"] and all(s["numRowsTotal"] <= rows_left for s in last["stateOperators"]):
            query.stop()
            return
        time.sleep(0.3)
    query.stop()
    raise TimeoutError(f"state is still held after {seconds} s: {query.lastProgress}")
