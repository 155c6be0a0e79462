"""Object listings."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.keys import below_folder
from ..session import work_dir

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("uploader", T.StringType()),
    ]
)


LISTING = "path string, folder boolean, size_bytes bigint, modified_ns bigint"


def _as_inventory(files: DataFrame, base: str) -> DataFrame:
    """Bucket and key from the path; a file outside any bucket is no object."""
    path = F.col("path")
    # A listed path may carry a scheme in front of the root, so cut behind it.
    below = F.substring(path, F.locate(base, path) + len(base), F.length(path))
    return files.select(
        F.substring_index(below, "/", 1).alias("bucket"),
        below_folder(below).alias("key"),
        "size_bytes",
        "last_modified",
        F.lit(None).cast("string").alias("uploader"),
    ).where(F.col("key").isNotNull())


def _plain_root(root: str) -> str:
    return re.sub(r"^file:/+", "/", root).rstrip("/")


def list_objects(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """Inventory of the files below ``root``, one bucket per first-level folder.

    Only file metadata is selected, so no content is read.  The file index of
    Spark leaves out empty files and names that begin with ``_`` or ``.``, and it
    holds all file names on the driver; ``walk_objects`` does neither.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    base = _plain_root(root) + "/"
    files = reader.load(base)
    return _as_inventory(
        files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified")), base
    )


# Entries of one record batch of a listing.
LISTED = 10_000


def _list_level(spark: SparkSession, folders: DataFrame, root: str) -> DataFrame:
    """The direct contents of each folder; every folder is listed by some task, in batches of ``LISTED``."""

    def contents(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        local = isinstance(store, fs.LocalFileSystem)
        for block in blocks:
            for path in block.column("path").to_pylist():
                found = _local_entries(path) if local else _store_entries(store, path)
                while part := list(islice(found, LISTED)):
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(("path", "folder", "size_bytes", "modified_ns"), e)) for e in part],
                        pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size_bytes", pa.int64()), ("modified_ns", pa.int64())]))

    tasks = spark.sparkContext.defaultParallelism
    return folders.repartition(tasks, "path").mapInArrow(contents, LISTING)


def _local_entries(path: str) -> Iterator[tuple]:
    """Entries one by one, so a folder of any length needs no memory."""
    with os.scandir(path) as entries:
        for e in entries:
            stat = e.stat()
            yield e.path, e.is_dir(), None if e.is_dir() else stat.st_size, stat.st_mtime_ns


def _store_entries(store, path: str) -> Iterator[tuple]:
    for f in store.get_file_info(fs.FileSelector(path)):
        yield f.path, f.type == fs.FileType.Directory, f.size, f.mtime_ns


def _store_root(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    uri = re.sub(r"^s3[an]://", "s3://", _plain_root(root))
    inside = re.sub(r"^[a-z0-9+]+://", "", uri)
    return uri, spark.range(1).select(F.lit(inside).alias("path"))


def list_buckets(spark: SparkSession, root: str) -> DataFrame:
    """All first-level folders of ``root``, empty ones too."""
    uri, top = _store_root(spark, root)
    return _list_level(spark, top, uri).where("folder").select(F.substring_index("path", "/", -1).alias("bucket"))


def walk_objects(spark: SparkSession, root: str, bucket: str | None = None) -> DataFrame:
    """Complete inventory below ``root``, with empty files and every name; of one bucket if it is named.

    Goes down one folder level at a time: each level is a Spark job whose tasks
    list the folders the level above has found.  The levels are written to the
    work folder, so a lost executor costs one listing and no names pass through
    the driver.
    """
    uri, level = _store_root(spark, root)
    base = re.sub(r"^[a-z0-9+]+://", "", uri) + "/"
    if bucket:
        level = level.select(F.concat("path", F.lit(f"/{bucket}")).alias("path"))
    out, depth = work_dir(spark, "listing"), 0
    while depth == 0 or not level.isEmpty():
        _list_level(spark, level, uri).write.parquet(f"{out}/depth={depth}")
        level = spark.read.parquet(f"{out}/depth={depth}").where("folder").select("path")
        depth += 1
    files = spark.read.parquet(out).where(~F.col("folder"))
    modified = F.timestamp_micros((F.col("modified_ns") / F.lit(1000)).cast("bigint")).alias("last_modified")
    return _as_inventory(files.select("path", "size_bytes", modified), base)


def read_inventory(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A landed listing in Parquet, CSV or JSON; the schema is never inferred.

    A CSV must have all columns in the order of the schema; one with another
    header is refused rather than read by position.
    """
    reader = spark.read.format(fmt).schema(INVENTORY_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.load(path)


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of all image files below ``root``, whatever their names begin with; no pixels are read."""
    return walk_objects(spark, root).where(F.lower("key").rlike(rf"\.({'|'.join(K.IMAGE_EXTENSIONS)})$"))
