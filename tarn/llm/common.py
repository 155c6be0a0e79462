"""Helpers the operators share: settings, shared folders, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A task holds about this much text of a batch at once; one longer text is a batch of its own.
BATCH_BYTES = 8 << 20

SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key of a join also where a later step has to deal the rows anew.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators are written for."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new one is set only where none is named."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="tarn-llm-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


# For rows of some MB: Parquet looks at the size of a page and of a row group only after 100 rows unless told otherwise,
# and writer and reader hold a whole row group and copies of its pages.
LARGE_ROWS = {
    "parquet.block.size": 8 << 20, "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def landed(df: DataFrame, purpose: str, **options) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a lost executor costs no recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``max_bytes`` in each; no row is left out."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = text_sizes(batch.column(batch.schema.get_field_index(column)))
        block = (np.cumsum(sizes) - sizes) // max_bytes
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], batch.num_rows]
        for a, b in zip(starts.tolist(), ends.tolist()):
            yield batch.slice(a, b - a)


def text_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; a null counts as empty."""
    sizes = pa.compute.binary_length(column.cast(pa.large_binary()))
    return np.asarray(sizes.fill_null(0), dtype=np.int64)


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null becomes an empty text."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, size: int = 4 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII blanks, in runs of about ``size`` bytes that end at a blank."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
