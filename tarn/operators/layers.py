"""From raw to refined to aggregated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import default_uploader
from .keyed import latest_by_key


def typed_rows(bronze: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose texts all fit their types, typed; and the others as they came, with the names in ``failed``.

    ``columns`` names the columns to keep and their types.
    """
    cast = {c: F.col(c).try_cast(t) for c, t in columns.items()}
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), c) for c, v in cast.items()]))
    marked = bronze.withColumn("failed", bad)
    good = marked.where(F.size("failed") == 0).select(*[v.alias(c) for c, v in cast.items()])
    return good, marked.where(F.size("failed") > 0)


def to_silver(
    bronze: DataFrame, columns: dict[str, str], keys: list[str], order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Typed columns, a default uploader and the last write of each key; and the rows that do not fit.

    A row with a value that does not fit its type has no sure key, so it is kept
    apart before the keyed cut and replaces nothing.
    """
    typed, failed = typed_rows(bronze, columns)
    if "uploader" in columns:
        typed = typed.withColumn("uploader", default_uploader("uploader"))
    return latest_by_key(typed, keys, order), failed


def to_gold(silver: DataFrame, keys: list[str | Column], measures: list[Column]) -> DataFrame:
    return silver.groupBy(*keys).agg(*measures)


def write_layer(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a layer as Parquet; rows of one partition value share files.

    Partition values may be very uneven, so the rows are spread by Spark's
    rebalance, which splits a large value over several tasks.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
