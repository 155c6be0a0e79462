"""Landed tables: the last write of each key, in buckets of the key's hash.

    <table>/rows/landing_bucket=<b>/landing_slot=<0 or 1>   the rows of one bucket as of one batch
    <table>/commits/landing_slot=<0 or 1>                   number, owner and buckets of the last two batches

A batch rewrites the buckets of its own keys and no others.  Each of them is read from the slot that holds it and
written to the other one, by Spark's overwrite of single partitions, and at last the number of the batch is written the
same way.  Readers take from each bucket the newest slot that is not newer than the last number, so a batch that
was cut off changes nothing, and running it again writes the same slots again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import key_changes, latest_by_key
from .inventory import walk_objects

BUCKET, SLOT, BATCH = "landing_bucket", "landing_slot", "landing_batch"
BUCKETS = 64


def _write(df: DataFrame, path: str, *partition: str) -> None:
    """Replace the partitions that ``df`` has rows of."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*partition).parquet(path)


def committed(spark: SparkSession, table: str) -> Row | None:
    """Number, owner and buckets of the last batch, if any."""
    try:
        marks = spark.read.schema(f"batch BIGINT, owner STRING, buckets INT, {SLOT} INT").parquet(f"{table.rstrip('/')}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.orderBy(F.desc("batch")).first()


def _commit(spark: SparkSession, table: str, batch_id: int, owner: str, buckets: int) -> None:
    mark = spark.range(1).select(
        F.lit(batch_id).cast("bigint").alias("batch"), F.lit(owner).alias("owner"), F.lit(buckets).alias("buckets"),
        F.lit(batch_id % 2).alias(SLOT))
    _write(mark, f"{table.rstrip('/')}/commits", SLOT)


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _slots(rows: DataFrame, until: int) -> dict[int, int]:
    """The slot of each bucket that holds it as of batch ``until``: at most two rows for each bucket."""
    found = rows.where(F.col(BATCH) <= until).groupBy(BUCKET, SLOT).agg(F.max(BATCH).alias("n")).collect()
    return {r[BUCKET]: r[SLOT] for r in sorted(found, key=lambda r: r["n"])}


def _in_slots(slots: dict[int, int]) -> Column:
    """A filter on partitions alone."""
    picked = F.lit(False)
    for slot in (0, 1):
        of = sorted(b for b, s in slots.items() if s == slot)
        if of:
            picked = picked | ((F.col(SLOT) == slot) & F.col(BUCKET).isin(of))
    return picked


def read_landed(spark: SparkSession, table: str) -> DataFrame:
    """The rows as of the last batch, one for each key."""
    last = committed(spark, table)
    if last is None:
        raise ValueError(f"nothing has landed in {table}")
    rows = spark.read.parquet(f"{table.rstrip('/')}/rows")
    return rows.where(_in_slots(_slots(rows, last["batch"]))).drop(BUCKET, SLOT, BATCH)


def read_latest(spark: SparkSession, table: str, key: list[str], order: list[str]) -> DataFrame:
    """The last write of every key; a later batch wins a tie.  The table holds each key once, as ``land`` has merged it."""
    return read_landed(spark, table)


def read_buckets(spark: SparkSession, table: str, keys: DataFrame, key: list[str]) -> DataFrame | None:
    """The rows of the buckets that the given keys fall into; None if nothing has landed yet."""
    last = committed(spark, table)
    if last is None:
        return None
    rows = spark.read.parquet(f"{table.rstrip('/')}/rows")
    touched = [r[0] for r in keys.select(_bucket(key, last["buckets"])).distinct().collect()]
    slots = _slots(rows.where(F.col(BUCKET).isin(touched)), last["batch"])
    return rows.where(_in_slots(slots)).drop(BUCKET, SLOT, BATCH)


def land(
    df: DataFrame, table: str, key: list[str], order: list[str], batch_id: int, owner: str = "", buckets: int = BUCKETS,
    keyed: bool = False, forget: str | None = None, on_changes=None,
) -> bool:
    """Merge one batch into the table; False if that batch, or a later one, is in it already.

    With ``keyed`` the batch gives each key once already.  Rows whose column ``forget`` is true leave the table when
    their bucket is rewritten the next time.  ``on_changes`` gets the changed keys, each with its row before and
    after, before the batch counts; it has to bear being run again.  A table belongs to the ``owner`` of its first batch.
    """
    spark, root = df.sparkSession, table.rstrip("/")
    last = committed(spark, table)
    if last is not None and last["owner"] != owner:
        raise ValueError(f"{table} belongs to {last['owner']!r}; {owner!r} would number its batches anew")
    if last is not None and batch_id <= last["batch"]:
        return False
    buckets = last["buckets"] if last is not None else buckets
    # Read twice: once for the names of the buckets, once for the rows.
    news = (df if keyed else latest_by_key(df, key, order)).withColumn(BUCKET, _bucket(key, buckets)).persist()
    try:
        touched = [r[0] for r in news.select(BUCKET).distinct().collect()]
        if touched:
            slots: dict[int, int] = {}
            base = news.limit(0)
            if last is not None:
                rows = spark.read.parquet(f"{root}/rows")
                slots = _slots(rows.where(F.col(BUCKET).isin(touched)), last["batch"])
                base = rows.where(_in_slots(slots)).drop(SLOT, BATCH).select(*news.columns)
            if forget:
                base = base.where(~F.col(forget))
            if on_changes is not None:
                on_changes(key_changes(base.drop(BUCKET), news.drop(BUCKET), key, order), batch_id)
            both = base.withColumn("_landed", F.lit(0)).unionByName(news.withColumn("_landed", F.lit(1)))
            merged = latest_by_key(both, key, [*order, "_landed"]).drop("_landed")
            other = F.create_map(*[F.lit(x) for b in touched for x in (b, 1 - slots.get(b, 1))])
            placed = merged.withColumn(SLOT, other[F.col(BUCKET)]).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
            _write(placed.hint("rebalance", BUCKET), f"{root}/rows", BUCKET, SLOT)
        if touched or last is not None:
            _commit(spark, table, batch_id, owner, buckets)
    finally:
        news.unpersist()
    return True


def land_objects(
    df: DataFrame, table: str, uploader: str, key: list[str], order: list[str], batch_id: int
) -> None:
    """Land arrivals with their uploader as the batch of that number.

    Landing the same rows again under their number changes nothing; under a number that is taken, rows that the table
    has not seen are refused, as they would be lost.
    """
    arrivals = df.withColumn("uploader", F.lit(uploader))
    if not land(arrivals, table, key, order, batch_id):
        known = read_landed(df.sparkSession, table)
        if not key_changes(known, arrivals, key, order, ties=False).isEmpty():
            raise ValueError(f"{table} is past batch {batch_id} and has not seen all of these rows")


def dropped_files(spark: SparkSession, drop_path: str, bucket: str, uploader: str) -> DataFrame:
    """Inventory rows for all files in and below a drop folder, under their bare names.

    Empty files and every name are listed.
    """
    folder = drop_path.rstrip("/")
    above, _, name = folder.rpartition("/")
    found = walk_objects(spark, above, name)
    return found.select(
        F.lit(bucket).alias("bucket"),
        F.substring_index("key", "/", -1).alias("key"),
        "size_bytes", "last_modified",
        F.lit(uploader).alias("uploader"),
    )


def land_drops(
    spark: SparkSession, drop_path: str, table: str, bucket: str, uploader: str, batch_id: int
) -> None:
    """Land the files of a drop folder that the table does not have yet, as a job run at every poll.

    A file counts as new if its key is, or if it was changed after the landed one.  ``drop_stream`` knows what is
    new without looking at the table.
    """
    key, order = ["bucket", "key"], ["last_modified"]
    arrivals = dropped_files(spark, drop_path, bucket, uploader)
    if committed(spark, table) is not None:
        known = read_landed(spark, table).select(*key, F.col("last_modified").alias("_landed")).hint("rebalance")
        arrivals = arrivals.join(known, key, "left").where(
            F.col("_landed").isNull() | (F.col("last_modified") > F.col("_landed"))).drop("_landed")
    land_objects(arrivals, table, uploader, key, order, batch_id)
