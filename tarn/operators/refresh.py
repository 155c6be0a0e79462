"""Layers kept up to date batch by batch: silver by key, gold by the differences of the keys that changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.landing import BUCKETS, land, read_buckets
from .layers import to_silver

ROWS, VERSION, EMPTY = "rows", "version", "empty"


def gold_steps(changes: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """What the changed rows add to each group: ``rows`` and the named sums of their rows after minus those before.

    ``sums`` gives an expression over the row for each name; a null counts as zero.
    """
    def side(name: str, sign: int) -> DataFrame:
        row = changes.where(F.col(name).isNotNull()).select(f"{name}.*")
        measures = [(F.coalesce(F.expr(e), F.lit(0)) * sign).alias(n) for n, e in sums.items()]
        return row.select(*keys, F.lit(sign).cast("bigint").alias(ROWS), *measures)

    both = side("after", 1).unionByName(side("before", -1))
    steps = both.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in (ROWS, *sums)])
    return steps.where(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in (ROWS, *sums)]))


def land_gold(steps: DataFrame, table: str, keys: list[str], sums: dict[str, str], batch_id: int, owner: str = "", buckets: int = BUCKETS) -> bool:
    """Add the steps to the groups of a landed table; a group without rows leaves it.

    Of the table only the buckets of the groups that change are read.
    """
    names = [ROWS, *sums]
    steps = steps.persist()
    try:
        now = read_buckets(steps.sparkSession, table, steps, keys)
        added = steps
        if now is not None:
            old = now.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[F.col(n).alias(f"_{n}") for n in names])
            same = reduce(lambda a, b: a & b, [steps[k].eqNullSafe(old[f"_of_{k}"]) for k in keys])
            added = steps.join(old, same, "left").select(
                *keys, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).cast(steps.schema[n].dataType).alias(n) for n in names])
        stamped = added.withColumn(VERSION, F.lit(batch_id).cast("bigint")).withColumn(EMPTY, F.col(ROWS) == 0)
        return land(stamped, table, keys, [VERSION], batch_id, owner, buckets, keyed=True, forget=EMPTY)
    finally:
        steps.unpersist()


def read_gold(gold: DataFrame) -> DataFrame:
    return gold.where(~F.col(EMPTY)).drop(VERSION, EMPTY)


def refresh(
    bronze: DataFrame, silver: str, gold: str, columns: dict[str, str], key: list[str], order: list[str],
    groups: list[str], sums: dict[str, str], batch_id: int, owner: str = "", buckets: int = BUCKETS,
) -> DataFrame:
    """Bring both landed tables up to date with one batch of raw rows; and the rows that do not fit.

    Silver reads and writes the buckets of the batch's keys; each changed key's row before and after goes into gold as a
    difference.  Gold lands under the same number first, so a batch that is run again after a failure
    finds either both to do or silver alone.
    """
    rows, failed = to_silver(bronze, columns, key, order)

    def to_gold(changes: DataFrame, number: int) -> None:
        land_gold(gold_steps(changes, groups, sums), gold, groups, sums, number, owner, buckets)

    land(rows, silver, key, order, batch_id, owner, buckets, keyed=True, on_changes=to_gold)
    return failed
