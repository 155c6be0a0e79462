"""Tables with a key: last write wins, and delete by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_n(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n`` rows of each key that come last in ``order``.

    Spark limits every key to ``n`` rows within each task before it shuffles,
    so a key with very many rows arrives as ``n`` rows per task at most.
    """
    newest_first = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return (
        df.withColumn("_position", F.row_number().over(newest_first))
        .where(F.col("_position") <= n)
        .drop("_position")
    )


def latest_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return newest_n(df, key, order, 1)


def upsert_latest(base: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write of each key over both inputs; neither needs unique keys."""
    return latest_by_key(base.unionByName(updates), key, order)


def _same_key(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    """Whether two rows have one key; NULLs are equal, as they are in a grouping."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_of_{k}"]) for k in key])


def merge_updates(base: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Same as ``upsert_latest`` for a base that holds each key once, NULL keys included.

    The base is joined and never re-sorted as a whole: with few updates Spark
    sees their size and broadcasts them, and the base is not shuffled.  A tie in
    ``order`` goes to the update.
    """
    def named(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_of_{k}") for k in key], *more)

    newest = latest_by_key(updates, key, order)
    rank = F.struct(*order)
    marks = named(newest, rank.alias("_update_rank"))
    kept = (
        base.join(marks, _same_key(base, marks, key), "left")
        .where(F.col("_update_rank").isNull() | (rank > F.col("_update_rank")))
        .select(*[base[c] for c in base.columns])
    )
    ranked = base.select(*key, rank.alias("_base_rank"))
    beaten = named(ranked.join(marks, _same_key(ranked, marks, key)).where(F.col("_base_rank") > F.col("_update_rank")).select(*key))
    won = newest.join(beaten, _same_key(newest, beaten, key), "left_anti")
    return kept.unionByName(won.select(*base.columns))


def key_changes(base: DataFrame, updates: DataFrame, key: list[str], order: list[str], ties: bool = True) -> DataFrame:
    """``before`` and ``after`` of every key that the updates change, as structs; a new key has no ``before``.

    ``base`` holds each key once.  A tie in ``order`` goes to the update, or with ``ties`` off changes nothing.
    """
    newest = latest_by_key(updates.select(*base.columns), key, order)
    after = newest.select(*[F.col(k).alias(f"_of_{k}") for k in key], F.struct(*newest.columns).alias("after"))
    before = base.select(*key, F.struct(*base.columns).alias("before"))
    both = after.join(before, _same_key(before, after, key), "left").select("before", "after")
    rank = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in order])
    newer = rank("after") >= rank("before") if ties else rank("after") > rank("before")
    return both.where(F.col("before").isNull() | newer)


def delete_keys(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``base`` whose key is not listed; unknown keys change nothing.

    The right side of an anti join cannot be split, so it holds each key once.
    """
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def cancel(registry: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining rows, removed rows, and the listed keys that matched nothing."""
    asked = keys.select(*key).distinct()
    return (
        delete_keys(registry, asked, key),
        registry.join(asked, key, "left_semi"),
        asked.join(registry.select(*key).distinct(), key, "left_anti"),
    )
