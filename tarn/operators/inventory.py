"""Browsing an object inventory: buckets, folders, datasets, details."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keys as X
from ..functions import text as T


def visible_objects(inv: DataFrame) -> DataFrame:
    return inv.where(~X.is_hidden("key"))


def in_bucket(inv: DataFrame, bucket: str) -> DataFrame:
    return inv.where(F.col("bucket") == bucket)


def root_objects(inv: DataFrame, bucket: str | None = None) -> DataFrame:
    """Objects outside any folder, of one bucket or of all."""
    scope = inv if bucket is None else in_bucket(inv, bucket)
    return scope.where(~F.col("key").contains("/"))


def folder_objects(inv: DataFrame, bucket: str, folder: str) -> DataFrame:
    """Objects below one folder, shown by the rest of their key."""
    prefix = folder + "/"
    return (
        in_bucket(inv, bucket)
        .where(F.col("key").startswith(prefix))
        .withColumn("display", F.substring(F.col("key"), len(prefix) + 1, 2**31 - 1))
    )


def folders(inv: DataFrame) -> DataFrame:
    return (
        inv.where(F.col("key").contains("/"))
        .select("bucket", X.top_folder("key").alias("folder"))
        .distinct()
    )


def _in_folders(inv: DataFrame) -> DataFrame:
    nested = inv.where(F.col("key").contains("/"))
    return nested.withColumn("folder", X.top_folder("key")).withColumn("remainder", X.below_folder("key"))


def datasets(inv: DataFrame) -> DataFrame:
    """One row per dataset: its first key, number of objects and total size."""
    parts = _in_folders(inv).where(X.is_dataset_part("remainder"))
    return (
        parts.groupBy("bucket", "folder", X.dataset_name("remainder").alias("dataset"))
        .agg(
            F.min("key").alias("first_key"),
            F.count("*").alias("objects"),
            F.sum("size_bytes").alias("total_bytes"),
        )
        .withColumn("dataset_key", X.dataset_key("folder", "dataset"))
        .withColumn("display", X.dataset_label("dataset"))
    )


def folder_view(inv: DataFrame) -> DataFrame:
    """What a browser shows: loose objects, datasets and other objects by folder.

    Only dataset parts are shuffled; everything else is a plain projection.
    """
    loose = root_objects(inv).select(
        "bucket", F.lit(K.ROOT_FOLDER).alias("folder"), F.col("key").alias("name"), F.col("key").alias("display")
    )
    collapsed = datasets(inv).select("bucket", "folder", F.col("first_key").alias("name"), "display")
    other = (
        _in_folders(inv)
        .where(~X.is_dataset_part("remainder"))
        .select("bucket", "folder", F.col("key").alias("name"), F.col("remainder").alias("display"))
    )
    return loose.unionByName(collapsed).unionByName(other)


def catalog(buckets: DataFrame, inv: DataFrame) -> DataFrame:
    """Every visible key of every listed bucket; an empty bucket keeps one NULL key.

    The catalog stays a flat table, one row per key: a list per bucket would put
    a whole bucket into one task.  ``orderBy("bucket", "key")`` gives listing
    order, and its range partitioning splits a large bucket.
    """
    found = visible_objects(inv).select("bucket", "key")
    used = found.select("bucket").distinct()
    named = buckets.select("bucket").distinct()
    # `used` and `named` hold bucket names, so the two joins below stay small
    # on that side and Spark broadcasts them by their measured size.
    listed = found.join(named, "bucket", "left_semi")
    empty = named.join(used, "bucket", "left_anti").select("bucket", F.lit(None).cast("string").alias("key"))
    return listed.unionByName(empty)


def catalog_summary(buckets: DataFrame, inv: DataFrame) -> DataFrame:
    """Number of visible keys and the first and last in listing order, by bucket."""
    counts = visible_by_bucket(inv)
    return (
        buckets.select("bucket").distinct()
        .join(counts, "bucket", "left")
        .withColumn("objects", F.coalesce("objects", F.lit(0).cast("bigint")))
    )


def visible_by_bucket(inv: DataFrame) -> DataFrame:
    return (
        visible_objects(inv)
        .groupBy("bucket")
        .agg(
            F.count("*").alias("objects"),
            F.min("key").alias("first_key"),
            F.max("key").alias("last_key"),
        )
    )


def object_details(inv: DataFrame, public_url: str = K.PUBLIC_STORE_URL) -> DataFrame:
    """Details of each object as texts; the marker objects have fixed details.

    The preview is NULL where rows or lines of the object have to be sampled, and
    a link below ``public_url`` for an image.
    """
    info = X.is_info("key")
    kind = X.preview_type("key")
    preview = (
        F.when(kind == "info", K.INFO_TEXT)
        .when(kind == "image", F.concat(F.lit(public_url + "/"), F.col("bucket"), F.lit("/"), F.col("key")))
        .when(kind == "unknown", K.NO_PREVIEW_TEXT)
    )
    out = {
        "size": F.when(info, K.INFO_SIZE).otherwise(T.format_size("size_bytes")),
        "uploader": F.when(info, K.INFO_UPLOADER).otherwise(T.default_uploader("uploader")),
        "type": kind,
        "preview_content": preview,
    }
    if "last_modified" in inv.columns:
        out["last_modified"] = F.when(info, K.INFO_MODIFIED).otherwise(T.format_ts("last_modified"))
    base = ["obj_id"] if "obj_id" in inv.columns else []
    return inv.select(*base, "bucket", F.col("key").alias("filename"), *[c.alias(n) for n, c in out.items()])


def glob_regex(pattern: str) -> str:
    """Regular expression for a shell pattern with ``*``, ``?`` and ``[...]``."""
    parts = []
    for star, mark, negated, members, other in re.findall(r"(\*+)|(\?)|\[([!^]?)(\]?[^]]+)\]|(.)", pattern, re.S):
        if star:
            parts.append("[^/]*")
        elif mark:
            parts.append("[^/]")
        elif members:
            escaped = re.sub(r"([\\\[\]&^])", r"\\\1", members)
            parts.append(f"[{'^' if negated else ''}{escaped}]")
        else:
            parts.append(re.escape(other))
    return "".join(parts)


def match_objects(inv: DataFrame, pattern: str, prefix: str = "") -> DataFrame:
    """Objects directly below ``prefix`` whose file name matches a shell pattern.

    As in a shell, ``*`` and ``?`` do not cross ``/`` and do not match a leading
    dot.  The prefix, and the ending of a ``*.ext`` pattern, are plain string
    tests that reach the scan.
    """
    key = F.col("key")
    name = F.substring(key, len(prefix) + 1, 2**31 - 1)
    found = inv.where(key.startswith(prefix)) if prefix else inv
    ending = pattern[1:]
    if pattern[:1] == "*" and not any(c in ending for c in "*?["):
        found = found.where(key.endswith(ending))
    else:
        found = found.where(name.rlike(f"^{glob_regex(pattern)}$"))
    found = found.where(~name.contains("/"))
    if not pattern.startswith("."):
        found = found.where(~name.startswith("."))
    return found.withColumn("name", X.base_name("key"))


def upload_filter(inv: DataFrame) -> DataFrame:
    return inv.withColumn("allowed", X.can_upload("key"))


def attach_uploader(inv: DataFrame, meta: DataFrame) -> DataFrame:
    """Uploader of each object from a metadata table with one row per object.

    The metadata are dealt out evenly first, so that Spark can split a hot object
    also where they come grouped by the key, as the newest rows of a table do.
    """
    object_meta = meta.select("bucket", "key", "uploader").hint("rebalance")
    joined = inv.drop("uploader").join(object_meta, ["bucket", "key"], "left")
    return joined.withColumn("uploader", T.default_uploader("uploader"))


def uploader_totals(inv: DataFrame) -> DataFrame:
    """Objects and bytes per bucket and uploader."""
    return (
        inv.groupBy("bucket", T.default_uploader("uploader").alias("uploader"))
        .agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("total_bytes"))
    )
