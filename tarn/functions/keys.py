"""Expressions over object keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import as_col


def is_hidden(key: Column | str = "key") -> Column:
    k = as_col(key)
    return k.contains(K.HIDDEN_MARKER) | k.endswith(K.HIDDEN_SUFFIX)


def file_ext(key: Column | str = "key") -> Column:
    """Lower-cased text after the last dot; the whole key when it has none."""
    return F.lower(F.substring_index(as_col(key), ".", -1))


def base_name(path: Column | str = "key") -> Column:
    return F.substring_index(as_col(path), "/", -1)


def top_folder(key: Column | str = "key") -> Column:
    """First component of a key with a slash, else NULL."""
    k = as_col(key)
    return F.when(k.contains("/"), F.substring_index(k, "/", 1))


def below_folder(key: Column | str = "key", folder: Column | str | None = None) -> Column:
    """The key without its leading ``folder + '/'``."""
    k = as_col(key)
    f = top_folder(k) if folder is None else as_col(folder)
    return F.substring(k, F.length(f) + 2, F.length(k))


def is_dataset_part(remainder: Column | str) -> Column:
    r = as_col(remainder)
    return r.contains(K.PART_MARKER) | r.endswith(K.PARQUET_SUFFIX)


def dataset_name(remainder: Column | str) -> Column:
    return F.substring_index(as_col(remainder), "/", 1)


def dataset_key(folder: Column | str, dataset: Column | str) -> Column:
    return F.concat(as_col(folder), F.lit("/"), as_col(dataset))


def dataset_label(dataset: Column | str) -> Column:
    return F.concat(F.lit(K.DATASET_LABEL_PREFIX), as_col(dataset), F.lit(K.DATASET_LABEL_SUFFIX))


def is_info(key: Column | str = "key") -> Column:
    return as_col(key).endswith(K.HIDDEN_MARKER)


def preview_type(key: Column | str = "key") -> Column:
    k = as_col(key)
    ext = file_ext(k)
    return (
        F.when(is_info(k), "info")
        .when(ext.isin(*K.IMAGE_EXTENSIONS), "image")
        .when(ext == "csv", "table")
        .when((ext == "parquet") | k.contains(K.PART_MARKER), "table")
        .when(ext == "txt", "text")
        .otherwise("unknown")
    )


def can_upload(key: Column | str = "key") -> Column:
    return file_ext(key).isin(*K.UPLOAD_EXTENSIONS)
