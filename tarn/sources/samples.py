"""First rows or lines of single objects, and of many text objects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K

# Cell texts that count as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Cell texts that count as booleans.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")


def _head(df: DataFrame, n: int) -> DataFrame:
    # One lazy task walks the splits in file order and stops after n rows.
    return df.coalesce(1).limit(n)


def sample_text(spark: SparkSession, path: str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` lines, split at ``\\n`` alone; stops reading after them.

    Lines that are no valid UTF-8 fail the sample when it is read.
    """
    lines = _head(spark.read.option("lineSep", "\n").text(path), n)
    return lines.select(F.validate_utf8("value").alias("value"))


def sample_parquet(spark: SparkSession, path: str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    return _head(spark.read.parquet(path), n)


def sample_csv(spark: SparkSession, path: str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    """Header and first ``n`` rows, with types taken from these rows alone; a quoted cell may hold line breaks."""
    rows = _head(
        spark.read.option("header", True).option("multiLine", True)
        .option("escape", '"').option("nullValue", "").csv(path),
        n,
    )
    return _with_types_of_rows(rows)


def _with_types_of_rows(rows: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest type that all of the rows fit."""
    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    cleaned = rows.select(
        *[F.when(~quoted(c).isin(*MISSING_TEXTS), quoted(c)).alias(c) for c in rows.columns]
    )

    def fits(c: str) -> Column:
        v = quoted(c)
        text = F.trim(v)
        whole = text.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()
        number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?[iI]nf(inity)?$")
        logical = v.isin(*TRUE_TEXTS, *FALSE_TEXTS)
        absent = F.coalesce(F.bool_or(v.isNull()), F.lit(False))
        return F.struct(
            (F.coalesce(F.every(whole), F.lit(False)) & ~absent).alias("bigint"),
            F.coalesce(F.every(number), F.lit(True)).alias("double"),
            (F.coalesce(F.every(logical), F.lit(False)) & ~absent).alias("boolean"),
        ).alias(c)

    # At most n rows of one object are looked at; the answer is one row.
    verdict = cleaned.agg(*[fits(c) for c in cleaned.columns]).first()

    def typed(i: int, c: str) -> Column:
        v = quoted(c)
        if verdict[i]["bigint"]:
            return F.trim(v).cast("bigint").alias(c)
        if verdict[i]["boolean"]:
            return v.isin(*TRUE_TEXTS).alias(c)
        if verdict[i]["double"]:
            return F.trim(v).cast("double").alias(c)
        return v.alias(c)

    return cleaned.select(*[typed(i, c) for i, c in enumerate(cleaned.columns)])


def type_of(key: str) -> str:
    """What ``preview_type`` says of one key, without a job."""
    ending = key.rsplit(".", 1)[-1].lower()
    if key.endswith(K.HIDDEN_MARKER):
        return "info"
    if ending in K.IMAGE_EXTENSIONS:
        return "image"
    if ending in ("csv", "parquet") or K.PART_MARKER in key:
        return "table"
    return "text" if ending == "txt" else "unknown"


def sample_object(spark: SparkSession, root: str, key: str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    """Sample of the object ``key`` below ``root``, by the type its key gives.

    An object that cannot be read gives one row with the error text, as does a
    type without preview.  The sample, ``n`` rows at most, is read here, so that a
    fault in the content is met as well.
    """
    def message(kind: str, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(kind).alias("type"), F.lit(text).alias("preview_content"))

    path, kind = f"{root.rstrip('/')}/{key}", type_of(key)
    if kind == "info":
        return message(kind, K.INFO_TEXT)
    if kind == "image":
        return scan_one_image(spark, path)
    if kind == "unknown":
        return message(kind, K.NO_PREVIEW_TEXT)
    read = sample_text if kind == "text" else sample_csv if key.lower().endswith(".csv") else sample_parquet
    try:
        sample = read(spark, path, n)
        return spark.createDataFrame(sample.collect(), sample.schema)
    except Exception as error:  # any reader fault becomes the preview text
        return message("unknown", K.PREVIEW_ERROR_PREFIX + str(error).split("\n")[0])


def scan_one_image(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def text_previews(spark: SparkSession, path: str, n: int = K.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` lines of every text file below ``path``, one row per file.

    Each task keeps at most ``n`` lines per file before the shuffle, and checks
    all bytes of the file for valid UTF-8, so a bad byte anywhere gives the
    error text.  A newline at the end of a short file is kept.
    """
    lines = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size_bytes"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )
    order = W.partitionBy("path").orderBy("block", "line")
    heads = (
        lines.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("head"))
        .select("path", F.array_join(F.transform("head", lambda h: h["value"]), "\n").alias("head"))
    )
    checks = lines.groupBy("path").agg(
        F.max("size_bytes").alias("size_bytes"),
        F.count("*").alias("lines"),
        F.sum(F.octet_length("value") + F.lit(1).cast("bigint")).alias("bytes_if_closed"),
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
    )
    closed = (F.col("bytes_if_closed") == F.col("size_bytes")) & (F.col("lines") < n)
    content = F.concat("head", F.when(closed, "\n").otherwise(""))
    error = F.lit(K.PREVIEW_ERROR_PREFIX + "invalid UTF-8")
    return checks.join(heads, "path").select(
        "path",
        "size_bytes",
        F.when(F.col("valid"), "text").otherwise("unknown").alias("type"),
        F.when(F.col("valid"), content).otherwise(error).alias("preview_content"),
    )
