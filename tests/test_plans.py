"""Plans that must hold at scale: pushed filters, pruned columns, early limits, no cross joins."""

import re

import pytest
from pyspark.sql import functions as F

from tarn.operators import apps as A
from tarn.operators import inventory as I
from tarn.operators import keyed as U
from tarn.operators import sessions as S
from tarn.operators import usage as R
from tarn.plans.queries import QUERIES
from tarn.sources import inventory as SI


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, inv, tmp_path):
    path = str(tmp_path / "inventory")
    inv.withColumn("last_modified", F.current_timestamp()).write.partitionBy("bucket").parquet(path)
    return SI.read_inventory(spark, path)


def test_folder_listing_prunes_and_pushes(table):
    text = plan(I.folder_objects(table, "bronze", "sales").select("key"))
    assert "StringStartsWith(key,sales/)" in text
    assert re.search(r"PartitionFilters: \[.*bucket", text)
    assert "ReadSchema: struct<key:string>" in text


def test_visible_objects_pushes_both_tests(table):
    text = plan(I.visible_objects(table).select("key"))
    assert "Not(StringContains(key,_SUCCESS))" in text and "Not(StringEndsWith(key,.crc))" in text


def test_pattern_pushes_prefix_and_ending(table):
    text = plan(I.match_objects(table, "*.csv", "raw/").select("key"))
    assert "StringStartsWith(key,raw/)" in text and "StringEndsWith(key,.csv)" in text and "RLIKE" not in text


def test_datasets_shuffle_once(table):
    assert plan(I.datasets(table)).count("Exchange") == 1


def test_newest_is_cut_before_the_shuffle(table):
    text = plan(U.latest_by_key(table, ["bucket", "key"], ["last_modified"]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_metric_history_is_cut_before_the_shuffle(spark, sf):
    text = plan(QUERIES["metric_history"](spark, sf))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_sessions_merge_heartbeats_before_the_shuffle(spark, sf):
    text = plan(QUERIES["idle_sessions"](spark, sf))
    assert text.count("Exchange") == 2
    assert text.rindex("partial_min") > text.rindex("Exchange")  # the deepest exchange gets merged rows


def test_metrics_read_only_their_columns(spark, sf):
    text = plan(R.workspace_metrics(spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("usuario"), F.lit("vscode").alias("role"),
        *[F.col("event_id").alias(c) for c in R.SAMPLE_FIELDS]), ["ts", "event_id"]))
    assert "props" not in text


def test_small_update_leaves_the_base_unshuffled(spark, tmp_path):
    path = str(tmp_path / "base")
    spark.range(1000).select("id", F.col("id").alias("at")).write.parquet(path)
    updates = spark.range(3).select("id", F.lit(9).cast("bigint").alias("at"))
    text = plan(U.merge_updates(spark.read.parquet(path), updates, ["id"], ["at"]))
    base_side = text.split("FileScan")[0].splitlines()[-3:]
    assert "BroadcastHashJoin" in text and not any("Exchange" in line for line in base_side)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "preview_"))])
def test_no_cross_join_and_no_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition", "Exchange SinglePartition"):
        assert word not in text


def test_sessions_of_a_hot_user_are_bounded_by_time(spark):
    """A million heartbeats of one user reach the ordering step as one row per cell."""
    beats = spark.range(1_000_000).select(
        F.lit("hot").alias("usuario"), F.timestamp_micros(F.col("id") * 3_600_000).alias("ts")
    )
    got = S.idle_gaps(beats)
    assert got.count() == 1 and got.first()["beats"] == 1_000_000


@pytest.fixture
def no_broadcast(spark):
    """Join sizes as on a cluster, where nothing here fits a broadcast."""
    settings = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_application_is_split_over_tasks(no_broadcast):
    spark = no_broadcast
    ids = spark.range(0, 200_000, 1, 8)
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000)
    jobs = ids.select(
        hot.cast("bigint").alias("app_id"), F.col("id").alias("job_id"), F.lit(4).cast("bigint").alias("num_tasks"),
        F.lit(1).cast("bigint").alias("completed_raw"), F.sha2(F.col("id").cast("string"), 256).alias("status"),
    )
    apps = spark.range(6000).select(F.col("id").alias("app_id"), F.lit("RUNNING").alias("state"))
    out = A.app_progress(apps, jobs)
    assert out.count() == 200_000 + 1000
    out.collect()
    assert "skew=true" in plan(out)
    grouped = apps.groupBy("app_id").agg(F.first("state").alias("state"))  # Spark alone would not split this one
    split = A.app_progress(grouped, jobs)
    split.collect()
    assert "skew=true" in plan(split)
    assert split.exceptAll(out).count() == 0 and split.count() == out.count()


def test_hot_object_never_meets_in_one_task(no_broadcast):
    spark = no_broadcast
    ids = spark.range(0, 200_000, 1, 8)
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.sha2((F.col("id") % 5000).cast("string"), 256))
    etag = F.sha2(F.col("id").cast("string"), 256).alias("etag")  # rows that do not shrink below Spark's threshold
    inv = ids.select(F.lit("b").alias("bucket"), hot.alias("key"), F.col("id").alias("size_bytes"), etag)
    # Grouped by the join key already, so that Spark would not split the join.
    meta = inv.where("size_bytes % 2 = 0").groupBy("bucket", "key").agg(F.lit("ana").alias("uploader"))
    out = I.attach_uploader(inv, meta)
    task_rows = out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("etag").alias("n")).agg(F.max("n")).first()[0]
    assert task_rows < 200_000 / 4
    plain = inv.join(meta, ["bucket", "key"], "left").withColumn("uploader", F.coalesce("uploader", F.lit("Desconhecido")))
    assert out.exceptAll(plain.select(*out.columns)).count() == 0 and out.count() == 200_000


@pytest.mark.parametrize("side", ["left", "right"])
def test_anti_joins_with_a_hot_key_on_either_side(no_broadcast, side):
    spark = no_broadcast
    ids = spark.range(0, 200_000, 1, 8)
    hot = ids.select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.sha2((F.col("id") % 5000).cast("string"), 256)).alias("k"))
    few = spark.createDataFrame([("hot",), ("none",)], "k string")
    base, keys = (hot, few) if side == "left" else (few, hot)
    left = U.delete_keys(base, keys, ["k"])
    assert left.count() == (hot.where("k <> 'hot'").count() if side == "left" else 1)
    text = plan(left)
    if side == "right":  # the hot key arrives at the join as one row of each task
        assert text.index("SortMergeJoin") < text.rindex("HashAggregate") and "partial" not in text.split("SortMergeJoin")[0]
    _, gone, unknown = U.cancel(base, keys, ["k"])
    assert gone.count() == base.where("k = 'hot'").count() and unknown.count() == keys.where("k <> 'hot'").distinct().count()


def test_counter_steps_order_one_cell_at_a_time(spark, sf):
    text = plan(QUERIES["cpu_delta"](spark, sf))
    assert "_cell" in text and "partial_max_by" in text
