"""The registered queries.  Each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import keys as X
from ..functions import text as T
from ..operators import apps as A
from ..operators import capacity as C
from ..operators import inventory as I
from ..operators import keyed as U
from ..operators import layers as M
from ..operators import refresh as N
from ..operators import sessions as S
from ..operators import usage as R
from ..sources import inventory as SI
from ..sources import landing as SL
from ..sources import payloads as SP
from ..sources import samples as SS
from ..session import prepare, work_dir
from ..streaming import history, live, presence, sinks
from .views import load, reshape, view

Query = Callable[[SparkSession, str], DataFrame]

# Four buckets, one of which holds nothing.
BUCKETS = ("bronze", "silver", "gold", "sandbox")
AS_OF = "2024-01-31 00:00:00"
INSTANT = "2024-01-15 12:00:00"
FOLDER = ("bronze", "src9")
SERIES = ["usuario", "role"]
NEWEST = ["ts", "event_id"]
OBJECT = ["bucket", "key"]


def buckets(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))


# --- inventory -------------------------------------------------------------

def visible_by_bucket(spark, sf):
    return I.visible_by_bucket(view(spark, sf, "object_inventory"))


def catalog_keys(spark, sf):
    return I.catalog(buckets(spark), view(spark, sf, "object_inventory")).orderBy("bucket", "key")


def catalog_summary(spark, sf):
    return I.catalog_summary(buckets(spark), view(spark, sf, "object_inventory"))


def folders(spark, sf):
    return I.folders(I.visible_objects(view(spark, sf, "object_inventory")))


def root_files(spark, sf):
    inv = I.visible_objects(view(spark, sf, "object_inventory"))
    return I.root_objects(inv).select("obj_id", "bucket", "key")


def folder_listing(spark, sf):
    inv = I.visible_objects(view(spark, sf, "object_inventory"))
    return I.folder_objects(inv, *FOLDER).select("obj_id", "key", "display")


def datasets(spark, sf):
    return I.datasets(I.visible_objects(view(spark, sf, "object_inventory")))


def folder_view(spark, sf):
    return I.folder_view(I.visible_objects(view(spark, sf, "object_inventory")))


def object_details(spark, sf):
    changed = F.timestamp_seconds(F.lit(1704067200) + F.col("obj_id") * 3601)
    return I.object_details(view(spark, sf, "object_inventory").withColumn("last_modified", changed))


def image_objects(spark, sf):
    inv = view(spark, sf, "object_inventory")
    link = F.concat(F.lit(K.INTERNAL_STORE_URL + "/"), F.col("bucket"), F.lit("/"), F.col("key"))
    return inv.where(X.preview_type("key") == "image").select(
        "obj_id", "bucket", "key", "size_bytes", T.rewrite_host(link).alias("link")
    )


def script_names(spark, sf):
    found = I.match_objects(view(spark, sf, "object_inventory"), "*.csv")
    script = F.replace("name", F.lit(".csv"), F.lit(".py"))
    return found.select("obj_id", "name", T.job_id(script).alias("job_id"))


def folder_scripts(spark, sf):
    found = I.match_objects(view(spark, sf, "object_inventory"), "*[13579].csv", FOLDER[1] + "/notes/")
    return found.select("obj_id", "key", "name")


def upload_allowed(spark, sf):
    return I.upload_filter(view(spark, sf, "object_inventory")).select("obj_id", "key", "allowed")


def uploader_totals(spark, sf):
    inv = view(spark, sf, "object_inventory")
    meta = U.latest_by_key(inv.select(*OBJECT, "uploader", "obj_id"), OBJECT, ["obj_id"])
    return I.uploader_totals(I.attach_uploader(inv, meta))


def inventory_table(spark, sf):
    """A landed inventory read back with the reader's own schema, then browsed."""
    path = work_dir(spark, "inventory")
    M.write_layer(view(spark, sf, "object_inventory").drop("obj_id"), path, ["bucket"])
    return I.visible_by_bucket(SI.read_inventory(spark, path))


def document_heads(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.first_lines("text").alias("head"))


# --- capacity --------------------------------------------------------------

def host_capacity(spark, sf):
    return C.host_capacity(view(spark, sf, "hosts"), view(spark, sf, "containers"))


def profile_fit(spark, sf):
    return C.profile_fit(host_capacity(spark, sf))


def eligible_hosts(spark, sf):
    return C.eligible(host_capacity(spark, sf), "extreme")


def master_lookup(spark, sf):
    return C.find_first(view(spark, sf, "containers"), K.MASTER_MARKER, ["host_id"])


def profile_specs(spark, sf):
    wanted = load(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "extreme").otherwise(F.lower("c_mktsegment")).alias("profile")
    )
    return C.with_profile_spec(wanted)


# --- usage -----------------------------------------------------------------

def workspace_metrics(spark, sf):
    return R.workspace_metrics(view(spark, sf, "container_stats"), NEWEST, view(spark, sf, "users"))


def online_status(spark, sf):
    return R.online_status(view(spark, sf, "container_stats"), view(spark, sf, "users"))


def _samples_at(spark, sf):
    """Samples as they tell what is there at one instant; a worker is asked less often than an editor."""
    at = F.lit(INSTANT).cast("timestamp_ntz")
    return R.as_of(view(spark, sf, "container_stats"), at, {"vscode": 3600, "spark-worker": 6 * 3600})


def workspace_metrics_at(spark, sf):
    return R.workspace_metrics(_samples_at(spark, sf), NEWEST, view(spark, sf, "users"))


def online_at(spark, sf):
    return R.online_status(_samples_at(spark, sf), view(spark, sf, "users"))


def cpu_delta(spark, sf):
    steps = R.counter_delta(view(spark, sf, "container_stats"), SERIES, "ts", NEWEST, ["cpu_delta", "system_delta"])
    return steps.select("event_id", "cpu_delta_step", "system_delta_step")


def metric_history(spark, sf):
    samples = view(spark, sf, "container_stats").select("usuario", "ts", "event_id", "mem_usage")
    return R.last_n(samples, ["usuario"], NEWEST)


def container_payloads(spark, sf):
    """Container statistics written as nested JSON and read back; zeros are left out."""
    path = work_dir(spark, "stats")
    keep = lambda c: F.nullif(F.col(c), F.lit(0).cast("bigint"))
    nested = view(spark, sf, "container_stats").select(
        "event_id", "ts", "usuario", "role", keep("nano_cpus").alias("nano_cpus"),
        F.struct(
            F.struct(
                keep("mem_usage").alias("usage"),
                F.col("mem_limit").alias("limit"),
                F.when(F.col("mem_cache") > 0, F.struct(F.col("mem_cache").alias("cache"))).alias("stats"),
            ).alias("memory_stats"),
            F.when(
                F.col("cpu_delta") > 0,
                F.struct(
                    F.struct((F.col("cpu_delta") + F.col("event_id")).alias("total_usage")).alias("cpu_usage"),
                    (F.col("system_delta") + F.col("event_id")).alias("system_cpu_usage"),
                ),
            ).alias("cpu_stats"),
            F.when(
                F.col("cpu_delta") > 0,
                F.struct(
                    F.struct(F.col("event_id").alias("total_usage")).alias("cpu_usage"),
                    F.col("event_id").alias("system_cpu_usage"),
                ),
            ).alias("precpu_stats"),
        ).alias("stats"),
    )
    nested.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return SP.read_container_stats(spark, path, lines=True)[0]


# --- sessions --------------------------------------------------------------

def idle_now(spark, sf):
    return S.idle_at(view(spark, sf, "heartbeats"), F.lit(AS_OF).cast("timestamp_ntz"))


def idle_sessions(spark, sf):
    return S.idle_gaps(view(spark, sf, "heartbeats")).drop("session")


# --- applications ----------------------------------------------------------

def app_states(spark, sf):
    return A.app_state_counts(view(spark, sf, "apps"))


def recent_completed(spark, sf):
    return A.recent_completed(view(spark, sf, "apps")).select("app_id", "name", "user_id", "state", "duration")


def app_durations(spark, sf):
    return view(spark, sf, "apps").select("app_id", T.format_duration("duration_ms").alias("duration"))


def job_progress(spark, sf):
    jobs = A.with_progress(view(spark, sf, "app_jobs"))
    return A.jobs_newest_first(jobs, ["tie1", "tie2"]).select(
        "app_id", "job_id", "tie1", "tie2", "total", "completed", "active",
        "completed_percent", "active_percent", "status_class",
    )


def app_progress(spark, sf):
    apps = view(spark, sf, "apps").select("app_id", "name", "state")
    return A.app_progress(apps, view(spark, sf, "app_jobs")).select(
        "app_id", "name", "state", "job_id", "tie1", "tie2", "total", "completed", "status_class"
    )


def app_totals(spark, sf):
    apps = view(spark, sf, "apps").select("app_id", "name", "state")
    return A.app_totals(apps, view(spark, sf, "app_jobs"))


def driver_links(spark, sf):
    return A.driver_links(view(spark, sf, "link_page"))


def schedule_list(spark, sf):
    return view(spark, sf, "schedules").select(
        T.job_id("name").alias("id"), "name", T.next_run_text("next_run").alias("next_run")
    )


def driver_apps(spark, sf):
    """First application of each driver payload; some drivers report none."""
    apps = view(spark, sf, "apps")
    one = F.array(F.struct(F.concat(F.lit("app-"), F.col("app_id").cast("string")).alias("id")))
    reported = F.when(F.col("state") == "FAILED", F.slice(one, 1, 0)).otherwise(one)
    payloads = apps.select("app_id", reported.alias("apps"))
    return SP.first_driver_app(payloads)


def _polls(spark, sf):
    """Poll payloads: the workers, active and completed applications of each; every other one is indented."""
    workers = load(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 200).alias("poll"),
        F.struct(
            F.concat(F.lit("worker-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("host"),
            (7000 + F.col("c_custkey") % 1000).alias("port"), (1 + F.col("c_custkey") % 8).alias("cores"),
            (F.col("c_custkey") % 4).alias("coresused"), (1024 * (1 + F.col("c_custkey") % 16)).alias("memory"),
            (512 * (F.col("c_custkey") % 8)).alias("memoryused"),
        ).alias("w"),
    ).groupBy("poll").agg(F.collect_list("w").alias("workers"))
    apps = view(spark, sf, "apps").select(
        F.floor(F.col("app_id") / 2000).alias("poll"),
        F.struct(
            F.concat(F.lit("app-"), F.col("app_id").cast("string")).alias("id"), "name",
            F.col("user_id").cast("string").alias("user"), (1 + F.col("app_id") % 8).alias("cores"),
            (1024 * (F.col("app_id") % 4)).alias("memoryperslave"), F.col("duration_ms").alias("duration"), "state",
            F.unix_millis(F.col("start_ts").cast("timestamp")).alias("starttime"),
        ).alias("a"),
    ).groupBy("poll").agg(
        F.collect_list(F.when(F.col("a.state") == "RUNNING", F.col("a"))).alias("activeapps"),
        F.collect_list(F.when(F.col("a.state") != "RUNNING", F.col("a"))).alias("completedapps"))
    body = F.struct(F.col("poll").alias("snapshot_id"), "workers", "activeapps", "completedapps")
    indented = F.to_json(body, {"pretty": "true"})
    return workers.join(apps, "poll", "full").select(
        "poll", F.when(F.col("poll") % 2 == 0, indented).otherwise(F.to_json(body)).alias("value"))


def _poll_files(spark, sf):
    """The payloads as one file each, and one more that was cut off."""
    path, polls = work_dir(spark, "polls"), _polls(spark, sf)
    cut_off = polls.where("poll = 0").select(F.lit(-1).cast("bigint").alias("poll"), F.substring("value", 1, 90).alias("value"))
    polls.unionByName(cut_off).repartition("poll").write.partitionBy("poll").text(path)
    return path


def cluster_snapshot(spark, sf):
    """Polls written as whole documents and read back: workers, active and completed applications, broken payloads."""
    workers, active, completed, broken = SP.read_cluster_snapshots(spark, _poll_files(spark, sf))
    kinds = {
        "worker": workers.withColumnRenamed("id", "worker_id"), "active": active,
        "completed": completed.withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz")),
        "broken": broken.select(F.regexp_extract("file", r"poll=(-?\d+)", 1).cast("bigint").alias("snapshot_id")),
    }
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def polled_recent(spark, sf):
    """The newest completed applications, straight from the polls."""
    _, _, completed, _ = SP.read_cluster_snapshots(spark, _poll_files(spark, sf))
    return A.recent_completed(completed).select("app_id", "name", "user_id", "state", "duration")


def polled_states(spark, sf):
    """Applications by state, straight from the polls."""
    _, _, completed, _ = SP.read_cluster_snapshots(spark, _poll_files(spark, sf))
    return A.app_state_counts(completed)


def app_job_payloads(spark, sf):
    """Job arrays written as one file per application and read back; one of them is cut off."""
    path = work_dir(spark, "jobs")
    job = F.struct(
        (F.col("app_id") * 10 + F.col("job_id")).alias("jobId"),
        F.concat(F.lit("job "), F.col("tie1").cast("string")).alias("name"),
        "status",
        F.col("num_tasks").alias("numTasks"),
        F.col("completed_raw").alias("numCompletedTasks"),
        F.col("active_raw").alias("numActiveTasks"),
    )
    apps = view(spark, sf, "app_jobs").groupBy(F.concat(F.lit("app-"), F.floor(F.col("app_id") / 2000).cast("string")).alias("app")).agg(
        F.to_json(F.collect_list(job), {"pretty": "true"}).alias("value"))
    cut_off = apps.where("app = 'app-0'").select(F.lit("app-cut").alias("app"), F.substring("value", 1, 200).alias("value"))
    apps.unionByName(cut_off).repartition("app").write.partitionBy("app").text(path)
    jobs, broken = SP.read_app_jobs(spark, path, app_in_path=r"/app=([^/]+)/")
    columns = ["app_id", "job_id", "job_name", "total", "completed", "active", "active_percent", "status_class"]
    return A.with_progress(jobs).select(*columns).unionByName(
        broken.select(F.regexp_extract("file", r"/app=([^/]+)/", 1).alias("app_id")), allowMissingColumns=True)


# --- text ------------------------------------------------------------------

def user_names(spark, sf):
    user = T.normalise_user(F.concat(F.lit(" \t"), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("\n")))
    return load(spark, sf, "customer").select(
        "c_custkey",
        user.alias("usuario"),
        T.container_name(F.lit(K.ROLES[0]), user).alias("editor"),
        T.container_name(F.lit(K.ROLES[1]), user).alias("worker"),
    )


def event_props(spark, sf):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0).cast("bigint"))
    absent = F.coalesce(F.get_json_object("props", "$.missing").cast("bigint"), F.lit(0).cast("bigint"))
    return load(spark, sf, "events").select("event_id", k.alias("k"), absent.alias("absent"))


# --- keyed tables and layers -----------------------------------------------

def _old_and_new(spark, sf):
    """The inventory as an older table and a batch of later arrivals."""
    inv = view(spark, sf, "object_inventory")
    return inv.where(F.col("uploader").isNull()), inv.where(F.col("uploader").isNotNull())


def registry_upsert(spark, sf):
    base, updates = _old_and_new(spark, sf)
    return U.upsert_latest(base, updates, OBJECT, ["obj_id"])


def registry_merge(spark, sf):
    base, updates = _old_and_new(spark, sf)
    return U.merge_updates(U.latest_by_key(base, OBJECT, ["obj_id"]), updates, OBJECT, ["obj_id"])


def registry_delete(spark, sf):
    registry = registry_upsert(spark, sf)
    doomed, _ = _old_and_new(spark, sf)
    return U.delete_keys(registry, doomed, OBJECT)


def landed_table(spark, sf):
    """Uploads landed one after the other, one of them sent twice."""
    table = work_dir(spark, "table")
    older, newer = (part.drop("uploader") for part in _old_and_new(spark, sf))
    SL.land_objects(older, table, "ana", OBJECT, ["obj_id"], 0)
    SL.land_objects(newer.where("obj_id % 2 = 0"), table, "bo", OBJECT, ["obj_id"], 1)
    for _ in range(2):
        SL.land_objects(newer.where("obj_id % 2 = 1"), table, "bo", OBJECT, ["obj_id"], 2)
    return SL.read_latest(spark, table, OBJECT, ["obj_id"])


def registry_cancel(spark, sf):
    """How many keys remained, were removed, or were not found."""
    _, registry = _old_and_new(spark, sf)
    asked, _ = _old_and_new(spark, sf)
    parts = U.cancel(U.latest_by_key(registry, OBJECT, ["obj_id"]), asked, OBJECT)
    labelled = [p.select(F.lit(n).alias("outcome"), "bucket") for n, p in zip(("remaining", "removed", "unknown"), parts)]
    union = labelled[0].unionByName(labelled[1]).unionByName(labelled[2])
    return union.groupBy("outcome", "bucket").agg(F.count("*").alias("keys"))


SILVER = {
    "event_id": "bigint", "ts": "timestamp_ntz", "day": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "decimal(18,2)", "uploader": "string",
}


SILVER_KEY = ["user_id", "day", "event_type"]


def _bronze(spark, sf):
    """Events as raw texts: repeated keys, values and ids that do not fit, and some uploaders."""
    return load(spark, sf, "events").select(
        "event_id", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
        F.when(F.col("event_id") % 59 == 0, "u?").otherwise(F.col("user_id").cast("string")).alias("user_id"), "event_type",
        F.when(F.col("event_id") % 53 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string"))).alias("uploader"),
    )


def _silver(spark, sf):
    return M.to_silver(_bronze(spark, sf), SILVER, SILVER_KEY, ["ts", "event_id"])


def silver_events(spark, sf):
    return _silver(spark, sf)[0].withColumn("value", F.col("value").cast("double"))


def silver_failed(spark, sf):
    return _silver(spark, sf)[1].select("event_id", "user_id", "value", F.array_join("failed", ",").alias("failed"))


def gold_daily(spark, sf):
    daily = M.to_gold(
        _silver(spark, sf)[0],
        ["day", "event_type"],
        [F.count("*").alias("events"), F.sum("value").alias("total")],
    )
    return daily.withColumn("total", F.col("total").cast("double"))


def gold_by_batches(spark, sf):
    """The daily totals after three batches of raw events; later ones correct keys of earlier ones."""
    out = work_dir(spark, "layers")
    bronze = _bronze(spark, sf)
    for k in range(3):
        N.refresh(
            bronze.where(F.col("event_id") % 3 == k), f"{out}/silver", f"{out}/gold", SILVER, SILVER_KEY, ["ts", "event_id"],
            ["day", "event_type"], {"total": "value"}, k, buckets=PARTS)
    daily = N.read_gold(SL.read_landed(spark, f"{out}/gold"))
    return daily.select("day", "event_type", F.col("rows").alias("events"), F.col("total").cast("double").alias("total"))


# --- files -----------------------------------------------------------------

def _first_file(spark, root):
    """Key of the first object of the first dataset below ``root``, in listing order, after its bucket."""
    listed = I.datasets(I.visible_objects(SI.walk_objects(spark, root)))
    first = listed.orderBy("bucket", "folder", "dataset").select("bucket", "first_key").first()
    return f"{first['bucket']}/{first['first_key']}"


def preview_csv(spark, sf):
    root = work_dir(spark, "lake")
    note = F.concat(F.lit("first\nsecond, \""), F.col("c_name"), F.lit("\""))
    load(spark, sf, "customer").withColumn("note", note).orderBy("c_custkey").write.option("header", True).option(
        "escape", '"').csv(f"{root}/bronze/crm/customers")
    return SS.sample_object(spark, root, _first_file(spark, root))


def preview_parquet(spark, sf):
    root = work_dir(spark, "lake")
    load(spark, sf, "supplier").orderBy("s_suppkey").write.parquet(f"{root}/silver/crm/suppliers.parquet")
    return SS.sample_object(spark, root, _first_file(spark, root))


def preview_text(spark, sf):
    root = work_dir(spark, "lake")
    load(spark, sf, "customer").orderBy("c_custkey").select("c_name").write.text(f"{root}/bronze/crm/names")
    return SS.sample_text(spark, f"{root}/{_first_file(spark, root)}")


def _text_lake(spark, sf):
    """The documents as one text file for a hundred ids each, in the order of their ids."""
    root = work_dir(spark, "lake")
    load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", "text").repartition(
        "part").sortWithinPartitions("part", "doc_id").select("part", F.col("text").alias("value")).write.partitionBy(
        "part").text(f"{root}/bronze/texts")
    return root


def text_file_previews(spark, sf):
    """Every text file previewed."""
    previews = SS.text_previews(spark, _text_lake(spark, sf))
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part")
    return previews.select(part, "size_bytes", "type", "preview_content")


def _put(spark, path, content=b""):
    """One small file, whatever its name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    out.write(bytearray(content))
    out.close()


ODD_NAMES = ("empty.txt", "_hidden.png", ".dot.JPG", "photo.jpeg", "_x", ".x")


def _mixed_lake(spark, sf):
    """The text lake and some objects of odd names, the first one empty."""
    root = _text_lake(spark, sf)
    for size, name in enumerate(ODD_NAMES):
        _put(spark, f"{root}/silver/odd/{name}", b"x" * size)
    return root


def listed_objects(spark, sf):
    """Every object with its size, from a complete listing; the names Spark makes up are left out."""
    found = I.visible_objects(SI.walk_objects(spark, _mixed_lake(spark, sf)))
    return found.select("bucket", F.regexp_replace("key", "part-[^/=]*$", "").alias("key"), "size_bytes")


def indexed_objects(spark, sf):
    """The same files by Spark's own file index, which leaves out empty and hidden ones."""
    found = I.visible_objects(SI.list_objects(spark, _mixed_lake(spark, sf)))
    return found.select("bucket", F.regexp_replace("key", "part-[^/=]*$", "").alias("key"), "size_bytes")


def scanned_images(spark, sf):
    return SI.scan_images(spark, _mixed_lake(spark, sf)).select("bucket", "key", "size_bytes")


def landed_drops(spark, sf):
    """Files of a drop folder landed by two polls; the second one finds what was added after the first."""
    drop, table = work_dir(spark, "lake") + "/drop", work_dir(spark, "drops")
    load(spark, sf, "documents").select("text").write.text(drop)  # a file for each split of the table
    SL.land_drops(spark, drop, table, "bronze", "ana", 0)
    for size, name in enumerate(ODD_NAMES):
        _put(spark, f"{drop}/later/{name}", b"x" * size)
    SL.land_drops(spark, drop, table, "bronze", "bo", 1)
    landed = I.visible_objects(SL.read_latest(spark, table, OBJECT, ["last_modified"]))
    key = F.regexp_replace("key", "^part-.*", "part")
    return landed.groupBy("uploader", key.alias("name")).agg(F.sum("size_bytes").alias("total_bytes"))


# --- streams ---------------------------------------------------------------

PARTS = 4
LATE = "10 minutes"
# Events that one file of arrivals holds, and applications that one master has, about.
FILE_EVENTS = 250_000
MASTER_APPS = 20_000
# Bytes of texts in one compressed block, about.
BLOCK_BYTES = 4 << 20


def _arrivals(spark, sf):
    """The events as a stream of several micro-batches, in the order they arrive: up to four minutes late.

    A micro-batch is as many files as each of the parts has, so that large tables are written and read by many tasks.
    """
    path = work_dir(spark, "arrivals")
    late = F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 5) * 60_000_000
    events = load(spark, sf, "events").withColumn("_at", late)
    low, high = events.agg(F.min("_at"), F.max("_at")).first()
    part = F.floor((F.col("_at") - low) * PARTS / F.lit(high - low + 1))
    held = events.agg(*[F.count_if(part == k) for k in range(PARTS)]).first()
    # So few that none of them is empty: dealing a part's rows out in turn reaches every file.
    files = max(1, min(held) // FILE_EVENTS)
    for k in range(PARTS):
        rows = events.where(part == k).drop("_at")
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    return sinks.read_files(prepare(spark), path, max_files=files)


def _stream(spark, sf, name):
    return reshape(spark, _arrivals(spark, sf), name)


def stream_idle(spark, sf):
    out = work_dir(spark, "idle")
    rows = live.idle_sessions(_stream(spark, sf, "heartbeats"), LATE)
    sinks.finish(sinks.append_files(rows, f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").select(
        "usuario", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "beats",
    )


def stream_metrics(spark, sf):
    """Every window as of now, the last ones too."""
    out, key, order = work_dir(spark, "metrics"), ["usuario", "window_start"], ["version"]
    rows = live.metrics_stream(_stream(spark, sf, "container_stats"), NEWEST, LATE)
    sinks.finish(sinks.land_latest(rows, f"{out}/rows", f"{out}/checkpoint", key, order, keyed=True))
    landed = SL.read_latest(spark, f"{out}/rows", key, order).drop("version")
    return landed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_last_seen(spark, sf):
    out, key, order = work_dir(spark, "last-seen"), ["usuario"], ["last_seen"]
    beats = _stream(spark, sf, "heartbeats")
    sinks.finish(sinks.land_latest(live.last_seen(beats), f"{out}/rows", f"{out}/checkpoint", key, order, keyed=True))
    users = live.present(SL.read_latest(spark, f"{out}/rows", key, order))
    return users.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


def stream_history(spark, sf):
    """The newest points of each user since the last shutdown; an error event stands for a shutdown."""
    out, key, order = work_dir(spark, "history"), ["series"], ["version"]
    points = _arrivals(spark, sf).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("series"), "ts", F.col("event_id").alias("point_id"),
        "value", (F.col("event_type") == "error").alias("gone"),
    )
    kept = history.rolling_history(points)
    sinks.finish(sinks.land_latest(kept, f"{out}/rows", f"{out}/checkpoint", key, order, keyed=True))
    rows = history.history_points(SL.read_latest(spark, f"{out}/rows", key, order))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_landing(spark, sf):
    """Inventory rows dropped as files, landed by a stream in several batches, read as the last write."""
    out = work_dir(spark, "landing")
    inv = view(spark, sf, "object_inventory").drop("uploader")
    for k in range(PARTS):
        inv.where(F.col("obj_id") % PARTS == (k * 3) % PARTS).coalesce(1).write.mode("append").parquet(f"{out}/drop")
    stamped = sinks.read_files(spark, f"{out}/drop", max_files=1).withColumn("uploader", F.lit("portal"))
    sinks.finish(sinks.land_latest(stamped, f"{out}/table", f"{out}/checkpoint", OBJECT, ["obj_id"], mode="append", buckets=PARTS))
    return SL.read_latest(spark, f"{out}/table", OBJECT, ["obj_id"])


def stream_present(spark, sf):
    """Users not shut down since their last heartbeat; an error event stands for a shutdown."""
    out, key, order = work_dir(spark, "present"), ["usuario"], ["last_seen"]
    beats = _arrivals(spark, sf).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("usuario"), "ts",
        (F.col("event_type") == "error").alias("gone"),
    )
    sinks.finish(sinks.land_latest(live.last_seen(beats), f"{out}/rows", f"{out}/checkpoint", key, order, keyed=True))
    users = live.present(SL.read_latest(spark, f"{out}/rows", key, order))
    return users.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


def stream_app_status(spark, sf):
    """Applications as the last complete poll of each of many masters gives them.

    A master has some ``MASTER_APPS`` applications, as a poll of it is one text, and there are eight masters at least.
    The first polls name every application as running.  Of the next ones half are cut off, and the even masters' third
    ones leave out every third application; after that an older poll of theirs arrives.  The odd masters fall behind.
    """
    out = work_dir(spark, "apps")
    apps = view(spark, sf, "apps")
    pairs = max(4, -(-apps.count() // (2 * MASTER_APPS)))
    # An application without a number is with the odd masters.
    odd = F.coalesce(F.pmod("app_id", F.lit(2)), F.lit(1))
    apps = apps.withColumn("master", (2 * F.pmod(F.xxhash64("app_id", "duration_ms", "start_ts"), F.lit(pairs)) + odd).cast("int"))

    def poll(number, state, which="true"):
        app = F.struct(
            F.concat(F.lit("app-"), F.col("app_id").cast("string")).alias("id"), F.col("duration_ms").alias("duration"), state.alias("state"))
        many = apps.where(which).groupBy("master").agg(
            F.collect_list(F.when(state == "RUNNING", app)).alias("activeapps"),
            F.collect_list(F.when(state != "RUNNING", app)).alias("completedapps"))
        body = F.struct(F.lit(number).cast("bigint").alias("snapshot_id"), "activeapps", "completedapps")
        return many.select("master", F.to_json(body, {"pretty": "true"}).alias("value"))

    polls = [poll(0, F.lit("RUNNING")), poll(1, F.col("state")).withColumn("value", F.substring("value", 1, 50)),
             poll(2, F.col("state"), "app_id % 2 = 0 AND app_id % 3 > 0"), poll(1, F.lit("LATE"), "app_id % 2 = 0")]
    for texts in polls:
        texts.repartition("master").write.mode("append").partitionBy("master").text(f"{out}/drop")
    payloads = sinks.read_files(spark, f"{out}/drop", "text", "value string, master int", max_files=2 * pairs - 1, wholetext=True)
    key, order = ["master"], ["snapshot_id"]
    seen = live.app_status(payloads)
    sinks.finish(sinks.land_latest(seen, f"{out}/table", f"{out}/checkpoint", key, order, mode="append", buckets=PARTS))
    return SP.pictured_apps(SL.read_landed(spark, f"{out}/table")).select("app_id", "active", "state", "duration_ms")


def stream_user_sessions(spark, sf):
    """Sessions that a silence or a shutdown has ended, by the clock; an error event stands for a shutdown."""
    out = work_dir(spark, "presence")
    beats = _arrivals(spark, sf).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("usuario"), "ts", (F.col("event_type") == "error").alias("gone"))
    # The whole history comes at once here: a user is waited for while it does, and a straggler's mark is short.
    events = presence.presence(beats, patience=10, mark=5, mode="Append")
    sinks.until_quiet(sinks.append_files(presence.ended_sessions(events), f"{out}/rows", f"{out}/checkpoint", every="1 second"))
    return spark.read.parquet(f"{out}/rows").select(
        "usuario", "event", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "beats")


def _text_files(texts, path):
    """``PARTS`` text files with about as many of the texts each, which come to the tasks that write them in compressed blocks."""
    def packed(batches):
        codec = pa.Codec("zstd", compression_level=9)
        for batch in batches:
            blocks = PARTS * max(1, -(-batch.nbytes // (PARTS * BLOCK_BYTES)))
            ends = [batch.num_rows * k // blocks for k in range(blocks + 1)]
            for a, b in zip(ends[:-1], ends[1:]):
                if a < b:
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
                        writer.write_batch(batch.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block"])

    def unpacked(batches):
        for batch in batches:
            for block in batch.column(0):
                with pa.ipc.open_stream(block.as_buffer()) as reader:
                    yield from reader

    blocks = texts.mapInArrow(packed, "block binary").repartition(PARTS)
    blocks.mapInArrow(unpacked, texts.schema).write.text(path)


def stream_drops(spark, sf):
    """Files of a drop folder landed as they arrive, in several micro-batches; started again, the stream lands nothing twice."""
    out = work_dir(spark, "dropped")
    _text_files(load(spark, sf, "documents").select("text"), f"{out}/drop/first")

    def polled():
        files = sinks.drop_stream(spark, f"{out}/drop", "bronze", "portal", max_files=PARTS // 2)
        sinks.finish(sinks.land_latest(files, f"{out}/table", f"{out}/checkpoint", OBJECT, ["last_modified"], mode="append", buckets=PARTS))

    polled()
    _text_files(load(spark, sf, "benchmark").select("text"), f"{out}/drop/second")
    for _ in range(2):
        polled()
    landed = SL.read_landed(spark, f"{out}/table")
    return landed.groupBy("bucket", "uploader").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        visible_by_bucket, catalog_keys, catalog_summary, folders, root_files, folder_listing, datasets,
        folder_view, object_details, image_objects, script_names, folder_scripts, upload_allowed,
        uploader_totals, inventory_table, document_heads,
        host_capacity, profile_fit, eligible_hosts, master_lookup, profile_specs,
        workspace_metrics, workspace_metrics_at, online_status, online_at, cpu_delta, metric_history, container_payloads,
        idle_now, idle_sessions,
        app_states, recent_completed, app_durations, job_progress, app_progress, app_totals,
        driver_links, schedule_list, driver_apps, cluster_snapshot, polled_recent, polled_states, app_job_payloads,
        user_names, event_props,
        registry_upsert, registry_merge, registry_delete, registry_cancel, landed_table, silver_events, silver_failed, gold_daily, gold_by_batches,
        preview_csv, preview_parquet, preview_text, text_file_previews, listed_objects, indexed_objects,
        scanned_images, landed_drops,
        stream_idle, stream_metrics, stream_last_seen, stream_present, stream_history, stream_landing, stream_app_status,
        stream_user_sessions, stream_drops,
    )
}
