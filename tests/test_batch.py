import fnmatch
from datetime import datetime, timedelta
from random import Random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tarn.operators import apps as A
from tarn.operators import capacity as C
from tarn.operators import inventory as I
from tarn.operators import keyed as U
from tarn.operators import layers as M
from tarn.operators import sessions as S
from tarn.operators import usage as R

GB = 1024**3
T0 = datetime(2024, 1, 1)


# --- inventory -------------------------------------------------------------

def test_datasets(inv):
    got = rows(I.datasets(I.visible_objects(inv)), "bucket", "folder", "dataset", "first_key", "objects", "total_bytes")
    assert got == sorted([
        ("bronze", "sales", "one.parquet", "sales/one.parquet", 1, 7),
        ("bronze", "sales", "part-7", "sales/part-7", 1, 5),
        ("bronze", "sales", "t.parquet", "sales/t.parquet/part-0.snappy.parquet", 2, 150),
        ("bronze", "sales", "x", "sales/x/part-a/b.txt", 1, 6),
    ])


def test_folder_view(inv):
    got = rows(I.folder_view(I.visible_objects(inv)), "bucket", "folder", "display")
    assert ("bronze", "/", "a.csv") in got
    assert ("bronze", "sales", "📁 t.parquet (Dataset Spark)") in got
    assert ("bronze", "sales", "notes/n.txt") in got
    assert ("silver", "/", "upper.CRC") in got
    assert len(got) == 9


def test_catalog_keeps_empty_bucket(spark, inv):
    buckets = spark.createDataFrame([("bronze",), ("gold",), ("empty",)], "bucket string")
    got = rows(I.catalog(buckets, inv))
    assert ("gold", None) in got and ("empty", None) in got
    assert sum(b == "bronze" for b, _ in got) == 7
    assert not any(b == "silver" for b, _ in got)
    assert ("empty", 0, None, None) in rows(I.catalog_summary(buckets, inv), "bucket", "objects", "first_key", "last_key")


def test_folder_objects(inv):
    got = rows(I.folder_objects(inv, "bronze", "sales"), "display")
    assert ("t.parquet/_SUCCESS",) in got and ("notes/n.txt",) in got
    assert rows(I.folder_objects(inv, "bronze", "sale"), "display") == []


@pytest.mark.parametrize(
    "pattern, prefix, names",
    [
        ("*.csv", "", ["a.csv"]),
        ("*.txt", "sales/notes/", ["n.txt"]),
        ("part-?", "sales/", ["part-7"]),
        ("[pq]art-[0-9]", "sales/", ["part-7"]),
        ("*", "sales/", ["one.parquet", "part-7"]),
        (".*", "sales/", [".t.crc"]),
        ("*.nope", "", []),
    ],
)
def test_match_objects(inv, pattern, prefix, names):
    assert [n for (n,) in rows(I.match_objects(inv, pattern, prefix), "name")] == names


def test_glob_regex_agrees_with_the_shell(spark):
    patterns = ["*.py", "a?c", "[a-c]*", "[!a]x", "a.b", "*a*b", "[]x]", "(a|b)", "a+", "[&^]", "**"]
    names = ["a.py", "abc", "axb", "bx", "a.b", "aXb", "]", "x", "(a|b)", "a+", "aa", "&", "^", "cab", ""]
    data = spark.createDataFrame([(n,) for n in names], "n string")
    got = data.select("n", *[F.col("n").rlike(f"^{I.glob_regex(p)}$").alias(str(i)) for i, p in enumerate(patterns)])
    for row in got.collect():
        for i, p in enumerate(patterns):
            assert row[str(i)] == fnmatch.fnmatchcase(row["n"], p), (row["n"], p)


def test_object_details(inv):
    got = {r["filename"]: r for r in I.object_details(inv).collect()}
    info = got["only/_SUCCESS"]
    assert (info["size"], info["uploader"], info["type"]) == ("0 B", "Apache Spark", "info")
    assert got["logo.PNG"]["size"] == "2.0 KB" and got["logo.PNG"]["type"] == "image"
    assert got["noext"]["uploader"] == "Desconhecido"


def test_details_time(spark):
    inv = spark.createDataFrame(
        [("b", "k.txt", 1, datetime(2024, 5, 6, 7, 8, 9), None), ("b", "d/_SUCCESS", 0, T0, None)],
        "bucket string, key string, size_bytes bigint, last_modified timestamp, uploader string",
    )
    assert rows(I.object_details(inv), "filename", "last_modified") == [("d/_SUCCESS", "-"), ("k.txt", "06/05/2024 07:08:09")]


def test_fewer_datasets_than_objects(inv):
    seen = I.visible_objects(inv)
    assert I.datasets(seen).count() <= seen.count()


# --- capacity --------------------------------------------------------------

def test_host_capacity(spark):
    hosts = spark.createDataFrame([(1, 8, 16 * GB), (2, 2, 4 * GB), (3, 4, 8 * GB)], "host_id int, total_cpus bigint, total_mem_bytes bigint")
    containers = spark.createDataFrame(
        [
            (1, "vscode-a", "running", 2_500_000_000, 1 * GB), (1, "spark-worker-a", "running", None, 3 * GB),
            (1, "portal-x", "running", 8_000_000_000, 9 * GB), (1, "vscode-b", "exited", 8_000_000_000, 9 * GB),
            (2, "spark-worker-c", "running", 6_000_000_000, 6 * GB), (2, "my-vscode-d", "running", 1, 1),
        ],
        "host_id int, name string, status string, nano_cpus bigint, mem_limit_bytes bigint",
    )
    capacity = C.host_capacity(hosts, containers)
    assert rows(capacity) == [
        (1, 8, 16.0, 2.5, 4.0, 5.5, 12.0),
        (2, 2, 4.0, 6.0, 6.0, 0.0, 0.0),
        (3, 4, 8.0, 0.0, 0.0, 4.0, 8.0),
    ]
    assert rows(C.profile_fit(capacity), "host_id", "profile", "fits") == [
        (1, "extreme", False), (1, "standard", True), (2, "extreme", False), (2, "standard", False),
        (3, "extreme", False), (3, "standard", True),
    ]
    assert rows(C.eligible(capacity, "standard"), "host_id") == [(1,), (3,)]


def test_fit_at_the_threshold(spark):
    capacity = spark.createDataFrame(
        [(1, 6.0, 8.0), (2, 5.999, 8.0), (3, 6.0, 7.99)], "host_id int, available_cpus double, available_mem_gb double"
    )
    assert rows(C.eligible(capacity, "extreme"), "host_id") == [(1,)]


def test_find_first(spark):
    containers = spark.createDataFrame(
        [(1, "b-spark-master", "running"), (1, "a-spark-master", "exited"), (1, "c-spark-master", "running"), (2, "x", "running")],
        "host_id int, name string, status string",
    )
    assert rows(C.find_first(containers, "spark-master", ["host_id"])) == [(1, "b-spark-master")]


# --- usage -----------------------------------------------------------------

STATS = (
    "event_id bigint, ts timestamp_ntz, usuario string, role string, mem_usage bigint, mem_cache bigint, "
    "mem_limit bigint, cpu_delta bigint, system_delta bigint, nano_cpus bigint"
)
MB = 1024**2


def test_workspace_metrics(spark):
    data = [
        (1, T0, "a", "vscode", 9 * MB, 0, 9 * MB, 9, 9, 1),  # replaced by the next row
        (2, T0, "a", "vscode", 3 * MB, 1 * MB, 4 * MB, 50, 100, 1_000_000_000),
        (3, T0, "a", "spark-worker", 1 * MB, 5 * MB, 4 * MB, 50, 100, 0),
        (4, T0, "a", "other", 99 * MB, 0, 99 * MB, 99, 1, 1),
        (5, T0, "b", "vscode", 0, 0, 0, 0, 0, 0),
        (6, T0, "c", "spark-worker", 1, 0, 3, 900, 100, 1_000_000_000),
    ]
    users = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "usuario string")
    got = rows(R.workspace_metrics(spark.createDataFrame(data, STATS), ["ts", "event_id"], users))
    assert got == [
        ("a", "online", 75.0, 2.0, 8.0, 25.0),
        ("b", "online", 0.0, 0.0, 0.0, 0.0),
        ("c", "online", 100.0, 0.0, 0.0, 33.33),
        ("z", "offline", None, None, None, None),
    ]


def test_last_n_keeps_all_of_short_series(spark):
    data = [("a", i, T0 + timedelta(seconds=i % 7)) for i in range(50)] + [("b", i, T0) for i in range(3)]
    samples = spark.createDataFrame(data, "usuario string, event_id bigint, ts timestamp_ntz")
    got = rows(R.last_n(samples, ["usuario"], ["ts", "event_id"]), "usuario", "event_id")
    newest = sorted(((t, i) for u, i, t in data if u == "a"), reverse=True)[:20]
    assert got == sorted([("a", i) for _, i in newest] + [("b", i) for i in range(3)], key=lambda r: tuple((True, str(x)) for x in r))


@pytest.mark.parametrize("cell", ["minute", "hour", "year"])
def test_counter_delta_is_the_same_for_any_cell(spark, cell):
    rng = Random(4)
    data = []
    for i in range(400):  # "hot" holds most rows, with quiet hours between
        series = "hot" if i % 4 else f"s{i % 3}"
        data.append((i, T0 + timedelta(minutes=rng.choice([0, 1, 61, 600, 5000]) + rng.randrange(90)), series, rng.randrange(10**6)))
    samples = spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, usuario string, total bigint")
    got = {r["event_id"]: r["total_step"] for r in
           R.counter_delta(samples, ["usuario"], "ts", ["ts", "event_id"], ["total"], cell=cell).collect()}
    want, last = {}, {}
    for i, t, series, total in sorted(data, key=lambda r: (r[1], r[0])):
        want[i] = total - last.get(series, 0)
        last[series] = total
    assert got == want


# --- sessions --------------------------------------------------------------

def beats(spark, data):
    return spark.createDataFrame(data, "usuario string, ts timestamp_ntz")


def test_idle_at_exactly_the_timeout(spark):
    now = T0 + timedelta(seconds=900)
    data = beats(spark, [("edge", T0), ("idle", T0 - timedelta(microseconds=1)), ("new", now)])
    assert rows(S.idle_at(data, F.lit(now)), "usuario") == [("idle",)]


def test_idle_gaps_boundary(spark):
    step = timedelta(seconds=900)
    data = beats(spark, [("a", T0), ("a", T0 + step), ("a", T0 + 2 * step + timedelta(microseconds=1))])
    assert rows(S.idle_gaps(data), "session_start", "last_seen", "beats") == [
        (T0, T0 + step, 2), (T0 + 2 * step + timedelta(microseconds=1),) * 2 + (1,)
    ]


def test_idle_gaps_against_brute_force(spark):
    rng = Random(9)
    data = [(f"u{rng.randrange(5)}", T0 + timedelta(seconds=rng.randrange(80000), microseconds=rng.randrange(10**6))) for _ in range(600)]
    want = []
    for user in {u for u, _ in data}:
        times = sorted(t for u, t in data if u == user)
        group = [times[0]]
        for t in times[1:]:
            if t - group[-1] > timedelta(seconds=900):
                want.append((user, group[0], group[-1], len(group)))
                group = []
            group.append(t)
        want.append((user, group[0], group[-1], len(group)))
    got = S.idle_gaps(beats(spark, data)).select("usuario", "session_start", "last_seen", "beats").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# --- applications ----------------------------------------------------------

APPS = "app_id bigint, name string, state string, duration_ms bigint, start_ts timestamp_ntz"


def test_recent_completed(spark):
    data = [(i, f"n{i}", "FINISHED" if i % 2 else "RUNNING", 1000 * i, T0 + timedelta(days=i)) for i in range(30)]
    got = A.recent_completed(spark.createDataFrame(data, APPS)).select("app_id", "duration").collect()
    assert [r[0] for r in got] == list(range(29, 9, -2))
    assert got[0][1] == "29.0 s"


def test_app_progress_and_totals(spark):
    apps = spark.createDataFrame([(1, "x", "RUNNING"), (2, "y", "FAILED")], "app_id bigint, name string, state string")
    jobs = spark.createDataFrame(
        [(1, 0, 4, 1, 2, "RUNNING"), (1, 1, 0, None, None, "SUCCEEDED"), (9, 5, 1, 1, 1, "RUNNING")],
        "app_id bigint, job_id bigint, num_tasks bigint, completed_raw bigint, active_raw bigint, status string",
    )
    got = rows(A.app_progress(apps, jobs), "app_id", "job_id", "total", "completed_percent", "active_percent", "status_class")
    assert got == [
        (1, 0, 4, 25.0, 50.0, "running"), (1, 1, 1, 0.0, 0.0, "succeeded"), (2, None, None, None, None, None)
    ] or got == [(2, None, None, None, None, None), (1, 0, 4, 25.0, 50.0, "running"), (1, 1, 1, 0.0, 0.0, "succeeded")]
    assert rows(A.app_totals(apps, jobs), "app_id", "jobs", "tasks", "completed", "active") == [(1, 2, 5, 1, 2), (2, 0, 0, 0, 0)]


def test_jobs_newest_first(spark):
    jobs = spark.createDataFrame([(1, 2), (1, 10), (0, 3)], "app_id bigint, job_id bigint")
    assert [tuple(r) for r in A.jobs_newest_first(jobs).collect()] == [(0, 3), (1, 10), (1, 2)]


# --- keyed tables and layers -----------------------------------------------

def keyed(spark, data):
    return spark.createDataFrame(data, "k string, at bigint, v string")


@pytest.mark.parametrize("merge", [U.upsert_latest, U.merge_updates])
def test_upserts(spark, merge):
    base = keyed(spark, [("a", 1, "old"), ("b", 9, "newer"), ("c", 1, "kept")])
    updates = keyed(spark, [("a", 2, "x"), ("a", 3, "last"), ("b", 5, "late"), ("d", 1, "new")])
    want = [("a", 3, "last"), ("b", 9, "newer"), ("c", 1, "kept"), ("d", 1, "new")]
    once = merge(base, updates, ["k"], ["at"])
    assert rows(once) == want
    assert rows(merge(once, updates, ["k"], ["at"])) == want


def test_cancel(spark):
    registry = keyed(spark, [("a", 1, ""), ("b", 1, "")])
    asked = spark.createDataFrame([("b",), ("b",), ("z",)], "k string")
    left, gone, unknown = U.cancel(registry, asked, ["k"])
    assert (rows(left, "k"), rows(gone, "k"), rows(unknown)) == ([("a",)], [("b",)], [("z",)])
    assert rows(U.delete_keys(left, asked, ["k"]), "k") == [("a",)]


def test_silver_and_gold(spark):
    bronze = spark.createDataFrame(
        [("1", "2.50", None, "x"), ("1", "3.25", "ana", "x"), ("2", "bad", "bo", "y")], "id string, v string, uploader string, extra string"
    )
    numbered = bronze.withColumn("n", F.when(F.col("v") == "2.50", 1).otherwise(2))
    silver, failed = M.to_silver(numbered, {"id": "bigint", "v": "decimal(9,2)", "uploader": "string", "n": "int"}, ["id"], ["n"])
    assert [(i, u) for i, u in rows(silver, "id", "uploader")] == [(1, "ana")]
    assert rows(failed, "id", "v", "extra", "failed") == [("2", "bad", "y", ["v"])]
    gold = M.to_gold(silver, ["uploader"], [F.sum("v").alias("total")])
    assert [(u, None if t is None else float(t)) for u, t in rows(gold)] == [("ana", 3.25)]


def test_rows_that_do_not_fit_replace_nothing(spark):
    bronze = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("7", 4), (None, 5), (None, 6)], "k string, at int")
    silver, failed = M.to_silver(bronze, {"k": "bigint", "at": "int"}, ["k"], ["at"])
    assert rows(silver) == [(None, 6), (7, 4)]
    assert rows(failed, "k") == [("x",), ("y",), ("z",)]


def test_merge_and_upsert_agree_on_null_keys(spark):
    base = spark.createDataFrame([(None, 1, "old"), ("a", 1, "old"), ("b", 5, "old")], "k string, at int, v string")
    updates = spark.createDataFrame([(None, 2, "new"), (None, 1, "late"), ("b", 2, "late"), ("c", 1, "new")], "k string, at int, v string")
    merged = U.merge_updates(base, updates, ["k"], ["at"])
    assert rows(merged) == rows(U.upsert_latest(base, updates, ["k"], ["at"])) and merged.count() == 4


def test_metrics_and_status_at_an_instant(spark):
    """Roles that stopped earlier do not count, each by its own bound; samples after the instant do not exist yet."""
    at = lambda s: datetime(2024, 1, 1, 12) + timedelta(seconds=s)

    def sample(i, second, user, role, used):
        return (i, at(second), user, role, used * 1024**2, 0, 1024**2, 0, 0, 0)

    data = [sample(1, -5, "a", "vscode", 1), sample(2, -31, "a", "spark-worker", 2), sample(3, -30, "b", "spark-worker", 4), sample(4, 1, "b", "vscode", 8),
            sample(5, -100, "c", "vscode", 16), sample(6, 0, "d", "other", 32), sample(7, -60, "e", "spark-worker", 64)]
    shape = STATS.replace("ts timestamp_ntz", "ts timestamp_ntz")
    samples = spark.createDataFrame(data, shape)
    users = spark.createDataFrame([(u,) for u in "abcdef"], "usuario string")
    now = F.lit(at(0)).cast("timestamp_ntz")
    seen = R.as_of(samples, now)
    assert rows(R.online_status(seen, users)) == [("a", "online"), ("b", "online"), ("c", "offline"), ("d", "online"), ("e", "offline"), ("f", "offline")]
    got = rows(R.workspace_metrics(seen, ["ts", "event_id"], users), "usuario", "status", "memory_usage_mb")
    assert got == [("a", "online", 1.0), ("b", "online", 4.0), ("c", "offline", None), ("d", "offline", None), ("e", "offline", None), ("f", "offline", None)]
    longer = R.as_of(samples, now, {"spark-worker": 60, "vscode": 5})
    assert rows(R.workspace_metrics(longer, ["ts", "event_id"]), "usuario", "memory_usage_mb") == [("a", 3.0), ("b", 4.0), ("e", 64.0)]
    assert rows(R.as_of(samples, now, {"": 0}), "event_id") == [(6,)]
