import json
import os
import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tarn.operators import apps as A
from tarn.operators import inventory as I
from tarn.functions.keys import preview_type
from tarn.operators import layers as M
from tarn.sources import inventory as SI
from tarn.operators import keyed as U
from tarn.operators import refresh as R
from tarn.sources import landing as SL
from tarn.sources import payloads as SP
from tarn.sources import samples as SS


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.fixture
def lake(tmp_path):
    root = str(tmp_path / "lake")
    write(f"{root}/bronze/raw/mixed.csv", "id,price,ok,name\n" + "".join(f"{i},{i}.5,True,n{i}\n" for i in range(15)))
    write(f"{root}/bronze/raw/UPPER.CSV", "a\n1\n")
    write(f"{root}/bronze/notes.txt", "\n".join(f"line {i}" for i in range(14)))
    write(f"{root}/bronze/dos.txt", "a\r\nb\r\n")
    write(f"{root}/bronze/short.txt", "x\ny\n")
    write(f"{root}/bronze/bad.txt", b"ok\n\xff\xfe\n")
    write(f"{root}/bronze/part-0.json", '{"a": 1}\n')
    write(f"{root}/bronze/noext", "abc")
    write(f"{root}/bronze/empty.txt", "")
    write(f"{root}/silver/logo.PNG", b"\x89PNG....")
    write(f"{root}/silver/pic.jpeg", b"..")
    write(f"{root}/silver/x_SUCCESS_y.csv", "a\n1\n")
    return root


def test_list_objects(spark, lake):
    listed = SI.list_objects(spark, lake)
    got = {(b, k): s for b, k, s in rows(listed, "bucket", "key", "size_bytes")}
    assert got[("bronze", "raw/mixed.csv")] == os.path.getsize(f"{lake}/bronze/raw/mixed.csv")
    assert ("bronze", "empty.txt") not in got  # a documented gap of the file index
    assert ("silver", "x_SUCCESS_y.csv") in got
    assert I.visible_objects(listed).count() == len(got) - 1
    assert rows(SI.list_objects(spark, "file://" + lake), "key") == rows(listed, "key")


def test_walk_objects_finds_every_file(spark, lake):
    os.makedirs(f"{lake}/void")
    write(f"{lake}/silver/t/_SUCCESS", "")
    write(f"{lake}/silver/t/.hidden", "x")
    write(f"{lake}/outside.txt", "x")
    want = []
    for folder, _, names in os.walk(lake):
        for name in names:
            path = os.path.join(folder, name)
            below = os.path.relpath(path, lake).split("/", 1)
            if len(below) == 2:
                want.append((below[0], below[1], os.path.getsize(path)))
    walked = SI.walk_objects(spark, lake)
    assert rows(walked, "bucket", "key", "size_bytes") == sorted(want)
    assert walked.where("last_modified > timestamp'2024-01-01'").count() == len(want)
    buckets = SI.list_buckets(spark, lake)
    assert rows(buckets) == [("bronze",), ("silver",), ("void",)]
    assert ("void", None) in rows(I.catalog(buckets, walked))


def test_list_objects_reads_no_content(spark, lake):
    plan = SI.list_objects(spark, lake)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_scan_images(spark, lake):
    for name in ("_x.png", ".y.jpg", "z.JPEG", "png"):
        write(f"{lake}/silver/{name}", "")
    assert rows(SI.scan_images(spark, lake), "bucket", "key") == [
        ("silver", k) for k in (".y.jpg", "_x.png", "logo.PNG", "pic.jpeg", "z.JPEG")]


def test_long_folders_come_in_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SI, "LISTED", 7)
    for k in range(30):
        write(str(tmp_path / "lake" / "b" / f"f{k}"), "x" * k)
    assert rows(SI.walk_objects(spark, str(tmp_path / "lake")), "key", "size_bytes") == sorted((f"f{k}", k) for k in range(30))


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_read_inventory(spark, inv, tmp_path, fmt):
    path = str(tmp_path / fmt)
    full = inv.select("bucket", "key", "size_bytes", F.lit(None).cast("timestamp").alias("last_modified"), "uploader")
    writer = (full if fmt == "csv" else inv).write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    back = SI.read_inventory(spark, path, fmt)
    assert back.columns == ["bucket", "key", "size_bytes", "last_modified", "uploader"]
    assert rows(back, "bucket", "key", "size_bytes", "uploader") == rows(inv)


def test_sample_csv_types(spark, lake):
    sample = SS.sample_csv(spark, f"{lake}/bronze/raw/mixed.csv")
    assert sample.dtypes == [("id", "bigint"), ("price", "double"), ("ok", "boolean"), ("name", "string")]
    assert [r["id"] for r in sample.collect()] == list(range(10))


def test_sample_csv_types_of_the_sample_alone(spark, tmp_path):
    text = "v,w,when,q\n" + "1,,2024,\"a,b\"\n" * 9 + "2,NA,2025,\"say \"\"hi\"\"\"\n" + "word,3,x,z\n"
    path = write(str(tmp_path / "t.csv"), text)
    sample, frame = SS.sample_csv(spark, path), pd.read_csv(path, nrows=10)
    assert sample.dtypes == [("v", "bigint"), ("w", "double"), ("when", "bigint"), ("q", "string")]
    assert [str(t) for t in frame.dtypes[:3]] == ["int64", "float64", "int64"]
    assert [r["q"] for r in sample.collect()] == list(frame["q"])


def test_sample_csv_with_gaps(spark, tmp_path):
    path = write(str(tmp_path / "t.csv"), "a,b,c\n1,true,\n,false,x\n3,true,y\n")
    sample = SS.sample_csv(spark, path)
    assert sample.dtypes == [("a", "double"), ("b", "boolean"), ("c", "string")]
    assert [tuple(r) for r in sample.collect()] == [(1.0, True, None), (None, False, "x"), (3.0, True, "y")]


def test_sample_text(spark, lake):
    assert [r[0] for r in SS.sample_text(spark, f"{lake}/bronze/notes.txt").collect()] == [f"line {i}" for i in range(10)]
    assert [r[0] for r in SS.sample_text(spark, f"{lake}/bronze/dos.txt").collect()] == ["a\r", "b\r"]


def test_sample_of_a_split_file_starts_at_its_head(spark, tmp_path):
    path = write(str(tmp_path / "big.txt"), "\n".join(f"{i:07d}" for i in range(200000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        sample = SS.sample_text(spark, path)
        assert [r[0] for r in sample.collect()] == [f"{i:07d}" for i in range(10)]
        assert sample.count() == 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sample_object(spark, lake, tmp_path):
    assert SS.sample_object(spark, lake, "bronze/raw/UPPER.CSV").first()[0] == 1
    broken = SS.sample_object(spark, lake, "bronze/part-0.json").first()
    assert broken["type"] == "unknown" and broken["preview_content"].startswith("Erro ao gerar sample: ")
    assert SS.sample_object(spark, lake, "bronze/noext").first()["preview_content"] == "Pré-visualização não disponível."
    assert SS.sample_object(spark, lake, "x/_SUCCESS").first()["type"] == "info"
    assert SS.sample_object(spark, lake, "silver/logo.PNG").first()["length"] == 8
    spark.range(30).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    part = next(f for f in os.listdir(tmp_path / "t.parquet") if f.startswith("part-"))
    assert [r[0] for r in SS.sample_object(spark, str(tmp_path), f"t.parquet/{part}").collect()] == list(range(10))
    bad = SS.sample_object(spark, lake, "bronze/bad.txt").first()
    assert bad["type"] == "unknown" and bad["preview_content"].startswith("Erro ao gerar sample: ")
    write(str(tmp_path / "part-9" / "notes.txt"), "hello\n")
    assert SS.sample_object(spark, str(tmp_path / "part-9"), "notes.txt").first()[0] == "hello"


def test_type_of_a_key_is_that_of_the_expression(spark):
    keys = ["a.csv", "a.CSV", "x/part-0", "x/part-1.txt", "t.parquet", "T.PARQUET", "n.txt", "i.PNG", "i.jpeg", "part-9/a.jpg", "_SUCCESS", "a_SUCCESS", "noext", "", ".", "csv"]
    frame = spark.createDataFrame([(k,) for k in keys], "key string").select("key", preview_type("key").alias("t"))
    assert {k: t for k, t in rows(frame)} == {k: SS.type_of(k) for k in keys}


def test_sample_csv_like_pandas(spark, tmp_path):
    text = 'id,note\n1,"x\ny"\n2,z\n\n3,"say ""hi"",\n\nbye"\nid,note\n'
    path = write(str(tmp_path / "t.csv"), text)
    frame = pd.read_csv(path, nrows=10)
    assert [tuple(r) for r in SS.sample_csv(spark, path).collect()] == [tuple(r) for r in frame.itertuples(index=False)]


def test_text_previews(spark, tmp_path):
    texts = {
        "long": "\n".join(str(i) for i in range(30)), "ten": "x\n" * 10, "nine": "x\n" * 9, "dos": "a\r\nb\r\n",
        "open": "a\nb", "one": "a", "blank": "\n", "accents": "é\nü\n",
    }
    for name, text in texts.items():
        write(str(tmp_path / "t" / f"{name}.txt"), text)
    write(str(tmp_path / "t" / "bad.txt"), b"fine\n" * 20 + b"\xff")
    got = {r["path"].split("/")[-1][:-4]: r for r in SS.text_previews(spark, str(tmp_path / "t")).collect()}
    assert {n: got[n]["preview_content"] for n in texts} == {n: "\n".join(t.split("\n")[:10]) for n, t in texts.items()}
    assert got["bad"]["type"] == "unknown" and got["bad"]["preview_content"].startswith("Erro ao gerar sample: ")


# --- payloads --------------------------------------------------------------

def test_container_stats_defaults(spark, tmp_path):
    full = {
        "memory_stats": {"usage": 10, "limit": 20, "stats": {"cache": 3}},
        "cpu_stats": {"cpu_usage": {"total_usage": 9}, "system_cpu_usage": 90},
        "precpu_stats": {"cpu_usage": {"total_usage": 4}, "system_cpu_usage": 50},
    }
    lines = [
        {"event_id": 1, "usuario": "a", "role": "vscode", "nano_cpus": 5, "stats": full},
        {"event_id": 2, "stats": {}},
        {"event_id": 3},
        {"event_id": 4, "stats": {"memory_stats": {"usage": 1}, "cpu_stats": {"cpu_usage": {}}}},
    ]
    path = write(str(tmp_path / "s.json"), "\n".join(json.dumps(x) for x in lines))
    got = rows(SP.read_container_stats(spark, path, lines=True)[0], "event_id", "mem_usage", "mem_cache", "mem_limit", "cpu_delta", "system_delta", "nano_cpus")
    assert got == [(1, 10, 3, 20, 5, 40, 5), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0, 0)]


APP = {"id": "a1", "name": "n", "user": "u", "cores": 2, "memoryperslave": 1024, "duration": 5, "state": "RUNNING", "starttime": 1704067200000}
POLLS = [
    {"snapshot_id": 1, "workers": [{"id": "w", "host": "h", "port": 1, "cores": 4}, {"id": "v"}], "activeapps": [APP, {**APP, "id": "a2"}]},
    {"snapshot_id": 2, "completedapps": [{**APP, "state": "KILLED"}], "activeapps": []},
    {"snapshot_id": 3},
]


@pytest.mark.parametrize("how", ["lines", "files", "indented"])
def test_cluster_snapshots(spark, tmp_path, how):
    if how == "lines":
        write(str(tmp_path / "p" / "all.json"), "\n".join(json.dumps(x) for x in POLLS) + "\n\n{\"snapshot_id\": 4, \"workers\": [{\n")
    else:
        for k, poll in enumerate(POLLS):
            write(str(tmp_path / "p" / f"{k}.json"), json.dumps(poll, indent=2 if how == "indented" else None))
        write(str(tmp_path / "p" / "cut.json"), "{\n \"snapshot_id\": 4, \"workers\": [{")
    workers, active, completed, broken = SP.read_cluster_snapshots(spark, str(tmp_path / "p"), lines=how == "lines")
    assert rows(workers, "snapshot_id", "id", "cores", "coresused") == [(1, "v", None, None), (1, "w", 4, None)]
    assert len(workers.columns) == 8
    assert rows(active, "snapshot_id", "app_id") == [(1, "a1"), (1, "a2")]
    assert rows(completed, "snapshot_id", "app_id", "state") == [(2, "a1", "KILLED")]
    assert broken.count() == 1
    assert A.recent_completed(completed).first()["duration"] == "0.0 s"
    assert rows(A.app_state_counts(completed)) == [("KILLED", "bad", 1)]


def test_poll_without_a_number_takes_its_time(spark, tmp_path):
    write(str(tmp_path / "p.json"), json.dumps({"workers": [{"id": "w"}]}))
    workers = SP.read_cluster_snapshots(spark, str(tmp_path / "p.json"))[0]
    assert workers.first()["snapshot_id"] == int(os.path.getmtime(tmp_path / "p.json") * 1000)


def test_app_jobs(spark, tmp_path):
    jobs = [{"jobId": 0, "name": "x", "status": "RUNNING", "numTasks": 8, "numCompletedTasks": 2, "numActiveTasks": 4},
            {"jobId": 1, "name": "y", "status": "FAILED"}]
    write(str(tmp_path / "applications" / "a" / "jobs.json"), json.dumps(jobs, indent=1))
    write(str(tmp_path / "applications" / "b" / "jobs.json"), "[]")
    write(str(tmp_path / "applications" / "c" / "jobs.json"), json.dumps([{**jobs[0], "numTasks": "many"}]))
    write(str(tmp_path / "applications" / "d" / "jobs.json"), json.dumps(jobs)[:40])
    got, broken = SP.read_app_jobs(spark, str(tmp_path))
    assert rows(A.with_progress(got), "app_id", "job_id", "total", "completed_percent", "active_percent") == [
        ("a", 0, 8, 25.0, 50.0), ("a", 1, 1, 0.0, 0.0)
    ]
    assert [f.split("/")[-2] for f, in rows(broken, "file")] == ["c", "d"]


def test_first_driver_app(spark):
    data = spark.createDataFrame([(1, [("x",), ("y",)]), (2, []), (3, None)], "d int, apps array<struct<id: string>>")
    assert rows(SP.first_driver_app(data)) == [(1, "x"), (2, None), (3, None)]


# --- landing ---------------------------------------------------------------

SHAPE = "k string, at bigint, v string"


def put(spark, table, data, number, who="ana"):
    SL.land_objects(spark.createDataFrame(data, SHAPE), table, who, ["k"], ["at"], number)


def test_landing_is_idempotent_and_last_write_wins(spark, tmp_path):
    table = str(tmp_path / "table")
    put(spark, table, [("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")], 0)
    for _ in range(2):  # the second one changes nothing
        put(spark, table, [("a", 2, "tie"), ("c", 1, "z")], 1, "bo")
    want = [("a", 2, "tie", "bo"), ("b", 1, "x", "ana"), ("c", 1, "z", "bo")]
    columns = ["k", "at", "v", "uploader"]
    assert rows(SL.read_latest(spark, table, ["k"], ["at"]), *columns) == want
    with pytest.raises(ValueError):  # other rows under a taken number would erase the first ones
        put(spark, table, [("z", 1, "x")], 1, "bo")
    assert rows(SL.read_latest(spark, table, ["k"], ["at"]), *columns) == want


def test_two_uploads_keep_both(spark, tmp_path):
    table = str(tmp_path / "table")
    with pytest.raises(TypeError):
        SL.land_objects(spark.createDataFrame([("a", 1, "x")], SHAPE), table, "ana", ["k"], ["at"])
    put(spark, table, [("a", 1, "x")], 0)
    put(spark, table, [("b", 1, "x")], 1)
    assert rows(SL.read_latest(spark, table, ["k"], ["at"]), "k") == [("a",), ("b",)]


def stamps(table):
    """When each file of the table's rows was written."""
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, files in os.walk(f"{table}/rows") for f in files if f.startswith("part-")}


def test_a_batch_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    table = str(tmp_path / "table")
    put(spark, table, [(f"k{n}", 0, "x") for n in range(300)], 0)
    before = stamps(table)
    put(spark, table, [("k7", 1, "y")], 1)
    after = stamps(table)
    assert {f: t for f, t in after.items() if f in before} == before  # the old slot stays for readers at work
    new = set(after) - set(before)
    assert len({os.path.dirname(f) for f in new}) == 1
    put(spark, table, [("k7", 2, "z")], 2)
    assert len({os.path.dirname(f) for f in set(stamps(table)) - set(after)}) == 1
    latest = SL.read_landed(spark, table)
    assert latest.count() == 300 and rows(latest.where("k = 'k7'"), "at", "v") == [(2, "z")]
    # At most two slots of each bucket, however many batches.
    for n in range(3, 7):
        put(spark, table, [("k7", n, "z")], n)
    assert len({os.path.dirname(f) for f in stamps(table)}) <= len({os.path.dirname(f) for f in before}) + 1


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    table = str(tmp_path / "table")
    put(spark, table, [(f"k{n}", 0, "x") for n in range(300)], 0)
    near = SL.read_buckets(spark, table, spark.createDataFrame([("k7",)], "k string"), ["k"])
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "landing_bucket" in text.split("PartitionFilters:")[1].split("]")[0]
    assert 0 < near.count() < 30


def test_a_batch_that_was_cut_off_does_not_count(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    put(spark, table, [(f"k{n}", 0, "x") for n in range(50)], 0)
    batch = [(f"k{n}", 1, "y") for n in range(0, 80, 2)]
    with monkeypatch.context() as broken:
        broken.setattr(SL, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(spark, table, batch, 1)
    assert rows(SL.read_landed(spark, table), "v").count(("x",)) == 50
    put(spark, table, batch, 1)
    got = rows(SL.read_landed(spark, table), "k", "v")
    assert got == sorted([(f"k{n}", "y") for n in range(0, 80, 2)] + [(f"k{n}", "x") for n in range(1, 50, 2)])
    with pytest.raises(ValueError):
        put(spark, table, [("z", 1, "x")], 1)
    assert not SL.land(spark.createDataFrame([("z", 1, "x", "ana")], SHAPE + ", uploader string"), table, ["k"], ["at"], 1)
    with pytest.raises(ValueError):
        SL.read_landed(spark, str(tmp_path / "none"))


def test_landing_of_null_keys_empty_batches_and_forgotten_rows(spark, tmp_path):
    table, shape = str(tmp_path / "table"), "k string, at bigint, gone boolean"

    def land(data, number):
        return SL.land(spark.createDataFrame(data, shape), table, ["k"], ["at"], number, buckets=3, forget="gone")

    assert land([], 0)
    with pytest.raises(ValueError):
        SL.read_landed(spark, table)
    land([(None, 1, False), ("a", 1, False)], 1)
    land([(None, 2, True), ("a", 0, True)], 2)
    assert rows(SL.read_landed(spark, table)) == [("a", 1, False), (None, 2, True)] or rows(SL.read_landed(spark, table)) == [(None, 2, True), ("a", 1, False)]
    land([], 3)
    land([(None, 1, False)], 4)  # the bucket is written again, and what was forgotten leaves it
    assert (None, 2, True) not in rows(SL.read_landed(spark, table))
    assert SL.committed(spark, table)["batch"] == 4


# --- layers by batches -----------------------------------------------------

def test_gold_follows_corrections(spark, tmp_path):
    """Groups grow, shrink, move and vanish; every batch equals the full run over all rows so far."""
    rng, silver, gold = random.Random(6), str(tmp_path / "silver"), str(tmp_path / "gold")
    shape, every = "id string, at string, grp string, v string", []
    columns = {"id": "bigint", "at": "bigint", "grp": "string", "v": "decimal(18,2)"}
    for n in range(5):
        batch = [(str(rng.randrange(20)), str(rng.randrange(9)), rng.choice(["a", "b", None, f"g{n}"]), rng.choice(["1.25", "-3", None, "bad"]))
                 for _ in range(30)]
        batch = [(i, f"{a}{k:02}", g, v) for k, (i, a, g, v) in enumerate(batch)]
        every += batch
        for _ in range(2):  # the second run is a replay
            failed = R.refresh(spark.createDataFrame(batch, shape), silver, gold, columns, ["id"], ["at", "v"], ["grp"], {"total": "v"}, n, buckets=4)
        assert failed.count() == sum(v == "bad" for *_, v in batch)
        full, _ = M.to_silver(spark.createDataFrame(every, shape), columns, ["id"], ["at", "v"])
        want = full.groupBy("grp").agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0).cast("decimal(28,2)")))
        assert rows(R.read_gold(SL.read_landed(spark, gold)), "grp", "rows", "total") == rows(want), n


def test_gold_steps_are_differences(spark):
    shape = "k bigint, at bigint, grp string, v bigint"
    base = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "a", 7), (3, 9, "b", 1)], shape)
    news = spark.createDataFrame([(1, 2, "b", 6), (2, 2, "a", 7), (3, 1, "c", 0), (4, 1, "c", 2)], shape)
    changes = U.key_changes(base, news, ["k"], ["at"])
    assert changes.count() == 3  # the older write of 3 changes nothing
    assert rows(R.gold_steps(changes, ["grp"], {"total": "v"})) == [("a", -1, -5), ("b", 1, 6), ("c", 1, 2)]


# --- dropped files ---------------------------------------------------------

def test_dropped_files(spark, tmp_path):
    for name, text in (("sub/f.csv", "a\n"), ("empty.csv", ""), (".x", "1"), ("_x", "22")):
        write(str(tmp_path / "drop" / name), text)
    got = rows(SL.dropped_files(spark, str(tmp_path / "drop"), "bronze", "ana"), "bucket", "key", "size_bytes", "uploader")
    assert got == [("bronze", ".x", 1, "ana"), ("bronze", "_x", 2, "ana"), ("bronze", "empty.csv", 0, "ana"), ("bronze", "f.csv", 2, "ana")]


def test_polls_of_a_drop_folder_land_what_is_new(spark, tmp_path):
    drop, table = str(tmp_path / "drop"), str(tmp_path / "table")
    write(f"{drop}/a", "1")
    SL.land_drops(spark, drop, table, "b", "ana", 0)
    write(f"{drop}/c", "")
    os.utime(write(f"{drop}/a", "22"), (2e9, 2e9))
    SL.land_drops(spark, drop, table, "b", "bo", 1)
    SL.land_drops(spark, drop, table, "b", "cy", 2)
    latest = SL.read_latest(spark, table, ["bucket", "key"], ["last_modified"])
    assert rows(latest, "key", "size_bytes", "uploader") == [("a", 2, "bo"), ("c", 0, "bo")]


def test_write_layer_splits_by_partition(spark, inv, tmp_path):
    path = str(tmp_path / "layer")
    M.write_layer(inv, path, ["bucket"])
    pruned = spark.read.parquet(path).where("bucket = 'gold'")
    assert pruned.count() == 1
    assert "PartitionFilters: [isnotnull(bucket" in pruned._jdf.queryExecution().executedPlan().toString()
