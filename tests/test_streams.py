import glob
import json
import os
import subprocess
import sys
from datetime import datetime, timedelta, timezone
from random import Random

import pandas as pd
import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tarn.operators import sessions as S
from tarn.operators import usage as R
from tarn.plans import queries as Q
from tarn.session import stream_settings, work_dir
from tarn.sources import landing as SL
from tarn.sources import payloads as SP
from tarn.streaming import history, live, presence, sinks

T0 = datetime(2024, 1, 1)


def drop(spark, folder, batches, schema):
    """Write each batch as one file; a stream then takes one file at a time."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return sinks.read_files(spark, folder, max_files=1)


def test_idle_sessions_match_batch(spark, tmp_path):
    rng = Random(2)
    batches = [
        [(f"u{rng.randrange(3)}", T0 + timedelta(hours=3 * b, seconds=rng.randrange(10000))) for _ in range(60)] for b in range(3)
    ]
    stream = drop(spark, str(tmp_path / "in"), batches, "usuario string, ts timestamp")
    out = live.idle_sessions(stream, "3 hours")
    sinks.finish(sinks.append_files(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = rows(spark.read.parquet(str(tmp_path / "out")), "usuario", "session_start", "last_seen", "beats")
    beats = spark.read.parquet(str(tmp_path / "in"))
    end = beats.agg(F.max("ts")).first()[0]
    closed = S.idle_gaps(beats).where(F.col("last_seen") + F.expr("interval 195 minutes") <= F.lit(end))
    assert got == rows(closed, "usuario", "session_start", "last_seen", "beats") and got


def test_metrics_take_latest_sample_of_window(spark, tmp_path):
    schema = (
        "event_id bigint, ts timestamp, usuario string, role string, mem_usage bigint, mem_cache bigint, "
        "mem_limit bigint, cpu_delta bigint, system_delta bigint, nano_cpus bigint"
    )
    def sample(i, second, role, cpu):
        return (i, T0 + timedelta(seconds=second), "a", role, 1024**2, 0, 2 * 1024**2, cpu, 100, 1_000_000_000)
    batches = [[sample(1, 0, "vscode", 10), sample(2, 2, "vscode", 20), sample(3, 1, "spark-worker", 5)], [sample(4, 60, "vscode", 1)]]
    stream = drop(spark, str(tmp_path / "in"), batches, schema)
    out, key, order = live.metrics_stream(stream, ["ts", "event_id"], "1 minute"), ["usuario", "window_start"], ["version"]
    sinks.finish(sinks.land_latest(out, str(tmp_path / "out"), str(tmp_path / "cp"), key, order, keyed=True))
    got = rows(SL.read_latest(spark, str(tmp_path / "out"), key, order), "usuario", "window_start", "status", "cpu_percent", "memory_usage_mb", "memory_percent")
    # The last window is there at once.
    assert got == [("a", T0, "online", 25.0, 2.0, 50.0), ("a", T0 + timedelta(seconds=60), "online", 1.0, 1.0, 50.0)]


def test_last_seen_forgets_after_shutdown(spark, tmp_path):
    later = T0 + timedelta(minutes=5)
    batches = [
        [("a", T0, False), ("b", T0, None), ("c", T0, False)],
        [("a", later, True), ("b", later, False), ("c", later, True)],
        [("c", later + timedelta(seconds=1), False)],
    ]
    stream = drop(spark, str(tmp_path / "in"), batches, "usuario string, ts timestamp, gone boolean")
    sinks.finish(sinks.land_latest(live.last_seen(stream), str(tmp_path / "out"), str(tmp_path / "cp"), ["usuario"], ["last_seen"]))
    users = live.present(SL.read_latest(spark, str(tmp_path / "out"), ["usuario"], ["last_seen"]))
    assert rows(users) == [("b", later), ("c", later + timedelta(seconds=1))]


def test_rolling_history_matches_batch(spark, tmp_path):
    rng = Random(8)
    numbers = iter(range(1000))
    batches = [
        [(f"s{rng.randrange(3)}", T0 + timedelta(seconds=rng.randrange(500)), next(numbers), float(rng.randrange(99)), False) for _ in range(80)]
        for _ in range(3)
    ]
    end = T0 + timedelta(days=1)
    batches.append([("s0", end, next(numbers), 0.0, True), ("s0", end + timedelta(seconds=1), 2000, 7.0, False), ("s9", end, 3000, 0.0, True)])
    stream = drop(spark, str(tmp_path / "in"), batches, "series string, ts timestamp, point_id bigint, value double, gone boolean")
    kept = history.rolling_history(stream, 5)
    sinks.finish(sinks.land_latest(kept, str(tmp_path / "out"), str(tmp_path / "cp"), ["series"], ["version"], keyed=True))
    got = rows(history.history_points(SL.read_latest(spark, str(tmp_path / "out"), ["series"], ["version"])))
    points = spark.read.parquet(str(tmp_path / "in")).where(~F.col("gone")).drop("gone")
    want = R.last_n(points.where("series <> 's0' or point_id = 2000"), ["series"], ["ts", "point_id"], 5)
    assert got == rows(want) and len(got) == 11


def test_cut_block_keeps_newest_and_shutdowns():
    block = pd.DataFrame({
        "series": ["a"] * 6 + ["b"], "at": [6, 5, 4, 3, 2, 1, 1], "point_id": range(7),
        "value": 0.0, "gone": [False, False, False, False, True, False, False],
    })
    cut = history.cut_block(block, 2)
    assert sorted(cut["point_id"]) == [0, 1, 4, 6]


def test_processor_needs_no_package_on_the_executors():
    data = cloudpickle.dumps((history.KeepNewest(3), history.cut_block))
    code = f"import pickle; p, f = pickle.loads({data!r}); print(p.n, f.__name__)"
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd="/", capture_output=True, text=True)
    assert done.stdout.split() == ["3", "cut_block"], done.stderr


def test_late_points_stay_hidden_after_a_shutdown(spark, tmp_path):
    """The result is the same however the rows fall into batches."""
    minute = lambda m: T0 + timedelta(minutes=m)
    data = [("s", minute(0), 0, 0.0, False), ("s", minute(5), 9, 0.0, True), ("s", minute(1), 1, 1.0, False), ("s", minute(6), 6, 6.0, False),
            ("t", minute(3), 3, 3.0, False), ("t", minute(2), 8, 0.0, True)]
    schema = "series string, ts timestamp, point_id bigint, value double, gone boolean"
    for name, batches in (("one", [data]), ("each", [[r] for r in data]), ("two", [data[:2], data[2:]])):
        stream = drop(spark, str(tmp_path / name / "in"), batches, schema)
        out, cp = str(tmp_path / name / "out"), str(tmp_path / name / "cp")
        sinks.finish(sinks.land_latest(history.rolling_history(stream), out, cp, ["series"], ["version"], keyed=True))
        got = history.history_points(SL.read_latest(spark, out, ["series"], ["version"]))
        assert rows(got, "series", "point_id") == [("s", 6), ("t", 3)], name


def test_heartbeat_behind_those_of_others_is_kept(spark, tmp_path):
    batches = [[("a", T0 + timedelta(hours=1))], [("b", T0 + timedelta(minutes=40))], [("a", T0 + timedelta(hours=9))]]
    stream = drop(spark, str(tmp_path / "in"), batches, "usuario string, ts timestamp")
    sinks.finish(sinks.append_files(live.idle_sessions(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "usuario", "beats") == [("a", 1), ("b", 1)]
    with pytest.raises(TypeError):
        live.idle_sessions(stream)


def test_a_table_belongs_to_one_checkpoint(spark, tmp_path):
    batches = [[("a", 1)], [("a", 2)], [("b", 1)]]
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    stream = drop(spark, folder, batches, "k string, at bigint")
    for _ in range(2):
        sinks.finish(sinks.land_latest(stream, table, str(tmp_path / "one"), ["k"], ["at"], mode="append"))
    with pytest.raises(ValueError):  # it would start over with the same batch numbers
        sinks.land_latest(stream, table, str(tmp_path / "two"), ["k"], ["at"], mode="append")
    assert rows(SL.read_latest(spark, table, ["k"], ["at"])) == [("a", 2), ("b", 1)]


def test_batches_bound_the_folders_of_a_stream(spark, tmp_path):
    stream = drop(spark, str(tmp_path / "in"), [[("a", n), (f"k{n}", n)] for n in range(9)], "k string, at bigint")
    table = str(tmp_path / "table")
    sinks.finish(sinks.land_latest(stream, table, str(tmp_path / "cp"), ["k"], ["at"], mode="append", buckets=2))
    assert SL.committed(spark, table)["batch"] == 8
    folders = {os.path.dirname(f) for f in glob.glob(f"{table}/**/part-*", recursive=True)}
    assert len(folders) == 2 * 2 + 2  # two slots of two buckets, and of the numbers
    assert rows(SL.read_latest(spark, table, ["k"], ["at"])) == [("a", 8)] + [(f"k{n}", n) for n in range(9)]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    for batch in ([("a", 1)], [("a", 5), ("b", 1)]):
        stream = drop(spark, folder, [batch], "k string, at bigint")
        sinks.finish(sinks.land_latest(stream, table, checkpoint, ["k"], ["at"], mode="append"))
    assert rows(SL.read_latest(spark, table, ["k"], ["at"])) == [("a", 5), ("b", 1)]


def test_stream_settings_are_given_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with stream_settings(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


class _Conf(dict):
    def get(self, name, default=None):
        return super().get(name, default)


class _Session:
    def __init__(self, **settings):
        self.conf = _Conf({k.replace("_", "."): v for k, v in settings.items()})


def test_work_dir_takes_the_shared_folder():
    shared = _Session(spark_master="spark://h:7077", spark_checkpoint_dir="s3a://lake/cp/")
    assert work_dir(shared, "x").startswith("s3a://lake/cp/x-")
    with pytest.raises(ValueError):
        work_dir(_Session(spark_master="spark://h:7077"), "x")


# --- pictures of applications ----------------------------------------------

def test_a_poll_replaces_the_picture_of_its_master(spark, tmp_path):
    def poll(number, master, active, completed=()):
        body = {"snapshot_id": number, "url": master, "activeapps": [{"id": i, "state": "RUNNING"} for i in active],
                "completedapps": [{"id": i, "state": "FINISHED"} for i in completed]}
        return json.dumps(body)

    folder, table, cp = (str(tmp_path / x) for x in ("in", "table", "cp"))
    os.makedirs(folder)

    def show(number, text):
        with open(f"{folder}/{number}.json", "w") as f:
            f.write(text)
        stream = sinks.read_files(spark, folder, "text", "value string", wholetext=True)
        sinks.finish(sinks.land_latest(live.app_status(stream), table, cp, ["master"], ["snapshot_id"], mode="append", buckets=2))
        return rows(SP.pictured_apps(SL.read_landed(spark, table)), "master", "app_id", "state")

    assert show(1, poll(5, "m1", ["a", "b"])) == [("m1", "a", "RUNNING"), ("m1", "b", "RUNNING")]
    assert len(show(2, poll(1, "m2", ["c"]))) == 3  # masters number their polls by themselves
    assert len(show(3, poll(6, "m1", ["x"])[:40])) == 3  # cut off: the picture stays
    assert show(4, poll(7, "m1", ["b"], ["d"])) == [("m1", "b", "RUNNING"), ("m1", "d", "FINISHED"), ("m2", "c", "RUNNING")]
    assert len(show(5, poll(6, "m1", ["late"]))) == 3  # older than the picture
    assert show(6, poll(8, "m1", [])) == [("m2", "c", "RUNNING")]


# --- users that end by the clock -------------------------------------------

BEATS = "usuario string, ts timestamp, gone boolean"


def watched(spark, tmp_path, batches, **bounds):
    """Events of users after all state is gone, and the state rows on the way."""
    stream = drop(spark, str(tmp_path / "in"), batches, BEATS)
    events = presence.presence(stream, mode="Append", **bounds)
    query = sinks.append_files(events, str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second")
    sinks.until_quiet(query, 120)
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / "out")), held


def test_one_heartbeat_and_nothing_more_becomes_idle(spark, tmp_path):
    now = datetime.now(timezone.utc)
    events, held = watched(spark, tmp_path, [[("a", now, False)]], silence=4, delay=1, patience=1, mark=2)
    ended = presence.ended_sessions(events)
    assert rows(ended, "usuario", "event", "beats") == [("a", "idle", 1)]
    assert rows(presence.users_now(events), "usuario", "gone") == [("a", False), ("a", True)]
    assert max(held) > 0 and held[-1] == 0


def test_sessions_by_the_clock_equal_the_batch_form(spark, tmp_path):
    """Heartbeats up to a minute late, in several batches; every session ends, the last one of each user too."""
    rng = Random(12)
    beats = sorted(((f"u{rng.randrange(4)}", T0 + timedelta(seconds=rng.randrange(40_000)), False) for _ in range(240)), key=lambda r: r[1] + timedelta(seconds=rng.randrange(60)))
    events, held = watched(spark, tmp_path, [beats[:80], beats[80:160], beats[160:]], delay=300, patience=8, mark=1)
    got = rows(presence.ended_sessions(events), "usuario", "session_start", "last_seen", "beats")
    want = S.idle_gaps(spark.createDataFrame(beats, BEATS))
    assert got == rows(want, "usuario", "session_start", "last_seen", "beats")
    assert held[-1] == 0


def test_a_shutdown_ends_the_user_and_leaves_a_short_mark(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[("a", at(0), False), ("a", at(100), False), ("b", at(0), False)], [("a", at(200), True), ("b", at(5000), True)], [("a", at(150), False), ("c", at(0), True)]]
    events, held = watched(spark, tmp_path, batches, delay=300, patience=6, mark=2)
    ended = rows(presence.ended_sessions(events), "usuario", "event", "beats", "last_seen")
    # The straggler counts to the session that was shut down; a shutdown after the silence finds nothing to end.
    assert ended == [("a", "shutdown", 3, at(150)), ("b", "idle", 1, at(0))]
    assert {r[0]: r[1] for r in rows(presence.users_now(events).orderBy("last_seen", "gone"), "usuario", "gone")} == {"a": True, "b": True, "c": True}
    assert held[-1] == 0


def test_sessions_of_stretches():
    s = lambda *x: presence.sessions(list(x), 900)
    assert s((0, 0, 1), (900, 900, 1), (1801, 1801, 1)) == [(0, 900, 2, None), (1801, 1801, 1, None)]
    assert s((5, 5, 0), (5, 5, 1)) == [(5, 5, 1, 5)]
    assert s((0, 0, 1), (901, 901, 0), (902, 902, 1)) == [(0, 0, 1, None), (902, 902, 1, None)]
    stretches = [(k, k, 1) for k in range(0, 5000, 10)]
    few = presence.merged(stretches, 4900, 900)
    assert len(few) == 11 and presence.sessions(few, 900) == presence.sessions(stretches, 900)


def test_users_now_as_a_table(spark, tmp_path):
    """Who is there, landed by user; rows of users who are gone leave the table again."""
    now = datetime.now(timezone.utc)
    batches = [[("a", now, False), ("b", now, False), ("c", now - timedelta(hours=2), False)], [("b", now + timedelta(seconds=1), True)]]
    stream = drop(spark, str(tmp_path / "in"), batches, BEATS)
    users = presence.users_now(presence.presence(stream, delay=1, patience=1, mark=2))
    table = str(tmp_path / "table")
    query = sinks.land_latest(users, table, str(tmp_path / "cp"), ["usuario"], ["last_seen", "gone"], every="1 second", buckets=1, forget="gone")
    sinks.until_quiet(query, 120, rows_left=4)  # a is there and holds an open stretch, its number and a timer
    assert rows(live.present(SL.read_landed(spark, table)), "usuario") == [("a",)]


def test_a_silent_series_is_forgotten(spark, tmp_path):
    folder, table, cp = (str(tmp_path / x) for x in ("in", "table", "cp"))
    schema = "series string, ts timestamp, point_id bigint, value double, gone boolean"
    stream = drop(spark, folder, [[("s", T0 + timedelta(seconds=k), k, 1.0, False) for k in range(3)] + [("t", T0, 9, 1.0, True)]], schema)
    kept = history.rolling_history(stream, 5, keep=4)
    query = sinks.land_latest(kept, table, cp, ["series"], ["version"], keyed=True, every="1 second", buckets=2)
    sinks.until_quiet(query, 120)  # points and the shutdown have expired
    assert rows(history.history_points(SL.read_landed(spark, table)), "series", "point_id") == [("s", 0), ("s", 1), ("s", 2)]
    drop(spark, folder, [[("s", T0 + timedelta(seconds=1), 7, 1.0, False), ("s", T0 + timedelta(hours=1), 8, 1.0, False), ("t", T0 - timedelta(hours=1), 5, 1.0, False)]], schema)
    query = sinks.land_latest(history.rolling_history(stream, 5, keep=4), table, cp, ["series"], ["version"], keyed=True, every="1 second", buckets=2)
    sinks.until_quiet(query, 120)
    # The series starts anew with the points after it was forgotten; the old shutdown hides nothing any more.
    assert rows(history.history_points(SL.read_landed(spark, table)).where("series = 's'"), "point_id") == [(7,), (8,)]


# --- a drop folder ---------------------------------------------------------

def test_drop_stream_lands_each_file_once_and_reads_no_content(spark, tmp_path):
    folder, table, cp = (str(tmp_path / x) for x in ("drop", "table", "cp"))

    def put(name, text, at):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{folder}/{name}", (at, at))

    def poll():
        files = sinks.drop_stream(spark, folder, "b", "ana", max_files=2)
        query = sinks.land_latest(files, table, cp, ["bucket", "key"], ["last_modified"], mode="append", buckets=2)
        sinks.finish(query)
        return rows(SL.read_landed(spark, table), "key", "size_bytes"), SL.committed(spark, table)["batch"]

    for k in range(5):
        put(f"sub{k % 2}/f {k}.csv", "x" * (k + 1), 1e9 + k)
    want = [(f"f {k}.csv", k + 1) for k in range(5)]
    assert poll() == (want, 2)
    assert poll() == (want, 2)  # nothing new, no batch
    put("late.csv", "y" * 9, 2e9)
    put("other/f 0.csv", "z" * 7, 2e9)  # the same bare name again, later
    assert poll() == (sorted([("f 0.csv", 7), ("late.csv", 9), *want[1:]]), 3)
    with open(f"{folder}/huge.bin", "wb") as f:
        f.truncate(3 << 30)  # a hole of 3 GB; a reader of contents refuses it
    os.utime(f"{folder}/huge.bin", (2e9, 2e9))
    assert ("huge.bin", 3 << 30) in poll()[0]


# --- large tables ----------------------------------------------------------

class _Value:
    """A value of the state, and how often it is asked for."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, name, schema, ttlDurationMs=None):
        return _Value(self.calls)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.remove(at)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class _Beat:
    def __init__(self, at, gone=False):
        self.at, self.gone, self.point_id, self.value = at * 1_000_000, gone, at, None


def test_a_micro_batch_reads_and_writes_the_state_of_a_key_once():
    handle = _Handle()
    user = presence.Presence(900, 600, 10, 5)
    user.init(handle)
    seen, base = [], 10**9 * 1000
    for k, beats in enumerate([(0, 100), (5000, 5100), (5200,), (9000,)]):
        handle.calls.clear()
        seen += [(e.event, e.beats) for e in user.handleInputRows(("a",), map(_Beat, beats), _Clock(base + k)) if e.event != presence.LIVE]
        assert k == 0 or sorted(handle.calls) == ["get", "update"]
    assert len(handle.timers) == 1
    early, = handle.timers
    handle.timers.clear()
    assert list(user.handleExpiredTimer(("a",), _Clock(early), None)) == [] and handle.timers == {base + 3 + 10_000}
    seen += [(e.event, e.beats) for e in user.handleExpiredTimer(("a",), _Clock(base + 3 + 10_000), None)]
    assert seen == [("idle", 2), ("idle", 3), ("idle", 1), ("gone", 0)] and user.held.value is None
    assert list(user.handleInputRows(("a",), [_Beat(9000)], _Clock(base + 20_000))) == []  # a straggler

    series = history.KeepNewest(2)
    series.init(handle)
    for beats in ((1, 2), (4, 3), (0,)):
        handle.calls.clear()
        last, = series.handleInputRows(("s",), map(_Beat, beats), None)
        assert handle.calls == ["get", "update"]
    assert [p.point_id for p in last.points] == [3, 4]


def dropped(spark, monkeypatch, purpose):
    """The work folder of that purpose, once a query has asked for it."""
    paths = []

    def folder(session, name):
        path = work_dir(session, name)
        if name == purpose:
            paths.append(path)
        return path

    monkeypatch.setattr(Q, "work_dir", folder)
    return paths


def test_arrivals_of_large_tables_are_several_files_for_each_micro_batch(spark, sf, monkeypatch):
    paths = dropped(spark, monkeypatch, "arrivals")
    want = rows(Q.stream_history(spark, sf))
    monkeypatch.setattr(Q, "FILE_EVENTS", 60)
    assert rows(Q.stream_history(spark, sf)) == want
    files = [len(glob.glob(f"{p}/part-*")) for p in paths]
    assert files[0] == Q.PARTS and files[1] > Q.PARTS and files[1] % Q.PARTS == 0


def test_masters_grow_in_number_and_not_in_size(spark, sf, monkeypatch):
    paths = dropped(spark, monkeypatch, "apps")
    want = rows(Q.stream_app_status(spark, sf))
    monkeypatch.setattr(Q, "MASTER_APPS", 50)
    assert rows(Q.stream_app_status(spark, sf)) == want
    assert [len(glob.glob(f"{p}/drop/master=*")) for p in paths] == [8, 30]


def test_dropped_texts_are_written_by_as_many_tasks_as_the_table_has_parts(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(f"text {k}",) for k in range(600)], "text string")
    texts.repartition(6).write.option("parquet.block.size", 1).parquet(str(tmp_path / "documents.parquet"))
    paths = dropped(spark, monkeypatch, "lake")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = rows(Q.landed_drops(spark, str(tmp_path)).where("uploader = 'ana'"), "total_bytes")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == [(sum(len(f"text {k}") + 1 for k in range(600)),)]
    assert len(glob.glob(f"{paths[0]}/drop/part-*")) >= 6


def test_texts_travel_compressed_to_the_files_of_a_drop(spark, tmp_path):
    texts = [None, "", "a b", "\u00e4", *(f"{k} {'x' * 500}" for k in range(60))]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    Q._text_files(table.coalesce(1), str(tmp_path / "drop"))
    files = glob.glob(f"{tmp_path}/drop/part-*")
    assert len(files) == Q.PARTS
    lines = [line for f in files for line in open(f, encoding="utf-8").read().split("\n")[:-1]]
    assert sorted(lines) == sorted(t or "" for t in texts)
