from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.functions import keys as X
from tarn.functions import text as T
from tarn.functions import usage as R
from tarn.functions.rounding import round_2, text_1


def column(spark, values, expression, kind):
    """``expression`` applied to each value, in order."""
    data = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in data.orderBy("i").select(expression(F.col("v"))).collect()]


def doubles():
    rng = np.random.default_rng(3)
    ties = np.arange(0, 4000) / 8.0  # many exact ties
    near = np.round(rng.uniform(0, 1000, 20000), 3)  # texts that end in 5
    return np.concatenate([ties, near, rng.uniform(0, 1e9, 5000), [2.675, 1.005, 0.125, 1.115, 0.0, 99.995]])


def test_round_2_is_exact(spark):
    values = doubles()
    frame = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = frame.select("v", round_2("v").alias("r")).toPandas()
    assert [round(v, 2) for v in got["v"]] == list(got["r"])


def test_text_1_is_exact(spark):
    values = doubles()
    frame = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = frame.select("v", text_1("v").alias("t")).toPandas()
    # Decimal(float) is the exact binary value; ties go up.
    want = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in got["v"]]
    assert want == list(got["t"])


@pytest.mark.parametrize(
    "size, text",
    [
        (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048575, "1024.0 KB"),
        (1048576, "1.0 MB"), (1073741823, "1024.0 MB"), (1073741824, "1.0 GB"), (5 * 1024**4, "5120.0 GB"), (10**7 * 1024**3, "10000000.0 GB"), (10**7 * 1024**3 + 2**28, "10000000.25 GB"),
    ],
)
def test_format_size_edges(spark, size, text):
    assert column(spark, [size], T.format_size, "bigint") == [text]


def test_format_size_rounds_like_python(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in np.concatenate([rng.integers(1024, 2**20, 5000), rng.integers(2**20, 2**44, 5000)])]
    def expected(b):
        power, unit = (1, "KB") if b < 2**20 else (2, "MB") if b < 2**30 else (3, "GB")
        return f"{round(b / 1024**power, 2)} {unit}"
    assert column(spark, sizes, T.format_size, "bigint") == [expected(b) for b in sizes]


def test_format_duration(spark):
    values = [None, 0, 50, 59990, 59940, 60000, 90000, 250, 150, 3600000]
    assert column(spark, values, T.format_duration, "bigint") == [
        "0 s", "0 s", "0.1 s", "60.0 s", "59.9 s", "1.0 min", "1.5 min", "0.3 s", "0.1 s", "60.0 min",
    ]


def test_file_ext(spark):
    values = ["a.CSV", "a.b.Txt", "noext", "d/e", "x.", ".hid"]
    assert column(spark, values, X.file_ext, "string") == ["csv", "txt", "noext", "d/e", "", "hid"]


def test_preview_type(spark):
    cases = {
        "d/_SUCCESS": "info", "p_SUCCESS": "info", "_SUCCESS.csv": "table", "i.PNG": "image", "i.jpeg": "image",
        "part-0.jpg": "image", "part-0.csv": "table", "part-0": "table", "part-0.json": "table", "x.parquet": "table",
        "a/part-1/x.txt": "table", "n.txt": "text", "n.TXT": "text", "n.json": "unknown", "parquet": "table", "": "unknown",
    }
    assert column(spark, list(cases), X.preview_type, "string") == list(cases.values())


def test_hidden(spark):
    cases = {"a_SUCCESS_b.json": True, "d/_SUCCESS": True, "a.crc": True, "a.CRC": False, "a.crc.txt": False, "a": False}
    assert column(spark, list(cases), X.is_hidden, "string") == list(cases.values())


def test_folder_parts(spark):
    data = spark.createDataFrame([("a/b/c",), ("a",), ("/x",)], "key string")
    got = data.select(X.top_folder(), X.below_folder(), X.base_name()).collect()
    assert [tuple(r) for r in got] == [("a", "b/c", "c"), (None, None, "a"), ("", "x", "x")]


def test_normalise_user(spark):
    values = ["  Ana Maria ", "\tBO\n", "a  b", " x ", "a\tb", " é É "]
    want = [v.lower().strip().replace(" ", "-") for v in values]
    assert column(spark, values, T.normalise_user, "string") == want


def test_job_id(spark):
    assert column(spark, ["a.py", "a.py.py", "a.pyc", "b"], T.job_id, "string") == ["job_a", "job_a", "job_ac", "job_b"]


def test_first_lines(spark):
    text = "\n".join(str(i) for i in range(12))
    values = [text, "a\r\nb", "", "x\n", "\n" * 12]
    want = ["\n".join(v.split("\n")[:10]) for v in values]
    assert column(spark, values, T.first_lines, "string") == want


def test_driver_link(spark):
    values = [
        '<a href="http://h:4040/">Application Detail UI</a>', '<a HREF="http://h:4040///">application ui</a>',
        '<a href="https://h">Application UI</a>', '<a href="http://h">Other</a>', "",
        '<a href="http://one">Application UI</a><a href="http://two">Application UI</a>',
    ]
    assert column(spark, values, T.driver_link, "string") == ["http://h:4040", "http://h:4040", None, None, None, "http://one"]


def test_rewrite_host(spark):
    assert column(spark, ["http://minio:9000/b/k?s=1"], T.rewrite_host, "string") == ["http://localhost:9000/b/k?s=1"]


def test_next_run(spark):
    values = [datetime(2024, 3, 1, 2, 5, 9), None]
    assert column(spark, values, T.next_run_text, "timestamp_ntz") == ["01/03/2024 02:05:09", "Pausado"]


def test_state_classes(spark):
    assert column(spark, ["FINISHED", "FAILED", "KILLED", "WAITING", None], R.app_state_class, "string") == [
        "good", "bad", "bad", "pending", "pending"
    ]
    assert column(spark, ["SUCCEEDED", "RUNNING", "FAILED"], R.job_state_class, "string") == ["succeeded", "running", "other"]


def test_task_total(spark):
    assert column(spark, [None, 0, 7], R.task_total, "bigint") == [1, 1, 7]


def test_clamp_keeps_missing(spark):
    assert column(spark, [None, 99.0, 100.0, 250.0], R.clamp_100, "double") == [None, 99.0, 100.0, 100.0]


def test_profile_spec(spark):
    got = column(spark, ["extreme", "standard", "other", None], R.profile_spec, "string")
    assert [tuple(r) for r in got] == [(6, 2, 6), (2, 1, 3), (2, 1, 3), (2, 1, 3)]


def test_cpu_percent(spark):
    data = spark.createDataFrame(
        [(50, 100, 1_000_000_000), (50, 100, 0), (0, 100, 1), (50, 0, 1), (-5, 10, 1), (None, None, None)],
        "c bigint, s bigint, n bigint",
    )
    assert [r[0] for r in data.select(R.cpu_percent("c", "s", "n")).collect()] == [50.0, 25.0, 0.0, 0.0, 0.0, 0.0]
