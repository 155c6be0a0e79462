import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from tarn.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tarn-tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture
def inv(spark):
    """An inventory with every kind of key, as (bucket, key, size, uploader)."""
    rows = [
        ("bronze", "a.csv", 10, "ana"),
        ("bronze", "sales/t.parquet/part-0.snappy.parquet", 100, None),
        ("bronze", "sales/t.parquet/part-1.snappy.parquet", 50, None),
        ("bronze", "sales/t.parquet/_SUCCESS", 0, None),
        ("bronze", "sales/part-7", 5, "bo"),
        ("bronze", "sales/x/part-a/b.txt", 6, "bo"),
        ("bronze", "sales/one.parquet", 7, "bo"),
        ("bronze", "sales/notes/n.txt", 1, "ana"),
        ("bronze", "sales/.t.crc", 1, None),
        ("bronze", "x_SUCCESS_y.json", 1, None),
        ("silver", "logo.PNG", 2048, "ana"),
        ("silver", "noext", 3, None),
        ("silver", "upper.CRC", 3, None),
        ("gold", "only/_SUCCESS", 0, None),
    ]
    return spark.createDataFrame(rows, "bucket string, key string, size_bytes bigint, uploader string")


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
