"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_module
from tarn.plans.oracle import ORACLE
from tarn.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    good, text = compare(spark, con, sf, name)
    assert good, text


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
    assert entry_module.queries().keys() >= QUERIES.keys()


def test_free_capacity_lies_between_zero_and_the_total(spark, sf):
    capacity = QUERIES["host_capacity"](spark, sf)
    bad = "available_cpus < 0 OR available_cpus > total_cpus OR available_mem_gb < 0 OR available_mem_gb > total_mem_gb"
    assert capacity.where(bad).isEmpty() and not capacity.isEmpty()


def test_percentages_lie_between_zero_and_a_hundred(spark, sf):
    metrics = QUERIES["workspace_metrics"](spark, sf)
    assert metrics.where("cpu_percent < 0 OR cpu_percent > 100 OR memory_percent < 0").isEmpty()
    assert metrics.where("(status = 'online') <> (cpu_percent IS NOT NULL)").isEmpty()


def test_sessions_hold_every_heartbeat(spark, sf):
    total = QUERIES["idle_sessions"](spark, sf).agg({"beats": "sum"}).first()[0]
    assert total == spark.read.parquet(f"{sf}/events.parquet").count()
