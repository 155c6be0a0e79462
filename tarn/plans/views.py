"""The given tables reshaped into the inputs of the operators.

Each text is plain SQL over the given tables and runs unchanged in Spark and in
the engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

# view name -> (given table, SQL with {t} for that table)
VIEWS: dict[str, tuple[str, str]] = {
    "object_inventory": (
        "documents",
        """SELECT doc_id AS obj_id,
 CASE doc_id % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS bucket,
 CASE CAST(floor(doc_id / 3) AS BIGINT) % 10
  WHEN 0 THEN 'doc_' || CAST(doc_id AS STRING) || '.txt'
  WHEN 1 THEN source || '/sales_' || lang || '.parquet/part-' || lpad(CAST(doc_id AS STRING), 5, '0') || '.snappy.parquet'
  WHEN 2 THEN source || '/sales_' || lang || '.parquet/_SUCCESS'
  WHEN 3 THEN source || '/notes/' || CAST(doc_id AS STRING) || '.csv'
  WHEN 4 THEN 'img' || CAST(doc_id AS STRING) || '.PNG'
  WHEN 5 THEN source || '/part-' || CAST(doc_id AS STRING)
  WHEN 6 THEN source || '/.' || CAST(doc_id AS STRING) || '.crc'
  WHEN 7 THEN 'report' || CAST(doc_id AS STRING) || '.csv'
  WHEN 8 THEN source || '/x_SUCCESS_' || CAST(doc_id AS STRING) || '.json'
  ELSE 'noext' || CAST(doc_id AS STRING) END AS key,
 n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS size_bytes,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS uploader FROM {t}""",
    ),
    "containers": (
        "customer",
        """SELECT c_nationkey AS host_id,
 CASE c_custkey % 4 WHEN 0 THEN 'vscode-u' WHEN 1 THEN 'spark-worker-u' WHEN 2 THEN 'spark-master-' ELSE 'portal-' END || CAST(c_custkey AS STRING) AS name,
 CASE WHEN c_custkey % 7 = 0 THEN 'exited' ELSE 'running' END AS status,
 CASE WHEN c_custkey % 10 = 0 THEN CAST(0 AS BIGINT) ELSE (1 + c_custkey % 6) * 1000000000 END AS nano_cpus,
 (1 + c_custkey % 8) * 1073741824 AS mem_limit_bytes FROM {t}""",
    ),
    "hosts": (
        "nation",
        """SELECT n_nationkey AS host_id, CAST(64 + 16 * (n_nationkey % 5) AS BIGINT) AS total_cpus,
 CAST(96 + 32 * (n_nationkey % 4) AS BIGINT) * 1073741824 AS total_mem_bytes FROM {t}""",
    ),
    "container_stats": (
        "events",
        """SELECT event_id, ts, 'user-' || CAST(user_id AS STRING) AS usuario,
 CASE WHEN event_id % 2 = 0 THEN 'vscode' ELSE 'spark-worker' END AS role,
 CAST(round(value * 100) AS BIGINT) * 100000 AS mem_usage,
 (event_id % 97) * 10000000 AS mem_cache,
 CASE WHEN event_id % 2 = 0 THEN CAST(1073741824 AS BIGINT) ELSE CAST(3221225472 AS BIGINT) END AS mem_limit,
 CASE WHEN event_id % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(round(value * 100) AS BIGINT) * 1000 END AS cpu_delta,
 CAST(50000000 AS BIGINT) AS system_delta,
 CASE WHEN event_id % 13 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(2000000000 AS BIGINT) END AS nano_cpus FROM {t}""",
    ),
    "heartbeats": ("events", "SELECT event_id, 'user-' || CAST(user_id AS STRING) AS usuario, ts FROM {t}"),
    "apps": (
        "orders",
        """SELECT o_orderkey AS app_id, 'app-' || o_orderpriority AS name, o_custkey AS user_id,
 CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS state,
 CAST(round(o_totalprice) AS BIGINT) AS duration_ms, o_orderdate AS start_ts FROM {t}""",
    ),
    "app_jobs": (
        "lineitem",
        """SELECT l_orderkey AS app_id, l_linenumber AS job_id, l_partkey AS tie1, l_suppkey AS tie2,
 CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS num_tasks,
 CAST(floor(CAST(l_quantity AS BIGINT) * (l_partkey % 11) / 10) AS BIGINT) AS completed_raw,
 CAST(l_linenumber % 4 AS BIGINT) AS active_raw,
 CASE l_returnflag WHEN 'A' THEN 'SUCCEEDED' WHEN 'N' THEN 'RUNNING' ELSE 'FAILED' END AS status FROM {t}""",
    ),
    "link_page": (
        "pages",
        """SELECT page_id, '<a href="' || url || '">Application Detail UI</a>' AS html FROM {t}""",
    ),
    "users": ("customer", "SELECT 'user-' || CAST(c_custkey AS STRING) AS usuario FROM {t}"),
    "schedules": (
        "orders",
        """SELECT o_orderkey AS schedule_id, 'load_' || CAST(o_orderkey AS STRING) || '.py' AS name,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS next_run FROM {t}""",
    ),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    return reshape(spark, load(spark, sf_dir, table), name)


def reshape(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    """A view over any DataFrame with the given table's columns, streams included."""
    return spark.sql(VIEWS[name][1], t=table)


def view_sql(name: str) -> str:
    table, sql = VIEWS[name]
    return sql.replace("{t}", table)
