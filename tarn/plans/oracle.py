"""SQL that gives the same rows as the registered queries, over the given tables."""

from __future__ import annotations

from .views import view_sql


def _over(*views: str, sql: str, extra: str = "") -> str:
    ctes = ", ".join(f"{v} AS ({view_sql(v)})" for v in views)
    return f"WITH {ctes}{', ' + extra if extra else ''} {sql}"


VISIBLE = "visible AS (SELECT * FROM object_inventory WHERE NOT contains(key, '_SUCCESS') AND NOT ends_with(key, '.crc'))"

NESTED = """nested AS (
  SELECT *, split_part(key, '/', 1) AS folder, substr(key, instr(key, '/') + 1) AS remainder
  FROM visible WHERE contains(key, '/'))"""

PARTS = """parts AS (
  SELECT bucket, folder, split_part(remainder, '/', 1) AS dataset, min(key) AS first_key,
    count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
  FROM nested WHERE contains(remainder, 'part-') OR ends_with(remainder, '.parquet') GROUP BY ALL)"""

BUCKETS = "buckets AS (SELECT * FROM (VALUES ('bronze'), ('silver'), ('gold'), ('sandbox')) AS t(bucket))"


def _two(x: str) -> str:
    """Two decimals of a double, decided on its exact value."""
    return f"CAST(printf('%.2f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def _one_text(x: str) -> str:
    """One decimal as text; values exactly between two go up."""
    return (
        f"printf('%.1f', CASE WHEN ({x}) * 20 = floor(({x}) * 20) AND ({x}) * 4 = floor(({x}) * 4) "
        f"AND CAST(({x}) * 20 AS BIGINT) % 2 = 1 THEN ({x}) + 0.01 ELSE ({x}) END)"
    )


def _duration(ms: str) -> str:
    s, m = f"{ms} / 1000.0::DOUBLE", f"{ms} / 1000.0::DOUBLE / 60.0::DOUBLE"
    return (
        f"CASE WHEN {ms} IS NULL OR {ms} = 0 THEN '0 s' WHEN {s} < 60 THEN {_one_text(s)} || ' s' "
        f"ELSE {_one_text(m)} || ' min' END"
    )


def _size(b: str) -> str:
    def scaled(power: int, unit: str) -> str:
        return f"CAST({_two(f'{b} / {1024**power}.0::DOUBLE')} AS VARCHAR) || ' {unit}'"

    return (
        f"CASE WHEN {b} < 1024 THEN CAST({b} AS VARCHAR) || ' B' WHEN {b} < 1048576 THEN {scaled(1, 'KB')} "
        f"WHEN {b} < 1073741824 THEN {scaled(2, 'MB')} ELSE {scaled(3, 'GB')} END"
    )


EXT = "lower(list_extract(string_split(key, '.'), -1))"

TYPE = f"""CASE WHEN ends_with(key, '_SUCCESS') THEN 'info' WHEN {EXT} IN ('png', 'jpg', 'jpeg') THEN 'image'
  WHEN {EXT} = 'csv' THEN 'table' WHEN {EXT} = 'parquet' OR contains(key, 'part-') THEN 'table'
  WHEN {EXT} = 'txt' THEN 'text' ELSE 'unknown' END"""

CAPACITY = f"""reserved AS (
  SELECT host_id, CAST(sum(nano_cpus) AS BIGINT) AS nano, CAST(sum(mem_limit_bytes) AS BIGINT) AS bytes FROM containers
  WHERE status = 'running' AND (starts_with(name, 'vscode-') OR starts_with(name, 'spark-worker-')) GROUP BY 1),
totals AS (
  SELECT host_id, total_cpus, total_mem_bytes, coalesce(nano, 0) AS nano, coalesce(bytes, 0) AS bytes
  FROM hosts LEFT JOIN reserved USING (host_id)),
capacity AS (
  SELECT host_id, total_cpus, {_two('total_mem_bytes / 1073741824.0::DOUBLE')} AS total_mem_gb,
    nano / 1000000000.0::DOUBLE AS allocated_cpus, {_two('bytes / 1073741824.0::DOUBLE')} AS allocated_mem_gb,
    greatest(0, total_cpus * 1000000000 - nano) / 1000000000.0::DOUBLE AS available_cpus,
    {_two('greatest(0, total_mem_bytes - bytes) / 1073741824.0::DOUBLE')} AS available_mem_gb
  FROM totals)"""

FIT = """fit AS (
  SELECT host_id, profile, available_cpus, available_mem_gb,
    available_cpus >= need_cpus AND available_mem_gb >= need_mem_gb AS fits
  FROM capacity, (VALUES ('standard', 2, 4), ('extreme', 6, 8)) AS p(profile, need_cpus, need_mem_gb))"""


def _metrics(keys: str) -> str:
    """Metrics from `newest`, which has one row per key and role."""
    cpu = """CASE WHEN cpu_delta > 0 AND system_delta > 0 THEN CAST(cpu_delta AS DOUBLE) / CAST(system_delta AS DOUBLE)
      * 100.0::DOUBLE / CASE WHEN nano_cpus > 0 THEN nano_cpus / 1000000000.0::DOUBLE ELSE 2.0::DOUBLE END ELSE 0.0::DOUBLE END"""
    return f"""sums AS (
      SELECT {keys}, CAST(sum(greatest(0, mem_usage - mem_cache)) AS BIGINT) AS used,
        CAST(sum(mem_limit) AS BIGINT) AS lim0,
        coalesce(max(CASE WHEN role = 'vscode' THEN {cpu} END), 0.0::DOUBLE)
          + coalesce(max(CASE WHEN role = 'spark-worker' THEN {cpu} END), 0.0::DOUBLE) AS cpu
      FROM newest GROUP BY ALL),
    metrics AS (
      SELECT {keys}, 'online' AS status, least({_two('cpu')}, 100.0::DOUBLE) AS cpu_percent,
        {_two('used / 1048576.0::DOUBLE')} AS memory_usage_mb, {_two('lim / 1048576.0::DOUBLE')} AS memory_limit_mb,
        {_two('CAST(used AS DOUBLE) / CAST(lim AS DOUBLE) * 100.0::DOUBLE')} AS memory_percent
      FROM (SELECT *, CASE WHEN lim0 = 0 THEN 1 ELSE lim0 END AS lim FROM sums))"""


SESSIONS = """marked AS (
  SELECT usuario, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 15 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts
  FROM heartbeats WINDOW w AS (PARTITION BY usuario ORDER BY ts, event_id)),
numbered AS (
  SELECT usuario, ts, sum(starts) OVER (PARTITION BY usuario ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked),
sessions AS (
  SELECT usuario, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS beats FROM numbered GROUP BY usuario, session)"""

THEN = """seen AS (SELECT * FROM container_stats WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
  AND ts >= TIMESTAMP '2024-01-15 12:00:00' - CASE role WHEN 'vscode' THEN INTERVAL 1 HOUR ELSE INTERVAL 6 HOUR END)"""

LATEST = "latest AS (SELECT * FROM object_inventory QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY obj_id DESC) = 1)"

PROGRESS = """progress AS (
  SELECT *, CASE WHEN coalesce(num_tasks, 0) = 0 THEN 1 ELSE num_tasks END AS total,
    coalesce(completed_raw, 0) AS completed, coalesce(active_raw, 0) AS active,
    CASE status WHEN 'SUCCEEDED' THEN 'succeeded' WHEN 'RUNNING' THEN 'running' ELSE 'other' END AS status_class
  FROM app_jobs)"""

SILVER = """silver AS (
  SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP AS day, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value,
    CASE WHEN event_id % 3 > 0 THEN 'u' || CAST(event_id % 3 AS VARCHAR) ELSE 'Desconhecido' END AS uploader FROM events
  WHERE event_id % 53 <> 0 AND event_id % 59 <> 0
  QUALIFY row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY ts DESC, event_id DESC) = 1)"""

LAKE = """lake AS (
  SELECT CAST(floor(doc_id / 100) AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS content
  FROM documents GROUP BY 1)"""

ODD = """odd AS (SELECT * FROM (VALUES ('empty.txt', 0), ('_hidden.png', 1), ('.dot.JPG', 2), ('photo.jpeg', 3), ('_x', 4), ('.x', 5))
  AS t(name, size_bytes))"""

ORACLE: dict[str, str] = {
    "visible_by_bucket": _over(
        "object_inventory", extra=VISIBLE,
        sql="SELECT bucket, count(*) AS objects, min(key) AS first_key, max(key) AS last_key FROM visible GROUP BY bucket",
    ),
    "catalog_keys": _over(
        "object_inventory", extra=f"{VISIBLE}, {BUCKETS}",
        sql="SELECT bucket, key FROM buckets LEFT JOIN visible USING (bucket)",
    ),
    "catalog_summary": _over(
        "object_inventory", extra=f"{VISIBLE}, {BUCKETS}",
        sql="SELECT bucket, count(key) AS objects, min(key) AS first_key, max(key) AS last_key "
            "FROM buckets LEFT JOIN visible USING (bucket) GROUP BY bucket",
    ),
    "folders": _over(
        "object_inventory", extra=VISIBLE,
        sql="SELECT DISTINCT bucket, split_part(key, '/', 1) AS folder FROM visible WHERE contains(key, '/')",
    ),
    "root_files": _over(
        "object_inventory", extra=VISIBLE, sql="SELECT obj_id, bucket, key FROM visible WHERE NOT contains(key, '/')"
    ),
    "folder_listing": _over(
        "object_inventory", extra=VISIBLE,
        sql="SELECT obj_id, key, substr(key, 6) AS display FROM visible WHERE bucket = 'bronze' AND starts_with(key, 'src9/')",
    ),
    "datasets": _over(
        "object_inventory", extra=f"{VISIBLE}, {NESTED}, {PARTS}",
        sql="SELECT *, folder || '/' || dataset AS dataset_key, '📁 ' || dataset || ' (Dataset Spark)' AS display FROM parts",
    ),
    "folder_view": _over(
        "object_inventory", extra=f"{VISIBLE}, {NESTED}, {PARTS}",
        sql="SELECT bucket, '/' AS folder, key AS name, key AS display FROM visible WHERE NOT contains(key, '/') "
            "UNION ALL SELECT bucket, folder, first_key, '📁 ' || dataset || ' (Dataset Spark)' FROM parts "
            "UNION ALL SELECT bucket, folder, key, remainder FROM nested "
            "WHERE NOT (contains(remainder, 'part-') OR ends_with(remainder, '.parquet'))",
    ),
    "object_details": _over(
        "object_inventory",
        sql=f"SELECT obj_id, bucket, key AS filename, "
            f"CASE WHEN ends_with(key, '_SUCCESS') THEN '0 B' ELSE {_size('size_bytes')} END AS size, "
            f"CASE WHEN ends_with(key, '_SUCCESS') THEN 'Apache Spark' ELSE coalesce(uploader, 'Desconhecido') END AS uploader, "
            "CASE WHEN ends_with(key, '_SUCCESS') THEN '-' ELSE "
            "strftime(make_timestamp((1704067200 + obj_id * 3601) * 1000000), '%d/%m/%Y %H:%M:%S') END AS last_modified, "
            f"{TYPE} AS type, CASE {TYPE} WHEN 'info' THEN 'Metadado do Apache Spark.' "
            f"WHEN 'image' THEN 'http://localhost:9000/' || bucket || '/' || key "
            f"WHEN 'unknown' THEN 'Pré-visualização não disponível.' END AS preview_content FROM object_inventory",
    ),
    "image_objects": _over(
        "object_inventory",
        sql=f"SELECT obj_id, bucket, key, size_bytes, 'http://localhost:9000/' || bucket || '/' || key AS link "
            f"FROM object_inventory WHERE {TYPE} = 'image'",
    ),
    "script_names": _over(
        "object_inventory",
        sql="SELECT obj_id, key AS name, 'job_' || replace(key, '.csv', '') AS job_id FROM object_inventory "
            "WHERE ends_with(key, '.csv') AND NOT contains(key, '/') AND NOT starts_with(key, '.')",
    ),
    "folder_scripts": _over(
        "object_inventory",
        sql="SELECT obj_id, key, split_part(key, '/', 3) AS name FROM object_inventory "
            "WHERE regexp_matches(key, '^src9/notes/[^./][^/]*[13579]\\.csv$') OR regexp_matches(key, '^src9/notes/[13579]\\.csv$')",
    ),
    "upload_allowed": _over(
        "object_inventory",
        sql=f"SELECT obj_id, key, {EXT} IN ('csv', 'txt', 'png', 'jpg', 'jpeg') AS allowed FROM object_inventory",
    ),
    "uploader_totals": _over(
        "object_inventory", extra=LATEST,
        sql="SELECT i.bucket, coalesce(l.uploader, 'Desconhecido') AS uploader, count(*) AS objects, "
            "CAST(sum(i.size_bytes) AS BIGINT) AS total_bytes FROM object_inventory i "
            "LEFT JOIN latest l ON i.bucket = l.bucket AND i.key = l.key GROUP BY 1, 2",
    ),
    "inventory_table": _over(
        "object_inventory", extra=VISIBLE,
        sql="SELECT bucket, count(*) AS objects, min(key) AS first_key, max(key) AS last_key FROM visible "
            "GROUP BY bucket",
    ),
    "document_heads": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 10), chr(10)) AS head FROM documents",
    "host_capacity": _over("hosts", "containers", extra=CAPACITY, sql="SELECT * FROM capacity"),
    "profile_fit": _over("hosts", "containers", extra=f"{CAPACITY}, {FIT}", sql="SELECT * FROM fit"),
    "eligible_hosts": _over(
        "hosts", "containers", extra=f"{CAPACITY}, {FIT}",
        sql="SELECT host_id, profile, available_cpus, available_mem_gb FROM fit WHERE profile = 'extreme' AND fits",
    ),
    "master_lookup": _over(
        "containers",
        sql="SELECT host_id, min(name) AS name FROM containers WHERE status = 'running' AND contains(name, 'spark-master') GROUP BY 1",
    ),
    "profile_specs": """SELECT c_custkey, profile, CAST(CASE profile WHEN 'extreme' THEN 6 ELSE 2 END AS BIGINT) AS cores,
        CAST(CASE profile WHEN 'extreme' THEN 2 ELSE 1 END AS BIGINT) AS editor_gb,
        CAST(CASE profile WHEN 'extreme' THEN 6 ELSE 3 END AS BIGINT) AS worker_gb
        FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'extreme' ELSE lower(c_mktsegment) END AS profile FROM customer)""",
    "workspace_metrics": _over(
        "container_stats", "users",
        extra="newest AS (SELECT * FROM container_stats QUALIFY row_number() OVER "
              f"(PARTITION BY usuario, role ORDER BY ts DESC, event_id DESC) = 1), {_metrics('usuario')}",
        sql="SELECT usuario, coalesce(status, 'offline') AS status, cpu_percent, memory_usage_mb, memory_limit_mb, memory_percent "
            "FROM users LEFT JOIN metrics USING (usuario)",
    ),
    "online_status": _over(
        "container_stats", "users",
        sql="SELECT usuario, CASE WHEN usuario IN (SELECT usuario FROM container_stats) THEN 'online' ELSE 'offline' END AS status FROM users",
    ),
    "workspace_metrics_at": _over(
        "container_stats", "users",
        extra=f"{THEN}, newest AS (SELECT * FROM seen QUALIFY row_number() OVER "
              f"(PARTITION BY usuario, role ORDER BY ts DESC, event_id DESC) = 1), {_metrics('usuario')}",
        sql="SELECT usuario, coalesce(status, 'offline') AS status, cpu_percent, memory_usage_mb, memory_limit_mb, memory_percent "
            "FROM users LEFT JOIN metrics USING (usuario)",
    ),
    "online_at": _over(
        "container_stats", "users", extra=THEN,
        sql="SELECT usuario, CASE WHEN usuario IN (SELECT usuario FROM seen) THEN 'online' ELSE 'offline' END AS status FROM users",
    ),
    "cpu_delta": _over(
        "container_stats",
        sql="SELECT event_id, cpu_delta - coalesce(lag(cpu_delta) OVER w, 0) AS cpu_delta_step, "
            "system_delta - coalesce(lag(system_delta) OVER w, 0) AS system_delta_step FROM container_stats "
            "WINDOW w AS (PARTITION BY usuario, role ORDER BY ts, event_id)",
    ),
    "metric_history": _over(
        "container_stats",
        sql="SELECT usuario, ts, event_id, mem_usage FROM container_stats "
            "QUALIFY row_number() OVER (PARTITION BY usuario ORDER BY ts DESC, event_id DESC) <= 20",
    ),
    "container_payloads": _over(
        "container_stats",
        sql="SELECT event_id, ts, usuario, role, mem_usage, mem_cache, mem_limit, cpu_delta, "
            "CASE WHEN cpu_delta > 0 THEN system_delta ELSE 0 END AS system_delta, nano_cpus FROM container_stats",
    ),
    "idle_now": _over(
        "heartbeats",
        sql="SELECT usuario, max(ts) AS last_seen FROM heartbeats GROUP BY usuario "
            "HAVING TIMESTAMP '2024-01-31 00:00:00' - max(ts) > INTERVAL 900 SECOND",
    ),
    "idle_sessions": _over("heartbeats", extra=SESSIONS, sql="SELECT * FROM sessions"),
    "app_states": _over(
        "apps",
        sql="SELECT state, CASE WHEN state = 'FINISHED' THEN 'good' WHEN state IN ('FAILED', 'KILLED') THEN 'bad' ELSE 'pending' END AS class, "
            "count(*) AS apps FROM apps GROUP BY 1, 2",
    ),
    "recent_completed": _over(
        "apps",
        sql=f"SELECT app_id, name, user_id, state, {_duration('duration_ms')} AS duration FROM apps "
            "WHERE state IN ('FINISHED', 'FAILED', 'KILLED') ORDER BY start_ts DESC, app_id LIMIT 10",
    ),
    "app_durations": _over("apps", sql=f"SELECT app_id, {_duration('duration_ms')} AS duration FROM apps"),
    "job_progress": _over(
        "app_jobs", extra=PROGRESS,
        sql="SELECT app_id, job_id, tie1, tie2, total, completed, active, "
            "CAST(completed AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE AS completed_percent, "
            "CAST(active AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE AS active_percent, status_class FROM progress",
    ),
    "app_progress": _over(
        "apps", "app_jobs", extra=PROGRESS,
        sql="SELECT app_id, name, state, job_id, tie1, tie2, total, completed, status_class "
            "FROM apps LEFT JOIN progress USING (app_id)",
    ),
    "app_totals": _over(
        "apps", "app_jobs", extra=PROGRESS,
        sql="SELECT app_id, name, state, count(job_id) AS jobs, CAST(coalesce(sum(total), 0) AS BIGINT) AS tasks, "
            "CAST(coalesce(sum(completed), 0) AS BIGINT) AS completed, CAST(coalesce(sum(active), 0) AS BIGINT) AS active "
            "FROM apps LEFT JOIN progress USING (app_id) GROUP BY app_id, name, state",
    ),
    "driver_links": _over(
        "link_page",
        sql="SELECT page_id, rtrim(nullif(regexp_extract(html, "
            "'href=\"(http://[^\"]+)\">(Application Detail UI|Application UI)</a>', 1, 'i'), ''), '/') AS driver_url FROM link_page",
    ),
    "schedule_list": _over(
        "schedules",
        sql="SELECT 'job_' || replace(name, '.py', '') AS id, name, "
            "coalesce(strftime(next_run, '%d/%m/%Y %H:%M:%S'), 'Pausado') AS next_run FROM schedules",
    ),
    "driver_apps": _over(
        "apps",
        sql="SELECT app_id, CASE WHEN state <> 'FAILED' THEN 'app-' || CAST(app_id AS VARCHAR) END AS driver_app_id FROM apps",
    ),
    "cluster_snapshot": _over(
        "apps",
        sql="""SELECT 'worker' AS kind, CAST(floor(c_custkey / 200) AS BIGINT) AS snapshot_id, 'worker-' || CAST(c_custkey AS VARCHAR) AS worker_id,
            c_name AS host, 7000 + c_custkey % 1000 AS port, 1 + c_custkey % 8 AS cores, c_custkey % 4 AS coresused,
            1024 * (1 + c_custkey % 16) AS memory, 512 * (c_custkey % 8) AS memoryused, NULL AS app_id, NULL AS name, NULL AS user_id,
            NULL AS memoryperslave, NULL AS duration_ms, NULL AS state, NULL AS start_ts FROM customer
            UNION ALL SELECT CASE state WHEN 'RUNNING' THEN 'active' ELSE 'completed' END, CAST(floor(app_id / 2000) AS BIGINT), NULL, NULL, NULL,
            CASE state WHEN 'RUNNING' THEN 1 + app_id % 8 END, NULL, NULL, NULL, 'app-' || CAST(app_id AS VARCHAR), name, CAST(user_id AS VARCHAR),
            CASE state WHEN 'RUNNING' THEN 1024 * (app_id % 4) END, duration_ms, CASE WHEN state <> 'RUNNING' THEN state END,
            CASE WHEN state <> 'RUNNING' THEN CAST(start_ts AS TIMESTAMP) END FROM apps
            UNION ALL SELECT 'broken', -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
    ),
    "polled_recent": _over(
        "apps",
        sql=f"SELECT 'app-' || CAST(app_id AS VARCHAR) AS app_id, name, CAST(user_id AS VARCHAR) AS user_id, state, "
            f"{_duration('duration_ms')} AS duration FROM apps "
            "WHERE state IN ('FINISHED', 'FAILED', 'KILLED') ORDER BY start_ts DESC, 'app-' || CAST(app_id AS VARCHAR) LIMIT 10",
    ),
    "polled_states": _over(
        "apps",
        sql="SELECT state, CASE WHEN state = 'FINISHED' THEN 'good' ELSE 'bad' END AS class, count(*) AS apps FROM apps "
            "WHERE state <> 'RUNNING' GROUP BY 1, 2",
    ),
    "app_job_payloads": _over(
        "app_jobs", extra=PROGRESS,
        sql="SELECT 'app-' || CAST(CAST(floor(app_id / 2000) AS BIGINT) AS VARCHAR) AS app_id, app_id * 10 + job_id AS job_id, "
            "'job ' || CAST(tie1 AS VARCHAR) AS job_name, total, completed, active, "
            "CAST(active AS DOUBLE) / CAST(total AS DOUBLE) * 100.0::DOUBLE AS active_percent, status_class FROM progress "
            "UNION ALL SELECT 'app-cut', NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    ),
    "user_names": """SELECT c_custkey, u AS usuario, 'vscode-' || u AS editor, 'spark-worker-' || u AS worker
        FROM (SELECT c_custkey, lower(replace(replace(c_name, '#', ' '), ' ', '-')) AS u FROM customer)""",
    "event_props": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, "
                   "coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), 0) AS absent FROM events",
    "registry_upsert": _over("object_inventory", extra=LATEST, sql="SELECT * FROM latest"),
    "registry_merge": _over("object_inventory", extra=LATEST, sql="SELECT * FROM latest"),
    "registry_delete": _over(
        "object_inventory", extra=LATEST,
        sql="SELECT * FROM latest l WHERE NOT EXISTS (SELECT 1 FROM object_inventory d "
            "WHERE d.uploader IS NULL AND d.bucket = l.bucket AND d.key = l.key)",
    ),
    "registry_cancel": _over(
        "object_inventory",
        extra="k AS (SELECT DISTINCT bucket, key FROM object_inventory WHERE uploader IS NOT NULL), "
              "d AS (SELECT DISTINCT bucket, key FROM object_inventory WHERE uploader IS NULL)",
        sql="SELECT CASE WHEN d.key IS NULL THEN 'remaining' WHEN k.key IS NULL THEN 'unknown' ELSE 'removed' END AS outcome, "
            "coalesce(k.bucket, d.bucket) AS bucket, count(*) AS keys "
            "FROM k FULL JOIN d ON k.bucket = d.bucket AND k.key = d.key GROUP BY 1, 2",
    ),
    "silver_events": f"WITH {SILVER} SELECT event_id, ts, day, user_id, event_type, CAST(value AS DOUBLE) AS value, uploader FROM silver",
    "silver_failed": "SELECT event_id, CASE WHEN event_id % 59 = 0 THEN 'u?' ELSE CAST(user_id AS VARCHAR) END AS user_id, "
                     "CASE WHEN event_id % 53 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value, "
                     "concat_ws(',', CASE WHEN event_id % 59 = 0 THEN 'user_id' END, CASE WHEN event_id % 53 = 0 THEN 'value' END) AS failed "
                     "FROM events WHERE event_id % 59 = 0 OR event_id % 53 = 0",
    "gold_daily": f"WITH {SILVER} SELECT day, event_type, count(*) AS events, "
                  "CAST(sum(value) AS DOUBLE) AS total FROM silver GROUP BY 1, 2",
    "gold_by_batches": f"WITH {SILVER} SELECT day, event_type, count(*) AS events, "
                       "CAST(sum(value) AS DOUBLE) AS total FROM silver GROUP BY 1, 2",
    "text_file_previews": f"WITH {LAKE} SELECT part, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes, 'text' AS type, "
                          "array_to_string(list_slice(string_split(content, chr(10)), 1, 10), chr(10)) AS preview_content FROM lake",
    "landed_table": _over(
        "object_inventory", extra=LATEST,
        sql="SELECT obj_id, bucket, key, size_bytes, CASE WHEN uploader IS NULL THEN 'ana' ELSE 'bo' END AS uploader FROM latest",
    ),
    "listed_objects": f"WITH {LAKE}, {ODD} SELECT 'bronze' AS bucket, 'texts/part=' || CAST(part AS VARCHAR) || '/' AS key, "
                      "CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes FROM lake "
                      "UNION ALL SELECT 'silver', 'odd/' || name, CAST(size_bytes AS BIGINT) FROM odd",
    "indexed_objects": f"WITH {LAKE}, {ODD} SELECT 'bronze' AS bucket, 'texts/part=' || CAST(part AS VARCHAR) || '/' AS key, "
                       "CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes FROM lake "
                       "UNION ALL SELECT 'silver', 'odd/' || name, CAST(size_bytes AS BIGINT) FROM odd WHERE name = 'photo.jpeg'",
    "scanned_images": f"WITH {ODD}, d AS (SELECT count(*) FROM documents) SELECT 'silver' AS bucket, 'odd/' || name AS key, "
                      "CAST(size_bytes AS BIGINT) AS size_bytes FROM odd WHERE regexp_matches(name, '(?i)\\.(png|jpg|jpeg)$')",
    "landed_drops": f"WITH {ODD} SELECT 'ana' AS uploader, 'part' AS name, "
                    "CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS total_bytes FROM documents "
                    "UNION ALL SELECT 'bo', name, CAST(size_bytes AS BIGINT) FROM odd",
    "preview_csv": "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey), "
                   "'first' || chr(10) || 'second, \"' || c_name || '\"' AS note FROM customer ORDER BY c_custkey LIMIT 10",
    "preview_parquet": "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10",
    "preview_text": "SELECT c_name AS value FROM customer ORDER BY c_custkey LIMIT 10",
    "stream_idle": _over(
        "heartbeats", extra=SESSIONS,
        sql="SELECT * FROM sessions WHERE last_seen + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM heartbeats) - INTERVAL 10 MINUTE",
    ),
    "stream_metrics": _over(
        "container_stats",
        extra="windowed AS (SELECT *, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3000000) AS window_start FROM container_stats), "
              "newest AS (SELECT * FROM windowed QUALIFY row_number() OVER "
              f"(PARTITION BY usuario, window_start, role ORDER BY ts DESC, event_id DESC) = 1), {_metrics('usuario, window_start')}",
        sql="SELECT usuario, window_start, status, cpu_percent, memory_usage_mb, memory_limit_mb, memory_percent FROM metrics",
    ),
    "stream_last_seen": _over("heartbeats", sql="SELECT usuario, max(ts) AS last_seen FROM heartbeats GROUP BY usuario"),
    "stream_history": """WITH ends AS (SELECT user_id, max(ts) AS ended FROM events WHERE event_type = 'error' GROUP BY user_id)
        SELECT 'user-' || CAST(user_id AS VARCHAR) AS series, ts, event_id AS point_id, value FROM events LEFT JOIN ends USING (user_id)
        WHERE event_type <> 'error' AND (ended IS NULL OR ts > ended)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20""",
    "stream_landing": _over(
        "object_inventory", extra=LATEST,
        sql="SELECT obj_id, bucket, key, size_bytes, 'portal' AS uploader FROM latest",
    ),
    "stream_present": """WITH last AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS usuario, ts AS last_seen, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'error' DESC) = 1)
        SELECT usuario, last_seen FROM last WHERE event_type <> 'error'""",
    "stream_app_status": _over(
        "apps",
        sql="SELECT 'app-' || CAST(app_id AS VARCHAR) AS app_id, app_id % 2 = 1 OR state = 'RUNNING' AS active, "
            "CASE WHEN app_id % 2 = 1 THEN 'RUNNING' ELSE state END AS state, duration_ms FROM apps WHERE app_id % 2 = 1 OR app_id % 3 > 0",
    ),
    "stream_user_sessions": """WITH e AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS usuario, ts, event_type = 'error' AS gone,
          lag(ts) OVER w AS before, lag(event_type = 'error') OVER w AS was_gone, lead(ts) OVER w AS after, lead(event_type = 'error') OVER w AS goes
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'error')),
        beats AS (SELECT *, sum(CASE WHEN before IS NULL OR was_gone OR epoch_us(ts) - epoch_us(before) > 900000000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY usuario ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e WHERE NOT gone)
        SELECT usuario, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS beats,
          CASE WHEN arg_max(goes AND epoch_us(after) - epoch_us(ts) <= 900000000, ts) THEN 'shutdown' ELSE 'idle' END AS event
        FROM beats GROUP BY usuario, session""",
    "stream_drops": "SELECT 'bronze' AS bucket, 'portal' AS uploader, CAST(8 AS BIGINT) AS files, "
                    "CAST((SELECT sum(octet_length(encode(text)) + 1) FROM documents) + (SELECT sum(octet_length(encode(text)) + 1) FROM benchmark) AS BIGINT) "
                    "AS total_bytes",
}
