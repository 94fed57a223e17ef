"""The platform's relations (jobs, users, tags, events …) as views over the fixed tables.

Each view is a SELECT that Spark SQL and the oracle both understand, so queries and oracles start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "users": """
        SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'user' END AS role,
               CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE CAST(floor(c_custkey / 6) AS BIGINT) END AS team_id, c_acctbal > 0 AS is_active
        FROM customer""",
    "jobs": """
        SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS owner_id,
               'doc ' || CAST(o_custkey % 97 AS STRING) || CASE o_orderkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.eml'
                 WHEN 3 THEN '.xlsx' ELSE '.exe' END AS filename,
               CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'P' THEN 'FAILED' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'RUNNING' ELSE 'PENDING' END END AS status,
               o_orderdate AS created_at, o_orderkey % 1500 AS idle_s,
               CASE o_orderkey % 8 WHEN 0 THEN 'collection' WHEN 1 THEN 'benchmark' WHEN 2 THEN 'import' WHEN 3 THEN 'import_attachment'
                 WHEN 4 THEN 'mail_attachment' ELSE 'single' END AS mode,
               'F' || CAST(o_custkey % 5 AS STRING) AS folder, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ' s' || CAST(o_orderkey % 4 AS STRING) || ' /x' END AS subfolder,
               CASE WHEN o_orderkey % 9 = 0 THEN 'a/b_' || CAST(o_custkey % 3 AS STRING) || '/c' END AS storage_folder,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 7 END AS page_count, o_orderkey % 4 AS structure_pages,
               CASE WHEN o_orderkey % 10 = 0 THEN o_custkey % 50 END AS run_id, CAST(floor(o_totalprice * 100) AS BIGINT) AS upload_size,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE '# ' || o_orderpriority END AS markdown,
               o_orderkey % 5 AS body, o_custkey % 97 AS name_no, o_totalprice / 1000 AS duration_s,
               CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS grade, o_orderkey % 6 = 1 AS used_fallback,
               CASE o_orderkey % 7 WHEN 0 THEN 'vl:7' WHEN 1 THEN 'tiny' WHEN 2 THEN 'small' WHEN 3 THEN 'medium' WHEN 4 THEN 'medium_structured' END AS profile_id
        FROM orders""",
    "job_tags": "SELECT DISTINCT l_orderkey AS job_id, l_suppkey % 25 AS tag_id FROM lineitem",
    "tags": "SELECT n_nationkey AS tag_id, lower(n_name) AS name FROM nation",
    "parts": """
        SELECT l_orderkey AS mail_id, l_linenumber AS part_index, CASE WHEN l_partkey % 3 = 0 THEN 'job' WHEN l_partkey % 3 = 1 THEN 'inline' ELSE 'skipped' END AS outcome,
               CASE WHEN l_partkey % 3 = 0 THEN l_orderkey END AS job_id, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'part ' || CAST(l_partkey % 50 AS STRING) || '.pdf' END AS filename,
               CAST(l_quantity * 1000 AS BIGINT) AS size_bytes FROM lineitem""",
    "logs": """
        SELECT event_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'WARNING' WHEN 'error' THEN 'ERROR' ELSE 'CRITICAL' END AS level,
               'worker-' || CAST(user_id % 4 AS STRING) AS worker, props AS message FROM events""",
    "sources": """
        SELECT s_suppkey AS source_id, s_suppkey % 4 <> 0 AS enabled, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey * 17 % 2000 END AS interval_s,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey * 31 % 1800 END AS since_s FROM supplier""",
    "pushes": """
        SELECT l_orderkey * 10 + l_linenumber AS push_id, l_orderkey AS job_id, l_suppkey % 3 AS connection_id, CASE l_returnflag WHEN 'A' THEN 'finished' WHEN 'N' THEN 'pending' ELSE 'failed' END AS status,
               l_shipdate AS created_at, CAST(l_partkey % 4 AS STRING) AS pushed_body FROM lineitem""",
    "deliveries": """
        SELECT event_id AS delivery_id, user_id % 40 AS owner_id, event_id % 6 AS attempts,
               CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 503 END AS http_status, event_type AS event FROM events""",
}

TABLES = ("customer", "supplier", "orders", "lineitem", "nation", "events", "documents", "pages", "conversations", "part", "region")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or table as a DataFrame; nothing is registered in the catalog beyond temporary names."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in text}
    for t, df in used.items():
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """``sql`` preceded by the views that it names."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if not heads:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
