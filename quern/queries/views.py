"""Run-history tables derived from the given tables, as SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "conversations", "embeddings")

#: Name, names of the views it reads, SQL.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "h_pipelines": ((), """
        SELECT c.c_custkey AS pipeline_id, c.c_mktsegment AS tenant_id, c.c_name AS name,
               MIN(o.o_orderdate) AS created_at
        FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
        GROUP BY c.c_custkey, c.c_mktsegment, c.c_name"""),
    "h_versions": ((), """
        SELECT o_orderkey AS version_id, o_custkey AS pipeline_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version,
               o_orderpriority AS spec_tag, o_orderdate AS created_at
        FROM orders"""),
    "h_runs": ((), """
        SELECT o.o_orderkey AS run_id, o.o_orderkey AS version_id,
               CASE WHEN o.o_orderstatus = 'F' THEN 'SUCCEEDED'
                    WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN 'CANCELLED'
                    WHEN o.o_orderstatus = 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status,
               o.o_orderdate AS created_at,
               CASE WHEN o.o_orderstatus <> 'O' THEN m.last_ship END AS finished_at
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) m
          ON m.l_orderkey = o.o_orderkey"""),
    "h_units": ((), """
        SELECT l_orderkey AS run_id,
               CONCAT('unit-', LPAD(CAST(l_linenumber AS STRING), 3, '0')) AS unit_key,
               l_linenumber AS unit_no,
               LAG(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS depends_on,
               CONCAT('profile-', CAST(MIN(l_suppkey) % 4 AS STRING)) AS cluster_profile,
               CASE WHEN MAX(l_linestatus) = 'F' AND MIN(l_returnflag) = 'A' THEN 'SUCCEEDED'
                    WHEN MAX(l_linestatus) = 'F' AND MIN(l_returnflag) = 'N' THEN 'FAILED'
                    WHEN MAX(l_linestatus) = 'F' THEN 'CANCELLED'
                    WHEN MIN(l_returnflag) = 'A' THEN 'PENDING'
                    WHEN MIN(l_returnflag) = 'N' THEN 'READY' ELSE 'RUNNING' END AS status,
               CAST(COUNT(*) AS INT) AS current_attempt,
               MIN(l_shipdate) AS created_at
        FROM lineitem
        GROUP BY l_orderkey, l_linenumber"""),
    "h_attempts": ((), """
        SELECT l_orderkey AS run_id,
               CONCAT('unit-', LPAD(CAST(l_linenumber AS STRING), 3, '0')) AS unit_key,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
                    ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS attempt_number,
               CASE WHEN l_linestatus = 'O' THEN 'RUNNING' WHEN l_returnflag = 'A' THEN 'SUCCEEDED'
                    WHEN l_returnflag = 'N' THEN 'FAILED' ELSE 'CANCELLED' END AS status,
               CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN
                    CASE WHEN l_partkey % 4 = 0 THEN 'USER_CODE_ERROR'
                         WHEN l_partkey % 4 = 1 THEN 'CLUSTER_UNAVAILABLE'
                         WHEN l_partkey % 4 = 2 THEN 'EXTERNAL_JOB_NOT_FOUND'
                         ELSE 'OTHER' END END AS error_code,
               CASE WHEN l_suppkey % 3 <> 0 THEN CONCAT('job-', CAST(l_partkey AS STRING)) END AS external_job_id,
               CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS finished_at,
               CAST(FLOOR(l_extendedprice) AS BIGINT) AS size_bytes
        FROM lineitem"""),
    "h_artifacts": (("h_attempts",), """
        SELECT run_id, unit_key AS node_id, attempt_number, size_bytes,
               CASE WHEN status = 'SUCCEEDED' AND ROW_NUMBER() OVER (PARTITION BY run_id, unit_key, status
                         ORDER BY attempt_number) = 1 THEN 'COMMITTED'
                    WHEN status = 'RUNNING' THEN 'STAGING' ELSE 'ABORTED' END AS state,
               CONCAT('s3://b/runs/', CAST(run_id AS STRING), '/artifacts/', unit_key, '/attempts/',
                      LPAD(CAST(attempt_number AS STRING), 3, '0'), '/data') AS staging_uri,
               CONCAT('s3://b/runs/', CAST(run_id AS STRING), '/artifacts/', unit_key, '/committed') AS committed_uri,
               finished_at
        FROM h_attempts"""),
    "h_inputs": (("h_units",), """
        SELECT run_id, unit_key, status AS unit_status,
               CONCAT('s3://b/runs/', CAST(run_id AS STRING), '/artifacts/unit-',
                      LPAD(CAST(depends_on AS STRING), 3, '0'), '/committed') AS input_uri
        FROM h_units WHERE depends_on IS NOT NULL"""),
    "h_admissions": (("h_units",), """
        SELECT run_id, unit_key, cluster_profile, created_at AS queued_at,
               CASE WHEN status IN ('RUNNING', 'SUCCEEDED') THEN 'ADMITTED'
                    WHEN status = 'READY' AND run_id % 2 = 0 THEN 'WAITING' ELSE 'RELEASED' END AS state,
               CASE WHEN status IN ('RUNNING', 'SUCCEEDED')
                    THEN CAST(run_id * 10 + unit_no AS BIGINT) END AS admission_sequence
        FROM h_units WHERE (run_id + unit_no) % 5 <> 0"""),
    "h_gc_targets": (("h_attempts", "h_artifacts"), """
        SELECT run_id, node_id, attempt_number,
               CASE WHEN state = 'COMMITTED' THEN 'COMMITTED' ELSE 'STAGING' END AS target_kind,
               CASE WHEN state = 'COMMITTED' THEN committed_uri ELSE staging_uri END AS uri,
               finished_at AS eligible_at, CAST(run_id % 3 AS INT) AS attempts,
               CASE WHEN run_id % 4 = 0 THEN 'DELETED' WHEN run_id % 4 = 1 THEN 'BLOCKED'
                    WHEN run_id % 4 = 2 THEN 'FAILED' ELSE 'PENDING' END AS state
        FROM h_artifacts WHERE finished_at IS NOT NULL AND attempt_number = 1"""),
    "h_gc_work": (("h_gc_targets",), "SELECT *, eligible_at + INTERVAL '1' DAY * attempts AS updated_at FROM h_gc_targets"),
    "h_nodes": ((), "SELECT l_orderkey AS pipeline_id, l_linenumber AS node_id, l_returnflag AS kind FROM lineitem"),
    "h_edges": ((), """
        SELECT l_orderkey AS pipeline_id, l_linenumber AS src, CAST(l_partkey % 7 + 1 AS INT) AS dst,
               CASE WHEN l_suppkey % 3 = 0 THEN 'control' ELSE 'data' END AS kind,
               CASE WHEN l_returnflag = 'R' THEN 'checkpoint' ELSE 'none' END AS boundary
        FROM lineitem"""),
    "h_events": ((), "SELECT event_id, user_id AS run_id, event_type, ts AS created_at, value, props FROM events"),
}


def with_views(sql: str, *names: str) -> str:
    """`sql` after a WITH clause that defines the named views and those they read."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for below in VIEWS[name][0]:
            add(below)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in wanted)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {body[len('WITH'):]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """A history table as a lazy DataFrame; the given tables are arguments of its SQL, so the session's views stay as they are. `dealt` names the column by which a given table is dealt out before it is used (see `by_run`)."""
    sql = with_views(f"SELECT * FROM {name}", name)
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    given = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: df.repartition(dealt[t]) if t in (dealt or {}) else df for t, df in given.items()})


def by_run(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Views whose line items are dealt out by run, once: windows, groups and joins on the run and more need no further shuffle.

    Views that use the same columns share that one shuffle too. For joins this takes a session setting, which holds on.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return [view(spark, sf_dir, n, {"lineitem": "l_orderkey"}) for n in names]


@dataclass
class Registry:
    """Queries and oracles of one module."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]]
    oracles: dict[str, str]

    def add(self, name: str, sql: str | None = None, *names: str):
        """Register the decorated query; `sql` may read the named views."""

        def put(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = with_views(sql, *names)
            return f

        return put
