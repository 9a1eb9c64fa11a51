"""Queries over run history (listings, retention, audits) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.canonical import committed_uri, content_fingerprint, staging_uri
from quern.functions.states import ATTEMPT_STATES, UNIT_STATES
from quern.history import audit, listings, retention
from quern.queries.views import Registry, by_run, view
from quern.sources.publication import abort_rows, committed_only, first_commit
from quern.sources.shared import Scratch
from quern.sources.snapshots import Snapshots

R = Registry({}, {})
NOW = "TIMESTAMP '2002-01-01 00:00:00'"
EVENT_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
DAY = 86_400
WINDOWS = retention.Windows(run_s=400 * DAY, event_s=5 * DAY, staging_s=300 * DAY, committed_s=500 * DAY)
TERMINAL = "('SUCCEEDED', 'FAILED', 'CANCELLED')"
OWNED = f"""
    SELECT a.*, r.status AS run_status, r.finished_at AS run_finished_at, t.status AS attempt_status, t.finished_at AS attempt_finished_at,
           CASE WHEN t.status IN {TERMINAL} THEN t.finished_at + INTERVAL 300 DAY END AS staging_at,
           CASE WHEN a.state = 'COMMITTED' AND r.status IN {TERMINAL} AND r.finished_at IS NOT NULL AND a.finished_at IS NOT NULL
                THEN GREATEST(r.finished_at + INTERVAL 400 DAY, a.finished_at + INTERVAL 500 DAY) END AS committed_due
    FROM h_artifacts a JOIN h_runs r ON r.run_id = a.run_id
    JOIN h_attempts t ON t.run_id = a.run_id AND t.unit_key = a.node_id AND t.attempt_number = a.attempt_number"""
TARGETS = f"""
    SELECT run_id, node_id, attempt_number, 'STAGING' AS target_kind, staging_uri AS uri, staging_at AS eligible_at FROM owned WHERE staging_at <= {NOW}
    UNION ALL
    SELECT run_id, node_id, attempt_number, 'COMMITTED', committed_uri, committed_due FROM owned WHERE committed_due <= {NOW}"""


def ts(literal: str):
    return F.expr(literal)


def owned(spark: SparkSession, d: str) -> DataFrame:
    return retention.with_owners(view(spark, d, "h_artifacts"), view(spark, d, "h_runs"), view(spark, d, "h_attempts"))


# C1 to C16


@R.add("c1_paged_listing", "SELECT * FROM h_pipelines WHERE tenant_id = 'BUILDING' ORDER BY created_at, pipeline_id LIMIT 100 OFFSET 20", "h_pipelines")
def c1(spark, d):
    return listings.page(view(spark, d, "h_pipelines"), ["created_at", "pipeline_id"], 100, 20, tenant_id="BUILDING")


@R.add("c2_versions", "SELECT * FROM h_versions ORDER BY pipeline_id, version", "h_versions")
def c2(spark, d):
    return listings.children(view(spark, d, "h_versions"), ["pipeline_id", "version"])


@R.add("c3_next_version", "SELECT c.c_custkey AS pipeline_id, CAST(COALESCE(MAX(v.version), 0) + 1 AS INT) AS next_version FROM customer c LEFT JOIN h_versions v ON v.pipeline_id = c.c_custkey GROUP BY c.c_custkey", "h_versions")
def c3(spark, d):
    parents = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("pipeline_id"))
    return listings.next_version(view(spark, d, "h_versions"), parents, "pipeline_id", "version")


@R.add("c3_number_new", """
    SELECT o.o_custkey AS pipeline_id, o.o_orderkey AS version_id,
           CAST(m.top + ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS INT) AS version
    FROM orders o JOIN (SELECT pipeline_id, MAX(version) AS top FROM h_versions GROUP BY pipeline_id) m ON m.pipeline_id = o.o_custkey
    WHERE o.o_orderstatus = 'P'""", "h_versions")  # fmt: skip
def c3b(spark, d):
    new = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("pipeline_id"), F.col("o_orderkey").alias("version_id"))
    return listings.number_new(view(spark, d, "h_versions"), new, "pipeline_id", "version", ["version_id"])


@R.add("c4_newest", "SELECT version_id, pipeline_id, version, spec_tag, created_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pipeline_id ORDER BY version DESC) AS n FROM h_versions) q WHERE n = 1", "h_versions")
def c4(spark, d):
    return listings.newest(view(spark, d, "h_versions"), ["pipeline_id"], "version")


@R.add("c5_newest_of_one", "SELECT v.* FROM h_versions v JOIN h_pipelines p ON p.pipeline_id = v.pipeline_id WHERE p.name = 'Customer#000000001' ORDER BY v.version DESC LIMIT 1", "h_versions", "h_pipelines")
def c5(spark, d):
    named = view(spark, d, "h_versions").join(view(spark, d, "h_pipelines").select("pipeline_id", "name"), "pipeline_id")
    return listings.newest_of(named, "version", name="Customer#000000001").select("version_id", "pipeline_id", "version", "spec_tag", "created_at")


@R.add("c6_default", """
    SELECT 'default' AS cluster_profile, CAST(0 AS BIGINT) AS n WHERE NOT EXISTS (SELECT 1 FROM h_units WHERE cluster_profile = 'default')
    UNION ALL SELECT cluster_profile, COUNT(*) FROM h_units GROUP BY cluster_profile""", "h_units")  # fmt: skip
def c6(spark, d):
    stored = view(spark, d, "h_units").groupBy("cluster_profile").agg(F.count("*").alias("n"))
    return listings.with_default(stored, spark.createDataFrame([("default", 0)], "cluster_profile string, n long"), "cluster_profile")


@R.add("c7_active_runs", f"SELECT * FROM h_runs WHERE status NOT IN {TERMINAL} ORDER BY created_at, run_id", "h_runs")
def c7(spark, d):
    return listings.active(view(spark, d, "h_runs"), ["created_at", "run_id"])


@R.add("c8_recoverable_units", f"SELECT * FROM h_units WHERE status NOT IN {TERMINAL} ORDER BY created_at, run_id, unit_key", "h_units")
def c8(spark, d):
    return listings.active(view(spark, d, "h_units"), ["created_at", "run_id", "unit_key"])


@R.add("c9_units_of_runs", "SELECT * FROM h_units ORDER BY run_id, created_at, unit_key", "h_units")
def c9a(spark, d):
    return listings.children(view(spark, d, "h_units"), ["run_id", "created_at", "unit_key"])


@R.add("c9_attempts_of_units", "SELECT * FROM h_attempts ORDER BY run_id, unit_key, attempt_number", "h_attempts")
def c9b(spark, d):
    return listings.children(view(spark, d, "h_attempts"), ["run_id", "unit_key", "attempt_number"])


@R.add("c9_events_of_runs", "SELECT * FROM h_events ORDER BY run_id, event_id", "h_events")
def c9c(spark, d):
    return listings.children(view(spark, d, "h_events"), ["run_id", "event_id"])


@R.add("c10_current_attempt", "SELECT u.run_id, u.unit_key, a.attempt_number, u.status AS unit_status, a.status, a.error_code, a.external_job_id, a.finished_at, a.size_bytes FROM h_units u JOIN h_attempts a ON a.run_id = u.run_id AND a.unit_key = u.unit_key AND a.attempt_number = u.current_attempt", "h_units", "h_attempts")
def c10(spark, d):
    return listings.current_attempts(view(spark, d, "h_units"), view(spark, d, "h_attempts"), ["run_id", "unit_key"])


@R.add("c11_attempt_run", "SELECT a.run_id, a.unit_key, a.attempt_number, a.status, u.cluster_profile FROM h_attempts a JOIN h_units u ON u.run_id = a.run_id AND u.unit_key = a.unit_key", "h_units", "h_attempts")
def c11(spark, d):
    found = listings.attempt_runs(view(spark, d, "h_units"), view(spark, d, "h_attempts"), ["run_id", "unit_key"])
    return found.select("run_id", "unit_key", "attempt_number", "status", "cluster_profile")


@R.add("c12_artifacts", "SELECT * FROM h_artifacts ORDER BY run_id, node_id, attempt_number", "h_artifacts")
def c12(spark, d):
    return listings.children(view(spark, d, "h_artifacts"), ["run_id", "node_id", "attempt_number"])


@R.add("c13_latest_job", """
    SELECT run_id, unit_key, external_job_id AS latest_job_id FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, unit_key ORDER BY attempt_number DESC) AS n FROM h_attempts
      WHERE external_job_id IS NOT NULL AND external_job_id <> '') q WHERE n = 1""", "h_attempts")  # fmt: skip
def c13(spark, d):
    return listings.latest_job(view(spark, d, "h_attempts"), ["run_id", "unit_key"])


@R.add("c14_artifacts_by_unit", "SELECT run_id, node_id, CAST(COUNT(*) AS INT) AS n, STRING_AGG(CONCAT(CAST(attempt_number AS STRING), ':', state), ',' ORDER BY attempt_number) AS states FROM h_artifacts GROUP BY run_id, node_id", "h_artifacts")
def c14(spark, d):
    found = listings.artifacts_by_unit(view(spark, d, "h_artifacts"), ["run_id", "node_id"], ["attempt_number", "state"])
    each = F.transform("artifacts", lambda x: F.concat_ws(":", x["attempt_number"].cast("string"), x["state"]))
    return found.select("run_id", "node_id", F.size("artifacts").alias("n"), F.array_join(each, ",").alias("states"))


@R.add("c15_diagnostics", """
    WITH t AS (SELECT run_id, unit_key, COUNT(*) AS attempts FROM h_attempts GROUP BY run_id, unit_key),
         f AS (SELECT run_id, node_id, COUNT(*) AS artifacts FROM h_artifacts GROUP BY run_id, node_id),
         x AS (SELECT run_id, COUNT(*) AS events, MIN(event_id) AS first_event, MAX(event_id) AS last_event FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS n FROM h_events) q WHERE n <= 20 GROUP BY run_id)
    SELECT r.run_id, r.status, p.name AS pipeline_name, v.version, u.unit_key, u.status AS unit_status,
           CAST(t.attempts AS INT) AS attempts, CAST(f.artifacts AS INT) AS artifacts, CAST(x.events AS INT) AS events, x.first_event, x.last_event
    FROM h_runs r LEFT JOIN h_versions v ON v.version_id = r.version_id LEFT JOIN h_pipelines p ON p.pipeline_id = v.pipeline_id
    JOIN h_units u ON u.run_id = r.run_id LEFT JOIN t ON t.run_id = u.run_id AND t.unit_key = u.unit_key
    LEFT JOIN f ON f.run_id = u.run_id AND f.node_id = u.unit_key LEFT JOIN x ON x.run_id = r.run_id""", "h_runs", "h_versions", "h_pipelines", "h_units", "h_attempts", "h_artifacts", "h_events")  # fmt: skip
def c15(spark, d):
    v = {n: view(spark, d, f"h_{n}") for n in ("versions", "pipelines", "events")}
    dealt = ("runs", "units", "attempts", "artifacts")
    v |= dict(zip(dealt, by_run(spark, d, *(f"h_{n}" for n in dealt)), strict=True))
    found = listings.diagnostics(**v, last=20).select("run_id", "status", "pipeline_name", "version", F.explode("units").alias("u"), "events")
    return found.select("run_id", "status", "pipeline_name", "version", "u.unit_key", F.col("u.status").alias("unit_status"), F.size("u.attempts").alias("attempts"), F.size("u.artifacts").alias("artifacts"),
                        F.size("events").alias("events"), F.try_element_at("events", F.lit(1))["event_id"].alias("first_event"), F.try_element_at("events", F.lit(-1))["event_id"].alias("last_event"))


@R.add("c16_last_events", "SELECT event_id, run_id, event_type, created_at, value, props FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS n FROM h_events) q WHERE n <= 5", "h_events")
def c16(spark, d):
    return listings.last_events(view(spark, d, "h_events"), 5)


# C17 to C27

OWNED_VIEWS = ("h_artifacts", "h_runs", "h_attempts")


@R.add("c17_retention_candidates", f"WITH owned AS ({OWNED}) SELECT run_id, node_id, attempt_number, state, run_status, attempt_status FROM owned WHERE staging_at <= {NOW} OR committed_due <= {NOW} ORDER BY finished_at, run_id, node_id, attempt_number LIMIT 256", *OWNED_VIEWS)
def c17(spark, d):
    found = retention.candidates(owned(spark, d), WINDOWS, ts(NOW), ["finished_at", *retention.KEYS], 256)
    return found.select("run_id", "node_id", "attempt_number", "state", "run_status", "attempt_status")


@R.add("c18_keyset_scan", "SELECT * FROM h_runs WHERE created_at > TIMESTAMP '1998-01-01 00:00:00' OR (created_at = TIMESTAMP '1998-01-01 00:00:00' AND run_id > 500) ORDER BY created_at, run_id LIMIT 256", "h_runs")
def c18(spark, d):
    import datetime

    return retention.after(view(spark, d, "h_runs"), ["created_at", "run_id"], (datetime.datetime(1998, 1, 1), 500), 256)


@R.add("c19_deletion_targets", f"WITH owned AS ({OWNED}) {TARGETS}", *OWNED_VIEWS)
def c19(spark, d):
    return retention.targets(owned(spark, d), WINDOWS, ts(NOW))


@R.add("c20_upsert_targets", f"""
    WITH owned AS ({OWNED}), found AS ({TARGETS})
    SELECT COALESCE(k.run_id, f.run_id) AS run_id, COALESCE(k.node_id, f.node_id) AS node_id, COALESCE(k.attempt_number, f.attempt_number) AS attempt_number,
           COALESCE(k.target_kind, f.target_kind) AS target_kind,
           CASE WHEN f.uri IS NOT NULL AND COALESCE(k.state, '') <> 'DELETED' THEN f.uri ELSE k.uri END AS uri,
           CASE WHEN f.uri IS NOT NULL AND COALESCE(k.state, '') <> 'DELETED' THEN f.eligible_at ELSE k.eligible_at END AS eligible_at,
           COALESCE(k.attempts, 0) AS attempts, COALESCE(k.state, 'PENDING') AS state
    FROM h_gc_targets k FULL OUTER JOIN found f ON f.run_id = k.run_id AND f.node_id = k.node_id AND f.attempt_number = k.attempt_number AND f.target_kind = k.target_kind""", "h_gc_targets", *OWNED_VIEWS)  # fmt: skip
def c20(spark, d):
    known, *owners = by_run(spark, d, "h_gc_targets", *OWNED_VIEWS)
    return retention.upsert_targets(known, retention.targets(retention.with_owners(*owners), WINDOWS, ts(NOW)))


CHANGES = "run_id % 40 = 7"


@R.add("c20_next_version", f"""
    SELECT run_id, node_id, attempt_number, target_kind, CASE WHEN {CHANGES} THEN CONCAT(uri, '/moved') ELSE uri END AS uri, eligible_at, attempts, state FROM h_gc_targets
    WHERE NOT ({CHANGES} AND attempts > 1)""", "h_gc_targets")  # fmt: skip
def c20_next(spark, d):
    """Targets of some runs get another address, some go: the next version of the table rewrites the partitions of these runs only, and is read."""
    known = view(spark, d, "h_gc_targets")
    known = known.select("run_id", "node_id", "attempt_number", "target_kind", "uri", "eligible_at", "attempts", "state")
    kept = Snapshots(spark, Scratch(spark, "targets").base, ["run_id"])
    kept.create(known)
    some = kept.read().filter(CHANGES)
    moved = some.filter("attempts <= 1").withColumn("uri", F.concat("uri", F.lit("/moved")))
    kept.change(moved, some.select("run_id"))
    return kept.read()


@R.add("c21_work_queue", f"SELECT * FROM h_gc_work WHERE state <> 'DELETED' AND eligible_at <= {NOW} ORDER BY updated_at, eligible_at, run_id, node_id, attempt_number, target_kind LIMIT 64", "h_gc_work")
def c21(spark, d):
    return retention.work(view(spark, d, "h_gc_work"), ts(NOW), ["updated_at", "eligible_at", *retention.KEYS, "target_kind"], 64)


BLOCKED = f"""
    owned AS ({OWNED}),
    in_use AS (SELECT DISTINCT i.input_uri AS uri FROM h_inputs i JOIN h_runs r ON r.run_id = i.run_id WHERE r.status NOT IN {TERMINAL}),
    blocked AS (
      SELECT k.*, CASE WHEN o.run_id IS NULL THEN 'artifact metadata no longer exists'
        WHEN k.target_kind = 'STAGING' THEN CASE
          WHEN o.attempt_status NOT IN {TERMINAL} OR o.attempt_finished_at IS NULL THEN 'attempt is not terminal'
          WHEN o.attempt_finished_at + INTERVAL 300 DAY > {NOW} THEN 'staging retention window has not elapsed' END
        WHEN o.state <> 'COMMITTED' THEN 'artifact is not committed'
        WHEN o.run_status NOT IN {TERMINAL} OR o.run_finished_at IS NULL THEN 'owning run is not terminal'
        WHEN o.run_finished_at + INTERVAL 400 DAY > {NOW} THEN 'run retention window has not elapsed'
        WHEN o.finished_at IS NULL OR o.finished_at + INTERVAL 500 DAY > {NOW} THEN 'artifact retention window has not elapsed'
        WHEN u.uri IS NOT NULL THEN 'committed artifact is referenced by an active run' END AS reason
      FROM h_gc_targets k LEFT JOIN owned o ON o.run_id = k.run_id AND o.node_id = k.node_id AND o.attempt_number = k.attempt_number
      LEFT JOIN in_use u ON u.uri = k.uri)"""


def blocked(spark: SparkSession, d: str, with_owners: DataFrame | None = None) -> DataFrame:
    used = retention.active_references(view(spark, d, "h_inputs"), view(spark, d, "h_runs"))
    return retention.block_reasons(view(spark, d, "h_gc_targets"), with_owners or owned(spark, d), used, WINDOWS, ts(NOW))


@R.add("c22_block_reason", f"WITH {BLOCKED} SELECT run_id, node_id, attempt_number, target_kind, reason FROM blocked", "h_gc_targets", "h_inputs", *OWNED_VIEWS)
def c22(spark, d):
    return blocked(spark, d).select("run_id", "node_id", "attempt_number", "target_kind", "reason")


@R.add("c23_active_references", f"SELECT DISTINCT i.input_uri AS uri FROM h_inputs i JOIN h_runs r ON r.run_id = i.run_id WHERE r.status NOT IN {TERMINAL}", "h_inputs", "h_runs")
def c23(spark, d):
    plans = view(spark, d, "h_inputs").groupBy("run_id", "unit_key").agg(F.collect_list(F.struct(F.col("input_uri").alias("uri"))).alias("input_artifacts"))
    return retention.active_references(retention.input_addresses(plans, "input_artifacts"), view(spark, d, "h_runs"))


OLD = f"SELECT run_id FROM h_runs WHERE status IN {TERMINAL} AND finished_at + INTERVAL 400 DAY <= {EVENT_NOW}"


@R.add("c24_prunable_events", f"SELECT COUNT(*) AS n FROM h_events e WHERE e.created_at + INTERVAL 5 DAY <= {EVENT_NOW} AND e.run_id IN ({OLD})", "h_events", "h_runs")
def c24(spark, d):
    return retention.prunable_events(view(spark, d, "h_events"), view(spark, d, "h_runs"), WINDOWS, ts(EVENT_NOW)).agg(F.count("*").alias("n"))


@R.add("c25_prune_events", f"SELECT e.* FROM h_events e LEFT JOIN ({OLD}) o ON o.run_id = e.run_id WHERE o.run_id IS NULL OR e.created_at + INTERVAL 5 DAY > {EVENT_NOW}", "h_events", "h_runs")
def c25(spark, d):
    return retention.prune_events(view(spark, d, "h_events"), view(spark, d, "h_runs"), WINDOWS, ts(EVENT_NOW))


def processed(spark: SparkSession, d: str, with_owners: DataFrame | None = None) -> DataFrame:
    """Targets after a pass in which deletions of every seventh run failed with a long message."""
    rows = blocked(spark, d, with_owners).filter("state <> 'DELETED'")
    return rows.withColumns({"error": F.when(F.col("run_id") % 7 == 0, F.concat(F.lit("no access to "), F.repeat("uri", 40))), "deleted_at": F.lit(None).cast("timestamp"), "objects": (F.col("run_id") % 5).cast("long")})


STATES = f"""
    {BLOCKED}, pass AS (
      SELECT b.*, CASE WHEN run_id % 7 = 0 THEN CONCAT('no access to ', REPEAT(uri, 40)) END AS error, run_id % 5 AS objects
      FROM blocked b WHERE state <> 'DELETED'),
    states AS (
      SELECT run_id, node_id, attempt_number, target_kind, uri, eligible_at, CAST(attempts + CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS INT) AS attempts,
             CASE WHEN reason IS NOT NULL THEN 'BLOCKED' WHEN error IS NOT NULL THEN 'FAILED' ELSE 'DELETED' END AS state,
             SUBSTRING(COALESCE(reason, error), 1, 1000) AS last_error,
             CASE WHEN reason IS NULL AND error IS NULL THEN {NOW} END AS deleted_at, objects FROM pass)"""


@R.add("c26_deletion_report", f"""
    WITH {STATES}, found AS ({TARGETS}) SELECT COUNT(*) AS processed_targets, CAST(COUNT(CASE WHEN state = 'DELETED' THEN 1 END) AS BIGINT) AS deleted_targets,
    CAST(COUNT(CASE WHEN state = 'BLOCKED' THEN 1 END) AS BIGINT) AS blocked_targets, CAST(COUNT(CASE WHEN state = 'FAILED' THEN 1 END) AS BIGINT) AS failed_targets,
    CAST(COALESCE(SUM(CASE WHEN state = 'DELETED' THEN objects END), 0) AS BIGINT) AS objects_deleted,
    (SELECT COUNT(*) FROM owned WHERE staging_at <= {NOW} OR committed_due <= {NOW}) AS scanned_artifacts, (SELECT COUNT(*) FROM found) AS discovered_targets,
    (SELECT COUNT(*) FROM h_events e WHERE e.created_at + INTERVAL 5 DAY <= {EVENT_NOW} AND e.run_id IN ({OLD})) AS events_pruned FROM states""", "h_gc_targets", "h_inputs", "h_events", *OWNED_VIEWS)  # fmt: skip
def c26(spark, d):
    known = Scratch(spark, "owned").save(owned(spark, d).drop("staging_uri", "committed_uri", "size_bytes"), "owned")  # computed once: three parts of the report read it
    with_uris = known.withColumns({"staging_uri": F.lit(None).cast("string"), "committed_uri": F.lit(None).cast("string")})  # targets are only counted
    scanned = retention.candidates(known, WINDOWS, ts(NOW), ["finished_at", *retention.KEYS])
    pruned = retention.prunable_events(view(spark, d, "h_events"), view(spark, d, "h_runs"), WINDOWS, ts(EVENT_NOW))
    return retention.report(retention.target_states(processed(spark, d, known), ts(NOW)), scanned, retention.targets(with_uris, WINDOWS, ts(NOW)), pruned)


@R.add("c27_target_states", f"WITH {STATES} SELECT run_id, node_id, attempt_number, target_kind, uri, eligible_at, attempts, state, last_error, deleted_at FROM states", "h_gc_targets", "h_inputs", *OWNED_VIEWS)
def c27(spark, d):
    return retention.target_states(processed(spark, d), ts(NOW)).drop("objects")


# C28 to C35


@R.add("c28_slots", """
    SELECT cluster_profile, CAST(COUNT(CASE WHEN state = 'ADMITTED' THEN 1 END) AS BIGINT) AS admitted, CAST(COUNT(CASE WHEN state = 'WAITING' THEN 1 END) AS BIGINT) AS waiting
    FROM h_admissions GROUP BY ROLLUP (cluster_profile)""", "h_admissions")  # fmt: skip
def c28(spark, d):
    return listings.slots(view(spark, d, "h_admissions"))


@R.add("c29_last_sequence", "SELECT run_id, CAST(COALESCE(MAX(admission_sequence), 0) AS BIGINT) AS last_sequence FROM h_admissions GROUP BY run_id", "h_admissions")
def c29(spark, d):
    return listings.last_sequences(view(spark, d, "h_admissions"))


@R.add("c30_constraints", """
    SELECT 'node ids are unique' AS rule, CONCAT(CAST(pipeline_id AS STRING), '/', CAST(node_id AS STRING)) AS key FROM h_nodes GROUP BY pipeline_id, node_id HAVING COUNT(*) > 1
    UNION ALL SELECT 'edges are unique', CONCAT(CAST(pipeline_id AS STRING), '/', CAST(src AS STRING), '/', CAST(dst AS STRING), '/', kind) FROM h_edges GROUP BY pipeline_id, src, dst, kind HAVING COUNT(*) > 1
    UNION ALL SELECT 'attempts are unique', CONCAT(CAST(run_id AS STRING), '/', unit_key, '/', CAST(attempt_number AS STRING)) FROM h_attempts GROUP BY run_id, unit_key, attempt_number HAVING COUNT(*) > 1
    UNION ALL SELECT 'edges lead to nodes', CONCAT(CAST(e.pipeline_id AS STRING), '/', CAST(e.dst AS STRING)) FROM h_edges e WHERE NOT EXISTS (SELECT 1 FROM h_nodes n WHERE n.pipeline_id = e.pipeline_id AND n.node_id = e.dst)
    UNION ALL SELECT 'events belong to runs', CAST(e.event_id AS STRING) FROM h_events e WHERE e.run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h_runs r WHERE r.run_id = e.run_id)
    UNION ALL SELECT 'unit states are known', CONCAT(CAST(run_id AS STRING), '/', unit_key) FROM h_units WHERE status NOT IN ('PENDING', 'READY', 'SUBMITTING', 'RUNNING', 'RETRY_WAIT', 'SUCCEEDED', 'FAILED', 'CANCELLED', 'UNKNOWN')
    UNION ALL SELECT 'attempt states are known', CONCAT(CAST(run_id AS STRING), '/', unit_key, '/', CAST(attempt_number AS STRING)) FROM h_attempts WHERE status NOT IN ('PENDING', 'SUBMITTING', 'RUNNING', 'SUCCEEDED', 'FAILED', 'CANCELLED', 'UNKNOWN')
    UNION ALL SELECT 'artifact sizes are not negative', CONCAT(CAST(run_id AS STRING), '/', node_id, '/', CAST(attempt_number AS STRING)) FROM h_artifacts WHERE NOT size_bytes >= 0
    UNION ALL SELECT 'one committed artifact per output', CONCAT(CAST(run_id AS STRING), '/', node_id) FROM h_artifacts WHERE state = 'COMMITTED' GROUP BY run_id, node_id HAVING COUNT(*) > 1
    """, "h_nodes", "h_edges", "h_attempts", "h_events", "h_runs", "h_units", "h_artifacts")  # fmt: skip
def c30(spark, d):
    v = {n: view(spark, d, f"h_{n}") for n in ("nodes", "edges", "attempts", "events", "runs", "units", "artifacts")}
    ends = v["nodes"].select("pipeline_id", F.col("node_id").alias("dst"))
    return audit.audit(
        audit.duplicates(v["nodes"], "node ids are unique", ["pipeline_id", "node_id"]),
        audit.duplicates(v["edges"], "edges are unique", ["pipeline_id", "src", "dst", "kind"]),
        audit.duplicates(v["attempts"], "attempts are unique", ["run_id", "unit_key", "attempt_number"]),
        audit.orphans(v["edges"], ends, "edges lead to nodes", ["pipeline_id", "dst"]),
        audit.orphans(v["events"], v["runs"], "events belong to runs", ["run_id"], ["event_id"]),
        audit.failing(v["units"], "unit states are known", F.col("status").isin(*UNIT_STATES), ["run_id", "unit_key"]),
        audit.failing(v["attempts"], "attempt states are known", F.col("status").isin(*ATTEMPT_STATES), ["run_id", "unit_key", "attempt_number"]),
        audit.failing(v["artifacts"], "artifact sizes are not negative", F.col("size_bytes") >= 0, ["run_id", "node_id", "attempt_number"]),
        audit.duplicates(v["artifacts"].filter("state = 'COMMITTED'"), "one committed artifact per output", ["run_id", "node_id"]),
    )


@R.add("c31_reconcile_admissions", f"""
    WITH u AS (SELECT run_id, unit_key, cluster_profile AS u_profile, status AS u_status, created_at AS u_created FROM h_units),
    j AS (SELECT COALESCE(a.run_id, u.run_id) AS run_id, COALESCE(a.unit_key, u.unit_key) AS unit_key, a.cluster_profile, a.state, a.admission_sequence, a.queued_at, u_profile, u_status, u_created,
                 a.state IN ('WAITING', 'ADMITTED') AND u_status NOT IN ('READY', 'SUBMITTING', 'RUNNING', 'RETRY_WAIT', 'UNKNOWN') AS gone
          FROM h_admissions a FULL OUTER JOIN u ON u.run_id = a.run_id AND u.unit_key = a.unit_key),
    k AS (SELECT *, CASE WHEN gone THEN 'RELEASED' ELSE state END AS state1 FROM j),
    x AS (SELECT *, CASE WHEN u_status IN ('SUBMITTING', 'RUNNING', 'RETRY_WAIT', 'UNKNOWN') AND COALESCE(state1, '') <> 'ADMITTED' THEN 'RECOVERED'
                         WHEN u_status = 'READY' AND (state IS NULL OR state = 'RELEASED') THEN 'QUEUED'
                         WHEN gone THEN 'RELEASED' ELSE 'KEPT' END AS action FROM k),
    top AS (SELECT COALESCE(MAX(admission_sequence), 0) AS last FROM h_admissions),
    y AS (SELECT x.*, CASE WHEN action = 'RECOVERED' THEN 'ADMITTED' WHEN action = 'QUEUED' THEN 'WAITING' ELSE state1 END AS next_state,
                 CASE WHEN action = 'RECOVERED' THEN (SELECT last FROM top) + ROW_NUMBER() OVER (PARTITION BY action ORDER BY u_created, unit_key, run_id) ELSE admission_sequence END AS seq FROM x)
    SELECT run_id, unit_key, CASE WHEN action = 'RECOVERED' OR state IS NULL THEN u_profile ELSE cluster_profile END AS cluster_profile, next_state AS state,
           CAST(seq AS BIGINT) AS admission_sequence, CASE WHEN action = 'QUEUED' OR state IS NULL THEN {NOW} ELSE queued_at END AS queued_at, action
    FROM y WHERE next_state IS NOT NULL""", "h_admissions", "h_units")  # fmt: skip
def c31(spark, d):
    return listings.reconcile_admissions(*by_run(spark, d, "h_admissions", "h_units"), ts(NOW))


CANDIDATES = """
    SELECT a.run_id, a.unit_key, a.cluster_profile, a.queued_at, u.created_at AS unit_created_at, r.created_at AS run_created_at
    FROM h_admissions a JOIN h_units u ON u.run_id = a.run_id AND u.unit_key = a.unit_key JOIN h_runs r ON r.run_id = a.run_id
    WHERE a.state = 'WAITING' AND u.status = 'READY' AND r.status = 'RUNNING'"""


@R.add("c32_candidates", f"{CANDIDATES} ORDER BY run_created_at, run_id, queued_at, unit_created_at, unit_key", "h_admissions", "h_units", "h_runs")
def c32(spark, d):
    found = listings.candidates(view(spark, d, "h_admissions"), view(spark, d, "h_units"), view(spark, d, "h_runs"))
    return found.orderBy("run_created_at", "run_id", "queued_at", "unit_created_at", "unit_key")


@R.add("c33_admissions", "SELECT * FROM h_admissions ORDER BY admission_sequence NULLS LAST, queued_at, run_id, unit_key", "h_admissions")
def c33(spark, d):
    return listings.in_sequence(view(spark, d, "h_admissions"), ["queued_at", "run_id", "unit_key"])


@R.add("c34_targets", "SELECT * FROM h_gc_targets ORDER BY eligible_at, run_id, node_id, attempt_number, target_kind", "h_gc_targets")
def c34(spark, d):
    return listings.children(view(spark, d, "h_gc_targets"), ["eligible_at", "run_id", "node_id", "attempt_number", "target_kind"])


@R.add("c35_revisions", "SELECT p.name, v.version, v.spec_tag, v.created_at FROM h_versions v JOIN h_pipelines p ON p.pipeline_id = v.pipeline_id ORDER BY p.name, v.version", "h_versions", "h_pipelines")
def c35(spark, d):
    named = view(spark, d, "h_versions").join(view(spark, d, "h_pipelines").select("pipeline_id", "name"), "pipeline_id")
    return listings.children(named.select("name", "version", "spec_tag", "created_at"), ["name", "version"])


# B: the parts of publication that are queries over the artifacts table


@R.add("b2_paths", "SELECT run_id, node_id, attempt_number, staging_uri, committed_uri FROM h_artifacts", "h_artifacts")
def b2(spark, d):
    a = view(spark, d, "h_artifacts").select("run_id", "node_id", "attempt_number")
    return a.withColumns({"staging_uri": staging_uri("s3://b", F.col("run_id"), F.col("node_id"), F.col("attempt_number")), "committed_uri": committed_uri("s3://b", F.col("run_id"), F.col("node_id"))})


@R.add("b4_fingerprint", "SELECT run_id, node_id, SHA256(STRING_AGG(CONCAT(staging_uri, CAST(size_bytes AS STRING), COALESCE(CASE WHEN attempt_number % 2 = 0 THEN state END, '')), '' ORDER BY staging_uri)) AS content_hash FROM h_artifacts GROUP BY run_id, node_id", "h_artifacts")
def b4(spark, d):
    a = view(spark, d, "h_artifacts").withColumn("etag", F.expr("CASE WHEN attempt_number % 2 = 0 THEN state END"))
    return a.groupBy("run_id", "node_id").agg(content_fingerprint(F.col("staging_uri"), F.col("size_bytes"), F.col("etag")).alias("content_hash"))


FIRST = """
    SELECT run_id, unit_key, attempt_number, CASE WHEN NOT ok THEN 'STAGING' WHEN ROW_NUMBER() OVER (PARTITION BY run_id, unit_key, ok ORDER BY attempt_number) = 1 THEN 'COMMITTED' ELSE 'ABORTED' END AS state
    FROM (SELECT *, status = 'SUCCEEDED' AS ok FROM h_attempts) q"""


@R.add("b7_first_commit", FIRST, "h_attempts")
def b7(spark, d):
    staged = view(spark, d, "h_attempts").select("run_id", "unit_key", "attempt_number", "status", F.lit("STAGING").alias("state"))
    return first_commit(staged, ["run_id", "unit_key"], ["attempt_number"], "status = 'SUCCEEDED'").drop("status")


@R.add("b8_abort", f"SELECT run_id, unit_key, attempt_number, CASE WHEN state = 'STAGING' AND status IN ('FAILED', 'CANCELLED') THEN 'ABORTED' ELSE state END AS state FROM (SELECT f.*, a.status FROM ({FIRST}) f JOIN h_attempts a ON a.run_id = f.run_id AND a.unit_key = f.unit_key AND a.attempt_number = f.attempt_number) q", "h_attempts")
def b8(spark, d):
    staged = view(spark, d, "h_attempts").select("run_id", "unit_key", "attempt_number", "status", F.lit("STAGING").alias("state"))
    return abort_rows(first_commit(staged, ["run_id", "unit_key"], ["attempt_number"], "status = 'SUCCEEDED'"), "status in ('FAILED', 'CANCELLED')").drop("status")


@R.add("b10_committed", "SELECT run_id, node_id, attempt_number, committed_uri FROM h_artifacts WHERE state = 'COMMITTED'", "h_artifacts")
def b10(spark, d):
    return committed_only(view(spark, d, "h_artifacts")).select("run_id", "node_id", "attempt_number", "committed_uri")
