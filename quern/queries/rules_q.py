"""Queries for the rules over whole tables (selection, roll-ups, retries, metrics, catalogue) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import metrics
from quern.functions.canonical import canonical_fingerprint, log_row
from quern.functions.retry import Retries, api_error, api_retryable, job_error, job_retryable, job_state
from quern.functions.states import moves
from quern.history import audit, listings
from quern.operators import matching, rollup, selection
from quern.plans import catalogue, segments
from quern.queries.history_q import CANDIDATES, TERMINAL
from quern.queries.views import Registry, table, view
from quern.sources.shared import Scratch
from quern.streaming.latest import latest_states, run_to_now

R = Registry({}, {})

FAIR = f"""
    WITH c AS ({CANDIDATES}), s AS (SELECT run_id, COALESCE(MAX(admission_sequence), 0) AS last_sequence FROM h_admissions GROUP BY run_id),
    q AS (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY c.run_id ORDER BY queued_at, unit_created_at, unit_key) AS round, COALESCE(s.last_sequence, 0) AS last_sequence
          FROM c LEFT JOIN s ON s.run_id = c.run_id)
    SELECT run_id, unit_key, cluster_profile, CAST(round AS INT) AS round, CAST(last_sequence AS BIGINT) AS last_sequence
    FROM q ORDER BY round, last_sequence, run_created_at, run_id LIMIT 200"""


def candidates(spark, d):
    return listings.candidates(view(spark, d, "h_admissions"), view(spark, d, "h_units"), view(spark, d, "h_runs"))


@R.add("d1_fair_take", FAIR, "h_admissions", "h_units", "h_runs")
def d1(spark, d):
    last = listings.last_sequences(view(spark, d, "h_admissions"))
    found = selection.fair_take(candidates(spark, d), "run_id", ["queued_at", "unit_created_at", "unit_key"], ["run_created_at"], 200, last)
    return found.select("run_id", "unit_key", "cluster_profile", "round", "last_sequence")


@R.add("d2_fair_take_capped")
def d2(spark, d):
    last = listings.last_sequences(view(spark, d, "h_admissions"))
    free = {"profile-0": 20, "profile-1": 50}
    found = selection.fair_take_capped(candidates(spark, d), "run_id", "cluster_profile", ["queued_at", "unit_created_at", "unit_key"], ["run_created_at"], 200, free, last)
    return found.select("run_id", "unit_key", "cluster_profile", "sequence")


@R.add("d3_rotating_slice", """
    WITH p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created_at, run_id) - 1 AS pos, COUNT(*) OVER () AS n FROM h_runs)
    SELECT run_id, version_id, status, created_at, finished_at FROM p WHERE (pos - (n - 60) + n) % n < 128""", "h_runs")  # fmt: skip
def d3(spark, d):
    runs = view(spark, d, "h_runs")
    return selection.rotating_slice(runs, ["created_at", "run_id"], runs.count() - 60, 128)[0]


@R.add("d4_ready", """
    SELECT u.* FROM h_units u LEFT JOIN h_units p ON p.run_id = u.run_id AND p.unit_no = u.depends_on
    WHERE u.status = 'PENDING' AND (u.depends_on IS NULL OR p.status = 'SUCCEEDED')""", "h_units")  # fmt: skip
def d4(spark, d):
    return rollup.ready_units(view(spark, d, "h_units"), "depends_on")


@R.add("d4_missing_dependencies", """
    WITH e AS (SELECT pipeline_id AS run_id, src AS unit_no, dst AS dep FROM h_edges),
    u AS (SELECT DISTINCT run_id, unit_no, dep FROM e)
    SELECT u.run_id, u.unit_no, u.dep FROM u WHERE NOT EXISTS (SELECT 1 FROM h_units n WHERE n.run_id = u.run_id AND n.unit_no = u.dep)""", "h_edges", "h_units")  # fmt: skip
def d4b(spark, d):
    needs = view(spark, d, "h_edges").groupBy(F.col("pipeline_id").alias("run_id"), F.col("src").alias("unit_no")).agg(F.collect_set("dst").alias("needs"))
    units = view(spark, d, "h_units").join(needs, ["run_id", "unit_no"], "left")
    return rollup.missing_dependencies(units, "needs")


@R.add("d5_cancel_propagation", """
    WITH RECURSIVE hit AS (
      SELECT u.run_id, u.unit_no FROM h_units u JOIN h_units p ON p.run_id = u.run_id AND p.unit_no = u.depends_on
      WHERE u.status = 'PENDING' AND p.status IN ('FAILED', 'CANCELLED')
      UNION SELECT u.run_id, u.unit_no FROM h_units u JOIN hit h ON h.run_id = u.run_id AND h.unit_no = u.depends_on WHERE u.status = 'PENDING')
    SELECT u.run_id, u.unit_key, u.unit_no, u.depends_on, u.cluster_profile, CASE WHEN h.run_id IS NOT NULL THEN 'CANCELLED' ELSE u.status END AS status, u.current_attempt, u.created_at
    FROM h_units u LEFT JOIN hit h ON h.run_id = u.run_id AND h.unit_no = u.unit_no""", "h_units")  # fmt: skip
def d5(spark, d):
    units = Scratch(spark, "units").save(view(spark, d, "h_units"), "units")  # computed once: five steps read it
    return rollup.cancelled_by_upstream(units, "depends_on")


@R.add("d6_run_states", f"""
    WITH g AS (SELECT run_id, BOOL_AND(status = 'SUCCEEDED') AS ok, BOOL_AND(status IN {TERMINAL}) AS over_, BOOL_OR(status = 'FAILED') AS failed, BOOL_OR(status = 'CANCELLED') AS cancelled FROM h_units GROUP BY run_id)
    SELECT run_id, CASE WHEN ok THEN 'SUCCEEDED' WHEN over_ AND (failed OR cancelled) THEN 'FAILED' END AS status,
           CASE WHEN NOT ok AND over_ AND failed THEN 'EXECUTION_UNIT_FAILED' WHEN NOT ok AND over_ AND cancelled THEN 'EXECUTION_UNIT_CANCELLED' END AS reason FROM g""", "h_units")  # fmt: skip
def d6(spark, d):
    return rollup.run_states(view(spark, d, "h_units"))


@R.add("d7_cancel_runs", """
    SELECT u.run_id, u.unit_key, u.unit_no, u.depends_on, u.cluster_profile,
           CASE WHEN r.status = 'CANCELLED' AND u.status IN ('PENDING', 'READY', 'RETRY_WAIT') THEN 'CANCELLED' ELSE u.status END AS status, u.current_attempt, u.created_at
    FROM h_units u LEFT JOIN h_runs r ON r.run_id = u.run_id""", "h_units", "h_runs")  # fmt: skip
def d7(spark, d):
    return rollup.cancel_runs(view(spark, d, "h_units"), view(spark, d, "h_runs"))


@R.add("d8_forbidden_transitions", """
    WITH s AS (SELECT run_id, event_id, event_type, LAG(event_type) OVER (PARTITION BY run_id ORDER BY created_at, event_id) AS before FROM h_events)
    SELECT * FROM s WHERE before IS NOT NULL AND CONCAT(before, '>', event_type) NOT IN ('signup>view', 'view>click', 'click>purchase', 'view>error', 'click>error')""", "h_events")  # fmt: skip
def d8(spark, d):
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error"), ("click", "error")], "before string, after string")
    return audit.forbidden_transitions(view(spark, d, "h_events"), ["run_id"], "event_type", ["created_at", "event_id"], allowed=allowed).select("run_id", "event_id", "event_type", "before")


@R.add("d8_attempt_moves", """
    WITH s AS (SELECT run_id, unit_key, attempt_number, status, LAG(status) OVER (PARTITION BY run_id, unit_key ORDER BY attempt_number) AS before FROM h_attempts)
    SELECT run_id, unit_key, attempt_number, status, before FROM s
    WHERE before IS NOT NULL AND NOT (before = 'RUNNING' AND status IN ('SUCCEEDED', 'FAILED', 'CANCELLED', 'UNKNOWN'))""", "h_attempts")  # fmt: skip
def d8b(spark, d):
    """The states of a unit's attempts, read as one history: which moves does the table of moves forbid? Of its states only RUNNING can be left."""
    found = audit.forbidden_transitions(view(spark, d, "h_attempts"), ["run_id", "unit_key"], "status", ["attempt_number"], allowed=moves(spark, "attempt").select("before", "after"))
    return found.select("run_id", "unit_key", "attempt_number", "status", "before")


@R.add("d9_snapshot_changes", """
    SELECT run_id, node_id, attempt_number, CASE WHEN run_id % 50 = 1 THEN 'identity changed' WHEN run_id % 50 = 2 THEN 'deleted' ELSE 'state may not change so' END AS violation
    FROM h_artifacts WHERE run_id % 50 IN (1, 2) OR (run_id % 50 = 0 AND state = 'ABORTED')""", "h_artifacts")  # fmt: skip
def d9(spark, d):
    new = view(spark, d, "h_artifacts")
    old = new.withColumn("state", F.expr("CASE WHEN run_id % 50 = 0 AND state = 'ABORTED' THEN 'COMMITTED' ELSE state END"))
    old = old.withColumn("committed_uri", F.expr("CASE WHEN run_id % 50 = 1 THEN concat(committed_uri, '2') ELSE committed_uri END"))
    return audit.snapshot_changes(old, new.filter("run_id % 50 <> 2"), ["run_id", "node_id", "attempt_number"], ["staging_uri", "committed_uri"], "state")


@R.add("d9_append_only", "SELECT event_id, CASE WHEN event_id % 100 = 3 THEN 'deleted' ELSE 'changed' END AS violation FROM h_events WHERE event_id % 100 IN (3, 4)", "h_events")
def d9b(spark, d):
    old = view(spark, d, "h_events")
    new = old.filter("event_id % 100 <> 3").withColumn("event_type", F.expr("CASE WHEN event_id % 100 = 4 THEN 'other' ELSE event_type END"))
    return audit.appended_only(old, new, ["event_id"])


@R.add("d10_retry_class", """
    WITH a AS (SELECT *, CASE WHEN size_bytes % 5 = 0 THEN TRUE WHEN size_bytes % 5 = 1 THEN FALSE END AS flag FROM h_attempts)
    SELECT run_id, unit_key, attempt_number,
      CASE WHEN attempt_number >= 3 THEN FALSE WHEN flag IS NOT NULL THEN flag WHEN error_code = 'USER_CODE_ERROR' THEN FALSE
           WHEN error_code IN ('CLUSTER_UNAVAILABLE', 'EXTERNAL_JOB_NOT_FOUND') THEN TRUE ELSE status = 'UNKNOWN' END AS retries_job,
      CASE WHEN attempt_number >= 3 THEN FALSE WHEN error_code = 'USER_CODE_ERROR' THEN FALSE WHEN error_code IN ('CLUSTER_UNAVAILABLE', 'EXTERNAL_JOB_NOT_FOUND') THEN TRUE ELSE flag END AS retries_error
    FROM a""", "h_attempts")  # fmt: skip
def d10(spark, d):
    flag = F.expr("CASE WHEN size_bytes % 5 = 0 THEN true WHEN size_bytes % 5 = 1 THEN false END")
    a = view(spark, d, "h_attempts").withColumn("flag", flag)
    n, code = F.col("attempt_number"), F.col("error_code")
    return a.select("run_id", "unit_key", "attempt_number", Retries().retries_job(n, F.col("flag"), code, F.col("status")).alias("retries_job"), Retries().retries_error(n, F.col("flag"), code).alias("retries_error"))


@R.add("d11_retry_time", "SELECT run_id, unit_key, attempt_number, LEAST(30.0 * POWER(2, attempt_number - 1), 600.0)::DOUBLE AS backoff_s, finished_at + INTERVAL 1 SECOND * CAST(LEAST(30 * POWER(2, attempt_number - 1), 600) AS INT) AS retry_at FROM h_attempts", "h_attempts")
def d11(spark, d):
    n = F.col("attempt_number")
    return view(spark, d, "h_attempts").select("run_id", "unit_key", "attempt_number", Retries().backoff(n).alias("backoff_s"), Retries().retry_at(F.col("finished_at"), n).alias("retry_at"))


RAW = "CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN (CASE WHEN event_id % 2 = 0 THEN 'ValidationFailed' ELSE 'FAILED' END) WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'initializing' ELSE 'odd' END"


@R.add("d12_job_states", f"""
    WITH e AS (SELECT event_id, {RAW} AS raw, CASE WHEN event_id % 3 = 0 THEN 'OOM' END AS reason FROM h_events)
    SELECT event_id, raw, CASE raw WHEN 'running' THEN 'RUNNING' WHEN 'ValidationFailed' THEN 'FAILED' WHEN 'FAILED' THEN 'FAILED' WHEN 'complete' THEN 'SUCCEEDED' WHEN 'initializing' THEN 'PENDING' ELSE 'UNKNOWN' END AS state,
      CASE WHEN raw = 'ValidationFailed' THEN 'INVALID_PLAN' WHEN reason IS NOT NULL THEN reason WHEN raw = 'FAILED' THEN 'RAY_JOB_FAILED' END AS error_code,
      CASE WHEN raw = 'ValidationFailed' THEN FALSE END AS retryable FROM e""", "h_events")  # fmt: skip
def d12(spark, d):
    e = view(spark, d, "h_events").select("event_id", F.expr(RAW).alias("raw"), F.expr("CASE WHEN event_id % 3 = 0 THEN 'OOM' END").alias("reason"))
    return e.select("event_id", "raw", job_state(F.col("raw")).alias("state"), job_error(F.col("raw"), F.col("reason")).alias("error_code"), job_retryable(F.col("raw")).alias("retryable"))


STATUS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(400 + CAST(FLOOR(value) AS INT) % 130 AS INT) END"


@R.add("d13_api_errors", f"""
    WITH e AS (SELECT event_id, {STATUS} AS status FROM h_events)
    SELECT event_id, status, status IS NULL OR status IN (408, 429) OR status >= 500 AS retryable,
      CASE WHEN status = 422 THEN 'INVALID_PLAN' WHEN status IS NULL OR status IN (408, 429) OR status >= 500 THEN 'API_UNAVAILABLE' ELSE 'KUBERNETES_API_ERROR' END AS error_code FROM e""", "h_events")  # fmt: skip
def d13(spark, d):
    e = view(spark, d, "h_events").select("event_id", F.expr(STATUS).alias("status"))
    return e.select("event_id", "status", api_retryable(F.col("status")).alias("retryable"), api_error(F.col("status")).alias("error_code"))


@R.add("d14_counts", "SELECT event_type, COUNT(*) AS n FROM h_events GROUP BY event_type", "h_events")
def d14(spark, d):
    return metrics.counts(view(spark, d, "h_events"), "event_type")


@R.add("d14_durations", """
    WITH e AS (SELECT event_type, GREATEST(value - 10, 0) AS d FROM h_events), b AS (SELECT UNNEST([1.0, 5.0, 10.0, 50.0, 'Infinity'::DOUBLE]) AS le)
    SELECT event_type, b.le, CAST(COUNT(CASE WHEN d <= b.le THEN 1 END) AS BIGINT) AS count, CAST(COUNT(*) AS BIGINT) AS n, CAST(ROUND(SUM(d) * 100) AS BIGINT) AS total_cents FROM e, b GROUP BY event_type, b.le""", "h_events")  # fmt: skip
def d14b(spark, d):
    found = metrics.durations(view(spark, d, "h_events"), F.col("value") - 10, "event_type", bounds=(1.0, 5.0, 10.0, 50.0))
    return found.select("event_type", "le", "count", "n", F.round(F.col("total") * 100).cast("long").alias("total_cents"))


@R.add("d15_catalogue_faults", """
    WITH n AS (SELECT DISTINCT pipeline_id, node_id FROM h_nodes)
    SELECT pipeline_id, 'duplicate node' AS fault, CAST(node_id AS STRING) AS subject FROM h_nodes GROUP BY pipeline_id, node_id HAVING COUNT(*) > 1
    UNION ALL SELECT DISTINCT e.pipeline_id, 'unknown node', CONCAT(CAST(src AS STRING), '>', CAST(dst AS STRING)) FROM h_edges e
      WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.pipeline_id = e.pipeline_id AND n.node_id = e.src) OR NOT EXISTS (SELECT 1 FROM n WHERE n.pipeline_id = e.pipeline_id AND n.node_id = e.dst)
    UNION ALL SELECT DISTINCT pipeline_id, 'self edge', CONCAT(CAST(src AS STRING), '>', CAST(dst AS STRING)) FROM h_edges WHERE src = dst
    UNION ALL SELECT DISTINCT pipeline_id, 'repeated edge', CONCAT(CAST(src AS STRING), '>', CAST(dst AS STRING)) FROM (SELECT pipeline_id, src, dst, kind FROM h_edges GROUP BY ALL HAVING COUNT(*) > 1) q
    UNION ALL SELECT DISTINCT pipeline_id, 'checkpoint on control edge', CONCAT(CAST(src AS STRING), '>', CAST(dst AS STRING)) FROM h_edges WHERE kind = 'control' AND boundary = 'checkpoint'
    UNION ALL SELECT pipeline_id, 'fan-in', CAST(dst AS STRING) FROM h_edges WHERE kind = 'data' GROUP BY pipeline_id, dst HAVING COUNT(*) > 1""", "h_nodes", "h_edges")  # fmt: skip
def d15(spark, d):
    return catalogue.faults(view(spark, d, "h_nodes"), view(spark, d, "h_edges"))


@R.add("d15_cycles", """
    WITH RECURSIVE e AS (SELECT DISTINCT pipeline_id, src, dst FROM h_edges),
    walk AS (SELECT pipeline_id, src, dst FROM e UNION SELECT w.pipeline_id, w.src, e.dst FROM walk w JOIN e ON e.pipeline_id = w.pipeline_id AND e.src = w.dst),
    loops AS (SELECT DISTINCT pipeline_id, src AS node FROM walk WHERE src = dst)
    SELECT DISTINCT n.pipeline_id, n.src AS node FROM e n
    WHERE EXISTS (SELECT 1 FROM loops l WHERE l.pipeline_id = n.pipeline_id AND (l.node = n.src OR EXISTS (SELECT 1 FROM walk a WHERE a.pipeline_id = n.pipeline_id AND a.src = l.node AND a.dst = n.src)))
      AND EXISTS (SELECT 1 FROM loops l WHERE l.pipeline_id = n.pipeline_id AND (l.node = n.src OR EXISTS (SELECT 1 FROM walk b WHERE b.pipeline_id = n.pipeline_id AND b.src = n.src AND b.dst = l.node)))""", "h_edges")  # fmt: skip
def d15b(spark, d):
    return catalogue.cyclic_nodes(view(spark, d, "h_edges"))


@R.add("d16_segments", """
    WITH RECURSIVE p AS (
      SELECT u.run_id, u.unit_no, CASE WHEN q.cluster_profile = u.cluster_profile THEN u.depends_on END AS parent
      FROM h_units u LEFT JOIN h_units q ON q.run_id = u.run_id AND q.unit_no = u.depends_on),
    s AS (SELECT run_id, unit_no, unit_no AS segment FROM p WHERE parent IS NULL
          UNION ALL SELECT p.run_id, p.unit_no, s.segment FROM p JOIN s ON s.run_id = p.run_id AND s.unit_no = p.parent)
    SELECT run_id AS pipeline_id, unit_no AS node, segment FROM s""", "h_units")  # fmt: skip
def d16(spark, d):
    return unit_segments(saved_units(spark, d))


def saved_units(spark, d):
    """The columns that segments need, computed once: the view's window and aggregation run over all line items, and several steps read it."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # else the shuffles of all steps stay on disk together
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # as in `by_run`
    return Scratch(spark, "units").save(view(spark, d, "h_units").select("run_id", "unit_no", "depends_on", "cluster_profile"), "units")


def unit_segments(units):
    units = units.repartition("run_id")  # runs are small: joins on the run and a unit need no further shuffle
    nodes = units.select(F.col("run_id").alias("pipeline_id"), F.col("unit_no").alias("node_id"), "cluster_profile")
    edges = units.filter("depends_on is not null").select(F.col("run_id").alias("pipeline_id"), F.col("depends_on").alias("src"), F.col("unit_no").alias("dst"), F.lit("data").alias("kind"), F.lit("none").alias("boundary"))
    return segments.segments(segments.edge_parents(nodes, edges, ["cluster_profile"]))


@R.add("d16_segment_edges", """
    WITH RECURSIVE p AS (
      SELECT u.run_id, u.unit_no, u.depends_on, CASE WHEN q.cluster_profile = u.cluster_profile THEN u.depends_on END AS parent
      FROM h_units u LEFT JOIN h_units q ON q.run_id = u.run_id AND q.unit_no = u.depends_on),
    s AS (SELECT run_id, unit_no, unit_no AS segment FROM p WHERE parent IS NULL
          UNION ALL SELECT p.run_id, p.unit_no, s.segment FROM p JOIN s ON s.run_id = p.run_id AND s.unit_no = p.parent)
    SELECT DISTINCT p.run_id AS pipeline_id, a.segment AS before, b.segment AS after FROM p
    JOIN s a ON a.run_id = p.run_id AND a.unit_no = p.depends_on JOIN s b ON b.run_id = p.run_id AND b.unit_no = p.unit_no WHERE a.segment <> b.segment""", "h_units")  # fmt: skip
def d16b(spark, d):
    units = saved_units(spark, d)
    edges = units.filter("depends_on is not null").select(F.col("run_id").alias("pipeline_id"), F.col("depends_on").alias("src"), F.col("unit_no").alias("dst"))
    return segments.segment_edges(unit_segments(units), edges)


@R.add("d17_capacity", """
    SELECT p.p_partkey, p.p_size, p.p_retailprice FROM part p
    WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE COALESCE(p.p_size, 0) <= s.s_nationkey * 2 AND COALESCE(p.p_retailprice, 0) <= s.s_acctbal)""")  # fmt: skip
def d17(spark, d):
    requests = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    groups = table(spark, d, "supplier").select((F.col("s_nationkey") * 2).alias("cpu"), F.col("s_acctbal").alias("memory"))
    return matching.unsatisfied(requests, groups, {"p_size": "cpu", "p_retailprice": "memory"})


@R.add("d17_capacity_three", """
    SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_partkey FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE l.l_quantity <= s.s_nationkey * 2 AND l.l_extendedprice <= s.s_acctbal * 10 AND l.l_partkey % 100 <= s.s_suppkey % 90)""")  # fmt: skip
def d17_three(spark, d):
    """Capacity in three amounts, of line items as requests."""
    requests = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", (F.col("l_partkey") % 100).alias("slots"))
    groups = table(spark, d, "supplier").select((F.col("s_nationkey") * 2).cast("double").alias("cpu"), (F.col("s_acctbal") * 10).alias("memory"), (F.col("s_suppkey") % 90).alias("free"))
    return matching.unsatisfied(requests, groups, {"l_quantity": "cpu", "l_extendedprice": "memory", "slots": "free"}).drop("slots")


@R.add("d18_stream_restarted", """
    SELECT user_id, event_type, event_id, n AS n_events FROM (
      SELECT user_id, event_type, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) q WHERE r = 1""")  # fmt: skip
def d18_stream(spark, d):
    """The same as a stream over a folder of files: it takes in what is there and ends, files are added, and it is started again from its checkpoint."""
    scratch, events = Scratch(spark, "stream"), table(spark, d, "events").select("user_id", "event_type", "event_id")
    log, target, checkpoint = (scratch.path(x) for x in ("log", "states", "checkpoint"))
    for late in (0, 1):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == late).write.mode("append").parquet(log)
        states = run_to_now(spark, log, target, checkpoint, events.schema, "user_id", "event_type", "event_id")
    return states


@R.add("d18_latest_states", """
    SELECT user_id, event_type, event_id, n AS n_events FROM (
      SELECT user_id, event_type, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) q WHERE r = 1""")  # fmt: skip
def d18(spark, d):
    return latest_states(table(spark, d, "events"), "user_id", "event_type", "event_id")


@R.add("d19_revision_in_force", """
    WITH v AS (SELECT pipeline_id, version, created_at, LEAD(created_at) OVER (PARTITION BY pipeline_id ORDER BY version) AS until FROM h_versions)
    SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, MAX(v.version) AS version FROM orders o
    LEFT JOIN v ON v.pipeline_id = o.o_custkey AND v.created_at <= o.o_orderdate AND (v.until IS NULL OR o.o_orderdate < v.until)
    GROUP BY o.o_orderkey, o.o_custkey, o.o_orderdate""", "h_versions")  # fmt: skip
def d19(spark, d):
    revisions = view(spark, d, "h_versions").select(F.col("pipeline_id").alias("o_custkey"), "version", "created_at")
    return matching.in_force(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), revisions, "o_custkey", "o_orderdate", "created_at", ["version"])


@R.add("d20_fingerprint", "SELECT event_id, SHA256(REPLACE(props, ' ', '')) AS fingerprint FROM events")
def d20(spark, d):
    return table(spark, d, "events").select("event_id", canonical_fingerprint("props").alias("fingerprint"))


@R.add("d21_first_times", "SELECT run_id, MIN(CASE WHEN event_type = 'signup' THEN created_at END) AS queued_at, MIN(CASE WHEN event_type = 'view' THEN created_at END) AS started_at, MIN(CASE WHEN event_type IN ('purchase', 'error') THEN created_at END) AS finished_at FROM h_events GROUP BY run_id", "h_events")
def d21(spark, d):
    return rollup.first_times(view(spark, d, "h_events"), "run_id", "event_type", "created_at", {"queued_at": ["signup"], "started_at": ["view"], "finished_at": ["purchase", "error"]})


@R.add("d22_log_rows", """
    SELECT event_id, CONCAT('{"level":"INFO","logger":"history","event":"', event_type, '"', CASE WHEN event_id % 3 <> 0 THEN CONCAT(',"run_id":"', CAST(run_id AS STRING), '"') ELSE '' END,
      ',"value":"', CAST(CAST(FLOOR(value) AS INT) AS STRING), '"', CASE WHEN event_id % 3 = 0 THEN ',"run_id":"own"' ELSE '' END, '}') AS line FROM h_events""", "h_events")  # fmt: skip
def d22(spark, d):
    context = F.create_map(F.lit("run_id"), F.col("run_id").cast("string"), F.lit("unit_id"), F.lit(None).cast("string"))
    fields = F.create_map(F.lit("value"), F.floor("value").cast("int").cast("string"), F.lit("run_id"), F.expr("CASE WHEN event_id % 3 = 0 THEN 'own' END"))
    return view(spark, d, "h_events").select("event_id", log_row(F.lit("INFO"), F.lit("history"), F.col("event_type"), context, fields).alias("line"))


@R.add("d23_error_share", """
    SELECT event_id, COUNT(CASE WHEN event_type = 'error' THEN 1 END) OVER w AS errors, COUNT(*) OVER w AS n
    FROM h_events WINDOW w AS (ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""", "h_events")  # fmt: skip
def d23(spark, d):
    events = view(spark, d, "h_events").select("event_id", "event_type", "created_at")
    found = metrics.trailing_sums(events, "created_at", 3600, [], {"errors": F.when(F.col("event_type") == "error", 1).otherwise(0), "n": F.lit(1)})
    return found.select("event_id", "errors", "n")


@R.add("d23_latency", "SELECT event_id, event_type, ROUND(QUANTILE_CONT(value, 0.95) OVER (PARTITION BY event_type ORDER BY created_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), 6) AS p95 FROM h_events", "h_events")
def d23b(spark, d):
    events = view(spark, d, "h_events").select("event_id", "event_type", "created_at", "value")
    found = metrics.trailing_percentile(events, "created_at", 6 * 3600, ["event_type"], "value", 0.95, "p95")
    return found.select("event_id", "event_type", F.round("p95", 6).alias("p95"))


@R.add("d23_sliding_quantiles", """
    WITH e AS (SELECT event_type, value, TIME_BUCKET(INTERVAL 30 MINUTE, created_at, TIMESTAMP '1970-01-01 00:00:00') AS step FROM h_events WHERE value IS NOT NULL),
    w AS (SELECT event_type, value, step + INTERVAL 30 MINUTE * (1 + CAST(k AS INT)) AS window_end FROM e, (SELECT UNNEST(RANGE(12)) AS k) q)
    SELECT event_type, window_end, COUNT(*) AS n, TRUE AS median_near, TRUE AS p95_near FROM w GROUP BY event_type, window_end""", "h_events")  # fmt: skip
def d23_sketches(spark, d):
    """Median and 95th percentile over sliding windows of 6 hours, by sketches, and whether their exact ranks in the window's rows are within 2 % of it."""
    events = view(spark, d, "h_events").filter("value is not null").select("event_type", "created_at", "value")
    found = Scratch(spark, "quantiles").save(metrics.sliding_quantiles(events, "created_at", 1800, 12, ["event_type"], "value", [0.5, 0.95]), "found")
    step = F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / 1800)
    rows = events.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("window_end", F.timestamp_seconds((step + F.col("k")) * 1800))
    rows = rows.join(found.withColumnRenamed("n", "n_sketch"), ["event_type", "window_end"])

    def near(k: int, share: float):
        """The ranks that the value takes up, from below its least copy to its last, meet the share within 2 %."""
        q = F.col("quantiles")[k]
        return (F.count_if(F.col("value") <= q) >= F.count("*") * F.lit(share - 0.02)) & (F.count_if(F.col("value") < q) <= F.count("*") * F.lit(share + 0.02))

    out = rows.groupBy("event_type", "window_end").agg(F.count("*").alias("n"), F.first("n_sketch").alias("n_sketch"), near(0, 0.5).alias("median_near"), near(1, 0.95).alias("p95_near"))
    return out.filter("n = n_sketch").drop("n_sketch")


@R.add("d23_rates", "SELECT TIME_BUCKET(INTERVAL 10 MINUTE, created_at, TIMESTAMP '1970-01-01 00:00:00') AS window_start, event_type, COUNT(*) AS n, COUNT(*) / 600.0::DOUBLE AS rate FROM h_events GROUP BY ALL", "h_events")
def d23c(spark, d):
    return metrics.by_window(view(spark, d, "h_events"), "created_at", "10 minutes", ["event_type"], {"n": F.count("*"), "rate": F.count("*") / F.lit(600.0)})
