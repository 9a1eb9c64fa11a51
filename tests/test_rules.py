"""Selections, roll-ups, audits, matching, metrics and streams on small tables."""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import json
import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import metrics
from quern.functions.canonical import canonical_fingerprint, content_fingerprint, log_row, path_segment
from quern.functions.retry import Retries, job_state
from quern.functions.states import MOVES, moves
from quern.history import audit, listings, retention
from quern.operators import matching, reach, rollup, selection
from quern.plans import catalogue, segments
from quern.queries import history_q, rules_q
from quern.sources.shared import Scratch
from quern.streaming.latest import newest_snapshot, run_to_now, stream_latest_states, upsert_latest


def greedy(rows: list[dict], n: int, free: dict[str, int], last: dict[int, int]) -> list[tuple]:
    """One row at a time: the least recently served group, its first row with room."""
    rows, left, served, out = list(rows), dict(free), dict(last), []
    clock = max(last.values(), default=0)
    while len(out) < n:
        able = [r for r in rows if left.get(r["cat"], 1) > 0]
        if not able:
            break
        r = min(able, key=lambda r: (served.get(r["g"], 0), r["born"], r["g"], r["at"]))
        rows.remove(r)
        if r["cat"] in left:
            left[r["cat"]] -= 1
        clock += 1
        served[r["g"]] = clock
        out.append((r["g"], r["at"]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fair_take(spark, seed):
    rng = random.Random(seed)
    rows = [{"g": g, "born": g % 3, "at": k, "cat": rng.choice("xyz")} for g in range(1, 8) for k in range(rng.randint(1, 7))]
    last = {g: rng.choice([0, 0, 3, 5]) for g in range(1, 6)}
    df = spark.createDataFrame(rows)
    known = spark.createDataFrame(list(last.items()), "g long, last_sequence long")
    n = rng.randint(1, 20)
    got = [(r.g, r["at"]) for r in selection.fair_take(df, "g", ["at"], ["born"], n, known).collect()]
    assert got == greedy(rows, n, {}, last)
    free = {"x": rng.randint(0, 4), "y": rng.randint(0, 4)}
    capped = selection.fair_take_capped(df, "g", "cat", ["at"], ["born"], n, free, known).orderBy("sequence").collect()
    assert [(r.g, r["at"]) for r in capped] == greedy(rows, n, free, last)


def test_ties_of_groups(spark):
    """Groups that are otherwise equal come by value, with and without bounds."""
    df = spark.createDataFrame([(g, 0, 0, "x") for g in (10, 2, 33)], "g long, born int, at int, cat string")
    assert [r.g for r in selection.fair_take(df, "g", ["at"], ["born"], 2).collect()] == [2, 10]
    assert [r.g for r in selection.fair_take_capped(df, "g", "cat", ["at"], ["born"], 2, {}).orderBy("sequence").collect()] == [2, 10]


def test_rotating_slice_wraps(spark):
    df = spark.range(10)
    rows, cursor = selection.rotating_slice(df, ["id"], 8, 4)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 8, 9] and cursor == 2
    rows, cursor = selection.rotating_slice(df, ["id"], 8, 10)
    assert rows.count() == 10 and cursor == 0
    assert selection.rotating_slice(df.limit(0), ["id"], 3, 4)[0].count() == 0


def test_positions_are_gapless(spark):
    rows, total = selection.positions(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), ["x"])
    assert total == 1000 and all(r.x == r.position for r in rows.collect())


UNITS = [(1, 1, None, "FAILED"), (1, 2, 1, "PENDING"), (1, 3, 2, "PENDING"), (1, 4, None, "PENDING"), (2, 1, None, "SUCCEEDED"), (2, 2, 1, "PENDING"), (3, 1, None, "SUCCEEDED"), (4, 1, None, "CANCELLED"), (5, 2, 9, "PENDING")]


def test_roll_ups(spark):
    units = spark.createDataFrame(UNITS, "run_id int, unit_no int, depends_on int, status string")
    assert sorted((r.run_id, r.unit_no) for r in rollup.ready_units(units, "depends_on").collect()) == [(1, 4), (2, 2)]
    assert [(r.run_id, r.unit_no, r.dep) for r in rollup.missing_dependencies(units, "depends_on").collect()] == [(5, 2, 9)]
    after = {(r.run_id, r.unit_no): r.status for r in rollup.cancelled_by_upstream(units, "depends_on").collect()}
    assert after[(1, 2)] == after[(1, 3)] == "CANCELLED" and after[(1, 4)] == after[(2, 2)] == "PENDING"
    states = {r.run_id: (r.status, r.reason) for r in rollup.run_states(units).collect()}
    assert states == {1: (None, None), 2: (None, None), 3: ("SUCCEEDED", None), 4: ("FAILED", "EXECUTION_UNIT_CANCELLED"), 5: (None, None)}
    assert rollup.cancelled_by_upstream(units.limit(0), "depends_on").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cancel_on_random_graphs(spark, seed):
    """Chains, units with several dependencies, missing ones and cycles, against a walk."""
    rng = random.Random(seed)
    units = {(r, u): (rng.choice(["PENDING"] * 8 + ["FAILED", "CANCELLED", "SUCCEEDED", "READY"]), sorted(rng.sample(range(60), rng.choice([0, 1, 1, 1, 2, 3])))) for r in range(3) for u in range(50)}
    state = {k: s for k, (s, _) in units.items()}
    bad = {k for k, s in state.items() if s in ("FAILED", "CANCELLED")}
    while new := {(r, u) for (r, u), (s, deps) in units.items() if s == "PENDING" and (r, u) not in bad and any((r, d) in bad for d in deps)}:
        bad |= new
    df = spark.createDataFrame([(r, u, deps, s) for (r, u), (s, deps) in units.items()], "run_id int, unit_no int, needs array<int>, status string")
    got = {(r.run_id, r.unit_no): r.status for r in rollup.cancelled_by_upstream(df, "needs").collect()}
    assert got == {k: "CANCELLED" if k in bad and s == "PENDING" else s for k, s in state.items()}


def test_moves(spark):
    assert moves(spark).count() == sum(len(nexts) for table in MOVES.values() for nexts in table.values())
    log = spark.createDataFrame([(1, 1, "PENDING"), (1, 2, "READY"), (1, 3, "RUNNING"), (2, 1, "RUNNING"), (2, 2, "SUCCEEDED"), (2, 3, "RUNNING")], "u int, n int, status string")
    found = audit.forbidden_transitions(log, ["u"], "status", ["n"], "unit").collect()
    assert sorted((r.u, r.before, r.status) for r in found) == [(1, "READY", "RUNNING"), (2, "SUCCEEDED", "RUNNING")]


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", "STAGING"), (2, "a", "COMMITTED"), (3, "a", "STAGING"), (4, None, "STAGING")], "id int, uri string, state string")
    new = spark.createDataFrame([(1, "a", "COMMITTED"), (2, "a", "STAGING"), (4, None, "STAGING"), (5, "z", "STAGING")], "id int, uri string, state string")
    assert {r.id: r.violation for r in audit.snapshot_changes(old, new, ["id"], ["uri"], "state").collect()} == {2: "state may not change so", 3: "deleted"}


def test_retry(spark):
    r = Retries()
    rows = spark.createDataFrame([(1, None, "OTHER", "UNKNOWN"), (1, None, "USER_CODE_ERROR", "UNKNOWN"), (1, False, "API_UNAVAILABLE", "FAILED"), (3, True, "API_UNAVAILABLE", "FAILED"), (2, None, None, "FAILED")], "n int, flag boolean, code string, state string")
    got = rows.select(r.retries_job(F.col("n"), F.col("flag"), F.col("code"), F.col("state")).alias("j"), r.retries_error(F.col("n"), F.col("flag"), F.col("code")).alias("e"), r.backoff(F.col("n")).alias("b")).collect()
    assert [x.j for x in got] == [True, False, False, False, False]
    assert [x.e for x in got] == [None, False, True, False, None] and [x.b for x in got] == [30, 30, 30, 120, 60]
    assert spark.range(1).select(r.backoff(F.lit(9)).alias("b")).first().b == 600
    assert spark.range(1).select(job_state(F.lit(None).cast("string")).alias("s")).first().s == "UNKNOWN"
    with pytest.raises(ValueError):
        Retries(multiplier=0.5)


def test_capacity(spark):
    requests = spark.createDataFrame([(1, 4, 10, None), (2, 8, 10, None), (3, None, None, "gpu"), (4, 1, 1, "tpu"), (5, 4, 90, None)], "id int, cpu int, mem int, acc string")
    groups = spark.createDataFrame([(4, 100, "gpu"), (8, 5, "gpu"), (2, 50, "none"), (4, 100, "gpu")], "gcpu int, gmem int, kind string")
    got = matching.unsatisfied(requests, groups, {"cpu": "gcpu", "mem": "gmem"}, ("acc", "kind")).collect()
    assert sorted(r.id for r in got) == [2, 4]
    assert matching.unsatisfied(requests, groups, {"cpu": "gcpu", "mem": "gmem"}, ("acc", "kind"), satisfied=True).count() == 3


@pytest.mark.parametrize("kind", [None, ("acc", "kind")])
@pytest.mark.parametrize("amounts", [1, 2, 3, 4])
def test_capacity_by_brute_force(spark, kind, amounts):
    rng = random.Random(amounts)
    some = lambda top: rng.choice([None, *range(top)])
    requests = [(k, some(9), some(9), some(9), some(5), rng.choice([None, "a", "b", "c"])) for k in range(120)]
    groups = [(some(9), some(8), some(9), some(6), rng.choice(["a", "b", None])) for _ in range(9)]
    keys = dict(list({"r0": "g0", "r1": "g1", "r2": "g2", "r3": "g3"}.items())[:amounts])
    fits = {r[0] for r in requests if any(all(g[j] is not None and (r[1 + j] or 0) <= g[j] for j in range(amounts)) and (kind is None or r[5] is None or r[5] == g[4]) for g in groups)}
    rdf = spark.createDataFrame(requests, "id int, r0 int, r1 int, r2 int, r3 int, acc string")
    gdf = spark.createDataFrame(groups, "g0 int, g1 int, g2 int, g3 int, kind string")
    assert sorted(r.id for r in matching.unsatisfied(rdf, gdf, keys, kind).collect()) == sorted({r[0] for r in requests} - fits)
    assert {r.id for r in matching.unsatisfied(rdf, gdf, keys, kind, satisfied=True).collect()} == fits
    assert matching.unsatisfied(rdf, gdf.limit(0), keys, kind).count() == len(requests)


def test_capacity_of_few_offered_amounts_is_looked_up(spark, monkeypatch):
    """Where all offered amounts but one have few values, requests aren't sorted or shuffled; the other way gives the same."""
    rng = random.Random(9)
    requests = spark.createDataFrame([(k, rng.choice([None, float("nan"), rng.uniform(-1, 60)]), rng.uniform(0, 1000), rng.randrange(100)) for k in range(500)], "id int, a double, b double, c int")
    groups = spark.createDataFrame([(rng.randrange(25) * 2, rng.uniform(0, 1000), rng.randrange(90)) for _ in range(12)], "ga int, gb double, gc int")
    keys = {"a": "ga", "b": "gb", "c": "gc"}
    got = matching.unsatisfied(requests, groups, keys)
    assert "Exchange range" not in (plan := got._jdf.queryExecution().toString()) and "SortMergeJoin" not in plan
    looked_up = sorted(r.id for r in got.collect())
    monkeypatch.setattr(matching, "CELLS", -1)
    assert looked_up == sorted(r.id for r in matching.unsatisfied(requests, groups, keys).collect()) and 0 < len(looked_up) < 500


def test_capacity_has_no_nested_loop(spark):
    """Three amounts, half of all requests alike: no plan compares requests with groups pair by pair, and clashing columns stay."""
    requests = spark.range(2000).selectExpr("id", "if(id % 2 = 0, 5, id % 50) AS a", "id % 7 AS b", "id % 11 AS c", "'x' AS kind", "1 AS a0")
    groups = spark.range(40).selectExpr("id AS ga", "7 - id % 8 AS gb", "id % 12 AS gc")
    got = matching.unsatisfied(requests, groups, {"a": "ga", "b": "gb", "c": "gc"})
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and got.columns == requests.columns
    have = [(g, 7 - g % 8, g % 12) for g in range(40)]
    want = [i for i in range(2000) if not any((5 if i % 2 == 0 else i % 50) <= x and i % 7 <= y and i % 11 <= z for x, y, z in have)]
    assert sorted(r.id for r in got.collect()) == want


def test_in_force_by_brute_force(spark):
    """Hot keys, blocks without revisions, ties and nulls."""
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.03 else dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(400), hours=rng.choice([0, 0, 7]))
    rows = [(k, rng.choice("aaaab"), day()) for k in range(300)]
    revs = [(rng.choice("aab"), day() or dt.datetime(2020, 5, 5), k) for k in range(25)]
    got = matching.in_force(spark.createDataFrame(rows, "id int, k string, at timestamp"), spark.createDataFrame(revs, "k string, since timestamp, rev int"), "k", "at", "since", ["rev"])
    newest = lambda k, at: max(((s, v) for x, s, v in revs if x == k and at is not None and s <= at), default=(None, None))[1]
    assert {r.id: r.rev for r in got.collect()} == {i: newest(k, at) for i, k, at in rows}


def test_segments_on_cycles(spark):
    """Pointers that lead round and round end, and show as null."""
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 3), (1, 4, 2), (1, 5, None), (1, 6, 5), (1, 7, 99), (2, 1, None)], "pipeline_id int, node int, parent int")
    got = {(r.pipeline_id, r.node): r.segment for r in segments.segments(links).collect()}
    assert got == {(1, 1): None, (1, 2): None, (1, 3): None, (1, 4): None, (1, 5): 5, (1, 6): 5, (1, 7): 99, (2, 1): 1}


def test_in_force(spark):
    t = dt.datetime
    rows = spark.createDataFrame([(1, "a", t(2020, 1, 1)), (2, "a", t(2020, 3, 1)), (3, "b", t(2020, 1, 1)), (4, "a", t(2020, 2, 1))], "id int, k string, at timestamp")
    revs = spark.createDataFrame([("a", t(2020, 2, 1), 1), ("a", t(2020, 2, 15), 2)], "k string, since timestamp, rev int")
    assert {r.id: r.rev for r in matching.in_force(rows, revs, "k", "at", "since", ["rev"]).collect()} == {1: None, 2: 2, 3: None, 4: 1}


def test_catalogue(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 3, 4), (2, 1, 2), (3, 5, 5)], "pipeline_id int, src int, dst int")
    assert sorted((r.pipeline_id, r.node) for r in catalogue.cyclic_nodes(edges).collect()) == [(1, 2), (1, 3), (3, 5)]
    chain = spark.createDataFrame([(1, i, None if i in (0, 60) else i - 1) for i in range(100)], "pipeline_id int, node int, parent int")
    assert {r.node: r.segment for r in segments.segments(chain).collect()} == {i: 0 if i < 60 else 60 for i in range(100)}
    nodes = spark.createDataFrame([(1, k, "s") for k in "abcd"], "pipeline_id int, node_id string, profile string")
    links = spark.createDataFrame([(1, "a", "b", "data", "none"), (1, "b", "c", "data", "checkpoint"), (1, "b", "d", "data", "none")], "pipeline_id int, src string, dst string, kind string, boundary string")
    assert {r.node: r.parent for r in segments.edge_parents(nodes, links, ["profile"]).collect()} == {"a": None, "b": "a", "c": None, "d": None}


def test_fingerprints(spark):
    text = ['{"b": 1.0, "a": [1, {"z": null, "y": "é"}]}', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(canonical_fingerprint("t")).collect()]
    assert got == [hashlib.sha256(json.dumps(json.loads(text[0]), sort_keys=True, separators=(",", ":")).encode()).hexdigest(), None]
    files = spark.createDataFrame([("b", 2, None), ("a", 10, "e1")], "name string, size long, etag string")
    assert files.agg(content_fingerprint(F.col("name"), F.col("size"), F.col("etag"))).first()[0] == hashlib.sha256(b"a10e1b2").hexdigest()
    assert spark.range(1).select(path_segment(F.lit("a/b é_c.d-e:f"))).first()[0] == "a-b-é_c.d-e-f"


def test_log_rows(spark):
    own = F.create_map(F.lit("k"), F.lit("own"), F.lit("n"), F.lit(None).cast("string"))
    context = F.create_map(F.lit("k"), F.lit("old"), F.lit("run"), F.lit("1"))
    line = spark.range(1).select(log_row(F.lit("INFO"), F.lit("x"), F.lit("e"), context, own)).first()[0]
    assert json.loads(line) == {"level": "INFO", "logger": "x", "event": "e", "run": "1", "k": "own"}


def test_durations(spark):
    rows = spark.createDataFrame([("a", -1.0), ("a", 0.3), ("a", 99.0), ("b", None)], "l string, s double")
    got = {r.le: r["count"] for r in metrics.durations(rows, F.col("s"), "l", bounds=(0.1, 1.0)).collect()}
    assert got == {0.1: 1, 1.0: 2, float("inf"): 3}


def test_trailing_crosses_blocks(spark):
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)) for k in range(0, 100, 7)], "k int, at timestamp")
    got = {r.k: r.n for r in metrics.trailing(rows, "at", 20, [], {"n": F.count("*")}).collect()}
    assert got == {k: sum(0 <= k - j <= 20 for j in range(0, 100, 7)) for k in range(0, 100, 7)}


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_trailing_percentile_and_sums_by_brute_force(spark, share):
    """Equal times, nulls, NaN, rows on the edge of a window, empty blocks and a frequent label; null times are a window of their own."""
    rng = random.Random(5)
    at = [0, 20, 40, 40, 41, 61, 200, *(rng.randrange(300) for _ in range(300)), None, None]
    rows = [(k, "a" if rng.random() < 0.8 else None, t, rng.choice([None, float("nan"), 1.5, rng.random(), rng.random()])) for k, t in enumerate(at)]
    df = spark.createDataFrame(rows, "k int, label string, t long, v double").withColumn("at", F.timestamp_seconds("t"))
    got = {r.k: r.p for r in metrics.trailing_percentile(df, "at", 20, ["label"], "v", share, "p").collect()}
    sums = {r.k: (r.n, r.odd) for r in metrics.trailing_sums(df, "at", 20, ["label"], {"n": F.lit(1), "odd": F.col("k") % 2}).collect()}
    assert len(got) == len(sums) == len(rows)
    for k, label, t, _ in rows:
        window = [r for r in rows if r[1] == label and (r[2] is None if t is None else r[2] is not None and t - 20 <= r[2] <= t)]
        values = sorted((r[3] for r in window if r[3] is not None), key=lambda x: (x != x, x))
        assert sums[k] == (len(window), sum(r[0] % 2 for r in window))
        if not values:
            assert got[k] is None
            continue
        position = share * (len(values) - 1)
        low, high = values[math.floor(position)], values[math.ceil(position)]
        want = low if low == high or position == int(position) else (math.ceil(position) - position) * low + (position - math.floor(position)) * high
        assert got[k] == pytest.approx(want, nan_ok=True)


def test_trailing_measures_in_time_of_sorting(spark):
    """60,000 rows in one window: rows times rows of a window would be 3.6e9 steps."""
    rows = spark.range(60_000).select("id", F.timestamp_micros(F.col("id")).alias("at"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    start = time.monotonic()
    sums = metrics.trailing_sums(rows, "at", 60, [], {"n": F.lit(1)}).agg(F.sum("n")).first()[0]
    top = metrics.trailing_percentile(rows, "at", 60, [], "v", 1.0, "p").agg(F.max("p"), F.count("*")).first()
    assert (sums, *top) == (60_000 * 60_001 // 2, 59_999.0, 60_000) and time.monotonic() - start < 60


def test_sliding_quantiles(spark):
    """Exact for small windows; for large ones the rank error stays in its bound. Sketches are shuffled, not rows."""
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=rng.randrange(7200)), rng.gauss(0, 1)) for _ in range(300)] + [("b", start, None), ("b", start, float("nan")), ("b", None, 1.0)]
    got = metrics.sliding_quantiles(spark.createDataFrame(rows, "l string, at timestamp, v double"), "at", 600, 3, ["l"], "v", [0.0, 0.5, 1.0]).collect()
    for r in got:
        inside = sorted(v for label, at, v in rows if label == "a" and dt.timedelta(0) < r.window_end - at <= dt.timedelta(seconds=1800))
        assert r.l == "a" and r.n == len(inside) and list(r.quantiles) == [inside[0], inside[-(-len(inside) // 2) - 1], inside[-1]]
    assert len(got) == 14
    large = spark.range(200_000).selectExpr("timestamp_seconds(id div 100) AS at", "cast(xxhash64(id) % 1000003 AS double) AS v")
    values = sorted(r.v for r in large.collect())
    found = metrics.sliding_quantiles(large, "at", 500, 4, [], "v", [0.05, 0.5, 0.99])
    (whole,) = found.filter("n = 200000").collect()
    for share, q in zip((0.05, 0.5, 0.99), whole.quantiles, strict=True):
        assert abs(bisect.bisect_right(values, q) / len(values) - share) < 0.01
    assert "hashpartitioning(step" in found._jdf.queryExecution().toString()


def test_stream_goes_on_after_its_end(spark, tmp_path):
    """Each run takes in what is new and ends; a run with nothing new changes nothing; half a snapshot isn't read."""
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    schema = spark.createDataFrame([], "id int, n int, s string").schema
    seen = {}
    for batch in ([(1, 1, "A"), (2, 1, "A")], [(1, 3, "B"), (3, 1, "C")], [], [(1, 2, "X")]):
        if batch:
            spark.createDataFrame(batch, schema).write.mode("append").parquet(log)
        for i, n, s in batch:
            seen[i] = max(seen.get(i, (0, "")), (n, s))
        got = run_to_now(spark, log, out, check, schema, "id", "s", "n")
        assert {r.id: (r.n, r.s) for r in got.collect()} == seen
    (tmp_path / "out" / "v=99").mkdir()
    assert newest_snapshot(spark, out).count() == 3


def test_listings(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "p string, v int, t string")
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    assert {r.p: r.next_version for r in listings.next_version(v, parents, "p", "v").collect()} == {"a": 3, "b": 2, "c": 1}
    assert sorted(tuple(r) for r in listings.newest(v, ["p"], "v").collect()) == [("a", 2, "y"), ("b", 1, "z")]
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}):
        with pytest.raises(ValueError):
            listings.page(v, ["p"], **bad)
    jobs = spark.createDataFrame([(1, 1, "j1"), (1, 2, ""), (1, 3, None), (2, 1, None)], "u int, attempt_number int, external_job_id string")
    assert [tuple(r) for r in listings.latest_job(jobs, ["u"]).collect()] == [(1, "j1")]


def test_keyset_wraps(spark):
    rows = spark.range(10).select(F.floor(F.col("id") / 3).alias("t"), "id")
    assert [r.id for r in retention.after(rows, ["t", "id"], (1, 4), 3).collect()] == [5, 6, 7]
    assert [r.id for r in retention.after(rows, ["t", "id"], (3, 9), 2).collect()] == [0, 1]
    assert [r.id for r in retention.after(rows, ["t", "id"], None, 2).collect()] == [0, 1]


def test_stream(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "id int, n int, s string").schema
    spark.createDataFrame([(1, 1, "A"), (2, 1, "A"), (1, 2, "B")], schema).write.parquet(log)
    stream = stream_latest_states(spark, log, schema, "id", "s", "n")
    query = stream.writeStream.outputMode("update").foreachBatch(upsert_latest(out, "id", "s", "n")).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    spark.createDataFrame([(2, 5, "C"), (2, 4, "X"), (3, 1, "A")], schema).write.mode("append").parquet(log)
    query.processAllAvailable()
    last = query.lastProgress["batchId"]
    query.stop()
    newest = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    assert newest <= last
    assert {r.id: r.s for r in spark.read.parquet(f"{out}/v={newest}").collect()} == {1: "B", 2: "C", 3: "A"}


def _brute_cycles(edges):
    """Nodes on or between cycles, by walks."""
    out = set()
    for p in {e[0] for e in edges}:
        succ = {}
        for q, a, b in edges:
            if q == p:
                succ.setdefault(a, set()).add(b)
        pred = {}
        for a, bs in succ.items():
            for b in bs:
                pred.setdefault(b, set()).add(a)

        def endless(step):
            live = {n for n in {*succ, *pred}}
            while gone := {n for n in live if not step.get(n, set()) & live}:
                live -= gone
            return live

        out |= {(p, n) for n in endless(succ) & endless(pred)}
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("growth", [0, 16])
def test_cycles_on_random_graphs(spark, seed, growth, monkeypatch):
    """Sparse and dense graphs, by squaring and, with no room for it, by levels."""
    monkeypatch.setattr(reach, "GROWTH", growth)
    rng = random.Random(seed)
    edges = list({(p, rng.randrange(30), rng.randrange(30)) for p in range(3) for _ in range([12, 25, 40, 70][seed])})
    got = catalogue.cyclic_nodes(spark.createDataFrame(edges, "pipeline_id int, src int, dst int"))
    assert {(r.pipeline_id, r.node) for r in got.collect()} == _brute_cycles(edges)


def _jobs(spark, run):
    """Jobs that a call starts, and its result."""
    spark.sparkContext.setJobGroup(name := f"g{random.random()}", "")
    result = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), result


def test_long_chain_beside_a_cycle(spark):
    """A chain of 10,000 nodes, one of width two as long, and a cycle: rounds by logarithm, not by length."""
    n = 10_000
    cycle = [(1, n + k, n + (k + 1) % 7) for k in range(7)]
    chain = [(1, k, k + 1) for k in range(n - 1)]
    few, found = _jobs(spark, lambda: catalogue.cyclic_nodes(spark.createDataFrame(chain + cycle, "pipeline_id int, src int, dst int")).collect())
    assert {r.node for r in found} == {n + k for k in range(7)}
    ladder = [(1, 2 * k + a, 2 * k + 2 + b) for k in range(n // 2 - 1) for a in (0, 1) for b in (0, 1)]
    more, found = _jobs(spark, lambda: catalogue.cyclic_nodes(spark.createDataFrame(ladder + cycle, "pipeline_id int, src int, dst int")).collect())
    assert {r.node for r in found} == {n + k for k in range(7)}
    assert few < 450 and more < 450  # jobs of Spark, several of which a join may start; level by level there would be thousands


@pytest.mark.parametrize("width,depth", [(3, 1000), (1, 1000), (40, 12)])
def test_cancel_in_layers(spark, width, depth):
    """Each unit needs all or some of the layer above; one unit of the first layer fails."""
    rng = random.Random(width)
    units, hit = [], {0}
    for k in range(width * depth):
        deps = [] if k < width else rng.sample(range((k // width - 1) * width, k // width * width), rng.choice([1, min(2, width), width]))
        units.append((1, k, deps, "FAILED" if k == 0 else "PENDING"))
        if any(d in hit for d in deps):
            hit.add(k)
    df = spark.createDataFrame(units, "run_id int, unit_no int, needs array<int>, status string")
    got = rollup.cancelled_by_upstream(df, "needs").filter("status = 'CANCELLED'").collect()
    assert {r.unit_no for r in got} == hit - {0}


def test_pages_skip_row_groups(spark, tmp_path):
    """The key reaches the scan, and a page late in the table reads few of its rows."""
    path = str(tmp_path / "t")
    rows = spark.range(40_000).select(F.floor(F.col("id") / 10).alias("t"), "id", F.repeat(F.lit("x"), 20).alias("s"))
    retention.write_clustered(rows, path, ["t", "id"], **{"parquet.block.size": "16384", "parquet.page.size": "4096"})
    page = retention.after(spark.read.parquet(path), ["t", "id"], (3990, 39_905), 20)
    assert [r.id for r in page.collect()] == list(range(39_906, 39_926))
    plan = page._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t,3990), Or(GreaterThan(t,3990),And(EqualTo(t,3990)," in plan.toString()
    leaves = plan.collectLeaves()
    if leaves.head().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        leaves = leaves.head().executedPlan().collectLeaves()
    read = leaves.head().metrics().get("numOutputRows").get().value()
    assert 0 < read < 20_000
    assert [r.id for r in retention.after(spark.read.parquet(path), ["t", "id"], (3999, 39_999), 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("name", ["d5_cancel_propagation", "d16_segment_edges"])
def test_views_that_several_steps_read_are_computed_once(spark, sf, name):
    """What is returned reads the saved view, so no step aggregates all line items once more."""
    assert not [f for f in rules_q.R.queries[name](spark, sf).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["d16_segments", "d16_segment_edges"])
def test_segments_broadcast_no_table_of_nodes(spark, sf, name, monkeypatch):
    """A table of nodes is a few bytes a row on disk, so it may lie under Spark's limit with more rows than the driver can hold."""
    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.append(df) or save(self, df, name))
    plans.append(rules_q.R.queries[name](spark, sf))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)


def test_deletion_report_computes_owners_once(spark, sf):
    plan = history_q.R.queries["c26_deletion_report"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [l_orderkey" in line for line in plan.splitlines()) <= 4  # 12 while each part of the report read the views


def test_cycles_of_small_and_large_pipelines(spark, monkeypatch):
    """Small pipelines are looked at by tasks, in few jobs; the same nodes as by plain peeling, and pipelines that are too large for that go by rounds."""
    rng = random.Random(6)
    edges = [(p, rng.randrange(n), rng.randrange(n), k) for p in range(300) for n in (rng.randint(1, 9),) for k in range(rng.randint(1, 8))]
    edges += [(300, k, k + 1, 0) for k in range(30)] + [(301, k, (k + 1) % 30, 0) for k in range(30)] + [(None, 1, 1, 0), (302, None, 1, 0), (302, 1, None, 0)]
    want = set()
    for p in range(302):
        left = {(a, b) for q, a, b, _ in edges if q == p}
        while left != (stay := {(a, b) for a, b in left if a in {y for _, y in left} and b in {x for x, _ in left}}):
            left = stay
        want |= {(p, a) for a, _ in left}
    df = spark.createDataFrame(edges, "pipeline_id long, src int, dst int, k int")
    rounds = []
    endless = catalogue.endless_nodes
    monkeypatch.setattr(catalogue, "endless_nodes", lambda *a: rounds.append(1) or endless(*a))
    got = [tuple(r) for r in catalogue.cyclic_nodes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and not rounds
    # the functions that tasks run: blocks that end inside a pipeline, and pipelines over the limit
    for small, block in ((1024, 7), (20, 50), (3, 4)):
        monkeypatch.setattr(catalogue, "SMALL", small)
        monkeypatch.setattr(catalogue, "BLOCK", block)
        rows = sorted((e[:3] for e in edges if None not in e), key=lambda e: e[0])
        table = pa.table([[r[k] for r in rows] for k in range(3)], names=["pipeline_id", "src", "dst"])
        out = [x for b in catalogue._solve(iter(table.to_batches(max_chunksize=5))) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        large = {p for p in range(302) if sum(r[0] == p for r in rows) > small}
        assert {p for p, n in out if n is None} == large and len([p for p, n in out if n is None]) == len(large)
        assert {x for x in out if x[1] is not None} == {x for x in want if x[0] not in large}
    monkeypatch.undo()
    chain = spark.range(2000).selectExpr("1L as pipeline_id", "id as src", "id + 1 as dst").union(spark.createDataFrame([(1, 2000, 1500)], "a long, b long, c long"))
    assert {r.node for r in catalogue.cyclic_nodes(chain).collect()} == set(range(1500, 2001))


def test_line_items_are_dealt_out_once(spark):
    """c15, c20: line items are shuffled by run only, not again by unit. c31: numbering reads what was joined, not the views again."""
    d = "/root/testdata/sf0.001"
    for name in ("c20_upsert_targets", "c15_diagnostics"):
        plan = history_q.R.queries[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert shuffles and not any(c in line for line in shuffles for c in ("unit_key", "node_id", "l_linenumber")), name
    assert not any("lineitem" in f for f in history_q.R.queries["c31_reconcile_admissions"](spark, d).inputFiles())
