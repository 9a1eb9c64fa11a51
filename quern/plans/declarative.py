"""Pipelines: plain functions over DataFrames, or a JSON document of nodes and edges applied node by node.

    {"name": .., "nodes": [{"id": .., "kind": .., "config": {..}}],
     "edges": [{"from": .., "to": .., "kind": "data" | "control", "boundary": "none" | "soft" | "hard" | "checkpoint"}]}

Kinds are read_parquet, map_batches, filter and write_parquet. A node with several data consumers, and a node
before a hard or checkpoint edge, is published and read back; a soft boundary changes nothing. Control edges
only order the writes.
"""

from __future__ import annotations

import heapq
import importlib
from collections import Counter
from collections.abc import Callable, Iterable
from functools import wraps
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.operators.batches import filter_rows, map_batches
from quern.sources.parquet import read_parquet, write_parquet
from quern.sources.publication import publish

KINDS = ("read_parquet", "map_batches", "filter", "write_parquet")
RESERVED = "__quern_"


class PlanError(ValueError):
    pass


def callable_ref(fn: Callable) -> str:
    """module.name of a function or class that a worker can import by it."""
    name = getattr(fn, "__qualname__", "")
    if not name or "." in name or "<" in name or fn.__module__ == "__main__":
        raise PlanError(f"{name or fn!r} can't be named: it must be defined at the top of a module")
    return f"{fn.__module__}.{name}"


def resolve(path: str) -> Callable:
    module, _, name = path.rpartition(".")
    if not module:
        raise PlanError(f"{path!r} is no module.name")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise PlanError(f"{path!r} can't be found") from e
    if not callable(found):
        raise PlanError(f"{path!r} can't be called")
    return found


def pipeline(name: str | None = None):
    """Name a function that builds a DataFrame from parameters. Building runs nothing; Spark is lazy."""

    def wrap(f: Callable[..., DataFrame]):
        @wraps(f)
        def build(*args: Any, **kwargs: Any) -> DataFrame:
            return f(*args, **kwargs)

        build.pipeline_name = name or f.__name__
        return build

    return wrap


def _repeated(items: Iterable[Any]) -> list[Any]:
    return [x for x, n in Counter(items).items() if n > 1]


def faults(spec: dict[str, Any]) -> dict[str, list[Any]]:
    """All faults of a document, as the ids or edges (from, to, kind) that have them, by name of the fault; empty lists for faults it hasn't.

    Each is a set over the table of nodes or of edges, as if they were relations; none hides another.
    """
    kinds = {n["id"]: n["kind"] for n in spec["nodes"]}
    rows = [(e["from"], e["to"], e.get("kind", "data"), e.get("boundary", "none")) for e in spec.get("edges", [])]
    inputs = Counter(to for _, to, kind, _ in rows if kind == "data")
    fed = {i: inputs[i] for i in kinds}
    found = {
        "repeated ids": _repeated(n["id"] for n in spec["nodes"]),
        f"ids that begin with {RESERVED}": [i for i in kinds if i.startswith(RESERVED)],
        f"kinds other than {', '.join(KINDS)}": [i for i, kind in kinds.items() if kind not in KINDS],
        "edges of nodes that aren't there": [r[:3] for r in rows if not {r[0], r[1]} <= kinds.keys()],
        "repeated edges": _repeated(r[:3] for r in rows),
        "checkpoints on control edges": [r[:3] for r in rows if r[2:] == ("control", "checkpoint")],
        "reads with a data input": [i for i, n in fed.items() if n and kinds[i] == "read_parquet"],
        "nodes other than reads without exactly one data input": [i for i, n in fed.items() if n != 1 and kinds[i] != "read_parquet"],
    }
    try:
        found["cycles"] = []
        TopologicalSorter(_parents(spec)).prepare()
    except CycleError as e:
        found["cycles"] = [tuple(e.args[1])]
    return found


def _parents(spec: dict[str, Any]) -> dict[str, set[str]]:
    edges = spec.get("edges", [])
    return {n["id"]: {e["from"] for e in edges if e["to"] == n["id"]} for n in spec["nodes"]}


def checked(spec: dict[str, Any]) -> list[str]:
    """Node ids in an order that keeps all edges, by id where edges leave it open; raises with all faults of the document."""
    if found := {name: where for name, where in faults(spec).items() if where}:
        raise PlanError("; ".join(f"{name}: {', '.join(map(str, where))}" for name, where in found.items()))
    waiting = TopologicalSorter(_parents(spec))
    waiting.prepare()
    order: list[str] = []
    ready: list[str] = []
    while waiting.is_active():
        for i in waiting.get_ready():
            heapq.heappush(ready, i)
        order.append(heapq.heappop(ready))
        waiting.done(order[-1])
    return order


def plan_document(operators: list[dict[str, Any]]) -> dict[str, Any]:
    """A plan, which is a chain of operators from a read to a write, as a pipeline document."""
    kinds = [o["kind"] for o in operators]
    if len(kinds) < 2 or kinds[0] != "read_parquet" or kinds[-1] != "write_parquet":
        raise PlanError("a plan starts with read_parquet and ends with write_parquet")
    return {"nodes": operators, "edges": [{"from": a["id"], "to": b["id"]} for a, b in zip(operators, operators[1:])]}


def execute(spark: SparkSession, spec: dict[str, Any], base: str, run: str) -> dict[str, DataFrame]:
    """Apply a pipeline document; returns each node's DataFrame. Writes and publications run at once, in order; all else is lazy."""
    nodes = {n["id"]: n for n in spec["nodes"]}
    order = checked(spec)
    data = [e for e in spec.get("edges", []) if e.get("kind", "data") == "data"]
    out: dict[str, DataFrame] = {}
    for i in order:
        node, config = nodes[i], dict(nodes[i].get("config", {}))
        parent = next((e["from"] for e in data if e["to"] == i), None)
        df = out[parent] if parent else None
        if node["kind"] == "read_parquet":
            df = read_parquet(spark, config.pop("path"), **config)
        elif node["kind"] == "map_batches":
            fn = config.pop("fn")
            df = map_batches(df, resolve(fn) if isinstance(fn, str) else fn, config.pop("schema", df.schema), **config)
        elif node["kind"] == "filter":
            fn = config.pop("fn", None)
            df = filter_rows(df, config["expr"] if fn is None else resolve(fn) if isinstance(fn, str) else fn, config.get("fn_kwargs"))
        else:
            df = write_parquet(df, config.pop("path"), **config)
        after = [e for e in data if e["from"] == i]
        stops = any(e.get("boundary", "none") in ("hard", "checkpoint") for e in after)
        if (stops or len(after) > 1) and node["kind"] != "write_parquet":
            df = publish(df, base, run, i)
        out[i] = df
    return out
