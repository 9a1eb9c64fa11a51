"""Canonical JSON, fingerprints, log rows and artifact addresses."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical_fingerprint(text: pd.Series) -> pd.Series:
    """sha256 of JSON with sorted keys and compact separators; null for null. A pandas UDF, since Spark's JSON writer prints 1.0 as 1."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        return hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return text.map(one)


def log_row(level: Column, logger: Column, event: Column, context: Column, fields: Column) -> Column:
    """Compact JSON of a log event: level, logger, event, then the context's keys, overridden by the event's own; nulls are left out. `context` and `fields` are maps of text."""
    fields = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    context = F.coalesce(context, F.create_map().cast("map<string,string>"))
    own = F.map_filter(fields, lambda k, v: v.isNotNull())
    rest = F.map_filter(context, lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    head = F.create_map(F.lit("level"), level, F.lit("logger"), logger, F.lit("event"), event)
    merged = F.map_concat(rest, own)
    return F.to_json(F.map_concat(F.map_filter(head, lambda k, v: ~F.map_contains_key(merged, k)), merged))


def path_segment(name: Column) -> Column:
    """A name as part of a path: letters, digits, '-', '_' and '.' stay, all else becomes '-'."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "-")


def committed_uri(base: str, run: Column, node: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/runs/"), run.cast("string"), F.lit("/artifacts/"), path_segment(node), F.lit("/committed"))


def staging_uri(base: str, run: Column, node: Column, attempt: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/runs/"), run.cast("string"), F.lit("/artifacts/"), path_segment(node), F.lit("/attempts/"), F.format_string("%03d", attempt), F.lit("/data"))


def content_fingerprint(name: Column, size: Column, etag: Column) -> Column:
    """Aggregate: sha256 over name, size and etag of a dataset's files, in order of names; a null etag is skipped."""
    files = F.array_sort(F.collect_list(F.struct(name.alias("name"), size.cast("string").alias("size"), F.coalesce(etag, F.lit("")).alias("etag"))))
    return F.sha2(F.array_join(F.transform(files, lambda x: F.concat(x["name"], x["size"], x["etag"])), ""), 256)
