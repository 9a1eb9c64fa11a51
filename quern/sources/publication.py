"""Publication of datasets: stage by attempt, fingerprint, commit once, read only what is committed.

A dataset is a folder of Parquet files. An attempt writes to its own staging folder, and counts rows as it writes. A commit copies
the files to a folder of its own under the stable address, and then creates the marker there, which names that folder. Creating it is one atomic
step that fails if a marker exists: so the first of concurrent commits wins, and readers see all of a dataset or none of it. A loser deletes what it has
copied, nothing else, and goes on with the winner's dataset.

Files are listed, copied, digested and deleted by tasks, from a table of files. A file is known by its name, size and the sha256 of its bytes,
computed as the bytes stream by. A repeated copy writes the same bytes to the same place, so retried or speculative tasks do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Generator, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.canonical import content_fingerprint

MARKER = "_quern_commit.json"
#: What a staging folder records of its rows and columns.
STAGED = "_quern_staged.json"
#: Bytes of a file held at a time.
CHUNK = 1 << 22


class PublicationError(RuntimeError):
    pass


@dataclass(frozen=True)
class Committed:
    uri: str
    source: str
    size_bytes: int
    row_count: int
    content_hash: str
    schema: str
    folder: str


def segment(name: str) -> str:
    """A name as part of a path, by the rule of `canonical.path_segment`."""
    return re.sub(r"[^\w.-]", "-", name)


def staging_path(base: str, run: str, node: str, attempt: int) -> str:
    if attempt < 1:
        raise ValueError("attempts count from 1")
    return f"{base.rstrip('/')}/runs/{run}/artifacts/{segment(node)}/attempts/{attempt:03d}/data"


def committed_path(base: str, run: str, node: str) -> str:
    return f"{base.rstrip('/')}/runs/{run}/artifacts/{segment(node)}/committed"


def checked_prefix(uri: str) -> str:
    """The address of a folder with a trailing slash; refuses the root of a store or file system."""
    scheme, _, rest = uri.rpartition("://")
    path = rest.split("/", 1)[1] if scheme not in ("", "file") and "/" in rest else "" if scheme not in ("", "file") else rest
    if not re.sub(r"[/.]", "", path):
        raise PublicationError(f"{uri!r} is not a folder inside a store")
    return uri.rstrip("/") + "/"


def _fs(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _files(spark: SparkSession, uri: str) -> DataFrame:
    """(path, name, size) of a dataset's files, without those that begin with an underscore. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(checked_prefix(uri))
    name = F.regexp_replace("path", r"^.*?" + re.escape(re.sub(r"^\w+:/*", "/", checked_prefix(uri))), "")
    return files.select("path", name.alias("name"), F.col("length").alias("size")).filter(~F.element_at(F.split("name", "/"), -1).startswith("_"))


def _digesting(s3: dict[str, str | bool]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(etag=[_stream(x, None, s3) for x in batch["path"]])

    return run


def _spread(files: DataFrame) -> DataFrame:
    """The table of files with some tasks for each core, or one for each file if they are few."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "name")


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """(path, name, size, etag) of a dataset's files, without the marker. The etag is the sha256 of a file's bytes, read once, in tasks."""
    return _spread(_files(spark, uri)).mapInPandas(_digesting(s3_options(spark)), "path string, name string, size long, etag string")


def fingerprint(files: DataFrame) -> tuple[int, str, int]:
    """Total bytes, content hash and number of files. The hash is that of a tree of two levels: 4096 bunches of files, by a hash of their names, so no task has all files."""
    bunches = files.groupBy(F.substring(F.sha2("name", 256), 1, 3).alias("bunch")).agg(F.sum("size").alias("size"), content_fingerprint(F.col("name"), F.col("size"), F.col("etag")).alias("digest"), F.count("*").alias("n"))
    row = bunches.agg(F.sum("size"), content_fingerprint(F.col("bunch"), F.col("n"), F.col("digest")), F.sum("n")).first()
    return int(row[0] or 0), row[1], int(row[2] or 0)


def stage(df: DataFrame, base: str, run: str, node: str, attempt: int) -> str:
    """Write an attempt's data, and record its number of rows, which is counted on the way."""
    uri, seen = staging_path(base, run, node, attempt), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(uri)
    _write(df.sparkSession, f"{uri}/{STAGED}", {"rows": seen.get["rows"], "schema": df.schema.json()})
    return uri


def _write(spark: SparkSession, uri: str, body: dict) -> None:
    fs, path = _fs(spark, uri)
    stream = fs.create(path, True)
    stream.write(bytearray(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()))
    stream.close()


def _read(spark: SparkSession, uri: str) -> dict | None:
    fs, path = _fs(spark, uri)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def create_once(spark: SparkSession, uri: str, body: dict) -> bool:
    """Create a small file with all its contents in one step. False, with nothing changed, if there is one already.

    Local files: a finished file gets its name by a hard link. S3: a conditional write, which the store decides. Others: a finished
    file is renamed, which fails where the name is taken, as HDFS does.
    """
    jvm, (fs, path) = spark.sparkContext._jvm, _fs(spark, uri)
    scheme = fs.getUri().getScheme()
    if scheme.startswith("s3"):
        stream = None
        try:
            stream = fs.createFile(path).overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
            stream.write(bytearray(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()))
            stream.close()
            return True
        except Exception:
            if fs.exists(path):
                return False
            raise
    draft = f"{uri}.{uuid.uuid4().hex}"
    _write(spark, draft, body)
    try:
        if scheme == "file":
            os.link(_local(draft), _local(uri))
            return True
        return bool(fs.rename(jvm.org.apache.hadoop.fs.Path(draft), path))
    except FileExistsError:
        return False
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(draft), False)


def _local(uri: str) -> str:
    return _store(uri)[1]


#: Hadoop settings of S3-compatible stores, and the arguments of Arrow's file system that they become.
S3_SETTINGS = {
    "fs.s3a.access.key": "access_key",
    "fs.s3a.secret.key": "secret_key",
    "fs.s3a.session.token": "session_token",
    "fs.s3a.endpoint": "endpoint_override",
    "fs.s3a.endpoint.region": "region",
}


def s3_options(spark: SparkSession) -> dict[str, str | bool]:
    """Arguments of Arrow's S3 file system from the session's `spark.hadoop.fs.s3a.*` settings."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: dict[str, str | bool] = {name: value for key, name in S3_SETTINGS.items() if (value := conf.get(key))}
    if "endpoint_override" in out:
        scheme, _, host = str(out["endpoint_override"]).rpartition("://")
        secure = conf.get("fs.s3a.connection.ssl.enabled") or "true"
        out |= {"endpoint_override": host, "scheme": scheme or ("https" if secure == "true" else "http")}
    out["force_virtual_addressing"] = (conf.get("fs.s3a.path.style.access") or "false") != "true"
    return out


def _store(uri: str, s3: dict[str, str | bool] | None = None):
    """The Arrow file system of an address, and the path in it."""
    from pyarrow import fs

    if m := re.match(r"(?:file:)?/+(.*)", uri):
        return fs.LocalFileSystem(), "/" + m[1]
    if m := re.match(r"s3[an]?://(.*)", uri):
        return fs.S3FileSystem(**(s3 or {})), m[1]
    return fs.FileSystem.from_uri(uri)


def _stream(source: str, target: str | None, s3: dict[str, str | bool]) -> str:
    """The sha256 of a file's bytes, which are copied on the way if there is a target."""
    from pyarrow import fs

    system, path = _store(source, s3)
    digest, out = hashlib.sha256(), None
    if target is not None:
        to, at = _store(target, s3)
        if isinstance(to, fs.LocalFileSystem):  # stores of objects have no folders
            to.create_dir(at.rpartition("/")[0], recursive=True)
        out = to.open_output_stream(at)
    with system.open_input_stream(path) as data:
        while chunk := data.read(CHUNK):
            digest.update(chunk)
            if out is not None:
                out.write(chunk)
    if out is not None:
        out.close()
    return digest.hexdigest()


def _copying(s3: dict[str, str | bool]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            etags = [_stream(source, target, s3) for source, target in zip(batch["path"], batch["target"], strict=True)]
            yield batch[["name", "size"]].assign(etag=etags)

    return run


def committing(spark: SparkSession, staging: str, committed: str, file_format: str = "parquet", replace: bool = False) -> Generator[str, None, Committed]:
    """The steps of `commit`, one at a time; between any two of them another attempt may do what it likes."""
    if file_format != "parquet":
        raise PublicationError(f"format {file_format!r} can't be published")
    fs, folder = _fs(spark, staging)
    files = _files(spark, staging) if fs.exists(folder) else None
    if files is None or files.isEmpty():
        raise PublicationError(f"nothing is staged at {staging}")
    yield "listed"
    own = f"data-{uuid.uuid4().hex}"
    uri = f"{checked_prefix(committed)}{own}"
    targets = files.withColumn("target", F.concat(F.lit(_absolute(uri) + "/"), "name"))
    copied = _spread(targets).mapInPandas(_copying(s3_options(spark)), "name string, size long, etag string")
    size, digest, n = fingerprint(copied)
    yield "copied"
    staged = _read(spark, f"{staging.rstrip('/')}/{STAGED}")
    if staged is None:  # not written by `stage`
        data = spark.read.parquet(uri)
        staged = {"rows": data.count(), "schema": data.schema.json()}
    result = Committed(committed, staging, size, staged["rows"], digest, staged["schema"], own)
    yield "described"
    marker = f"{committed.rstrip('/')}/{MARKER}"
    if replace:
        _write(spark, marker, asdict(result))
    elif not create_once(spark, marker, asdict(result)):
        yield "lost"
        delete_prefix(spark, uri)
        result = committed_as(spark, committed)
    yield "decided"
    return result


def commit(spark: SparkSession, staging: str, committed: str, file_format: str = "parquet", replace: bool = False) -> Committed:
    """Publish a staged dataset, unless another attempt has done so: then that one's dataset is returned and stays. With `replace`, this one takes its place.

    Whoever creates the marker first has committed, also among attempts that run at once.
    """
    steps = committing(spark, staging, committed, file_format, replace)
    while True:
        try:
            next(steps)
        except StopIteration as e:
            return e.value


def committed_as(spark: SparkSession, uri: str) -> Committed:
    """What is committed at an address; an error while nothing is."""
    marker = _read(spark, f"{uri.rstrip('/')}/{MARKER}")
    if marker is None:
        raise PublicationError(f"{uri} is not committed")
    return Committed(**marker)


def clear_leftovers(spark: SparkSession, uri: str) -> int:
    """Delete folders at a committed address that its marker doesn't name: those of attempts that died, lost or were replaced. Returns the number of folders.

    Only for when no attempt is under way, since one that is has a folder that isn't named yet.
    """
    keep = committed_as(spark, uri).folder
    fs, path = _fs(spark, uri)
    stale = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName() != keep]
    for folder in stale:
        delete_prefix(spark, folder.toString())
    return len(stale)


def _absolute(uri: str) -> str:
    return uri.rstrip("/") if "://" in uri or uri.startswith("file:") else "file://" + uri.rstrip("/")


def is_committed(spark: SparkSession, uri: str) -> bool:
    fs, path = _fs(spark, f"{uri.rstrip('/')}/{MARKER}")
    return bool(fs.exists(path))


def read_committed(spark: SparkSession, uri: str) -> DataFrame:
    """The dataset at a stable address; an error while it isn't committed."""
    return spark.read.parquet(f"{uri.rstrip('/')}/{committed_as(spark, uri).folder}")


def _deleting(s3: dict[str, str | bool]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                system, x = _store(path, s3)
                if system.get_file_info(x).type != fs.FileType.NotFound:
                    system.delete_file(x)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def delete_prefix(spark: SparkSession, uri: str) -> int:
    """Delete all objects in a folder, never those of folders whose names only begin alike. Returns their number; 0 when repeated."""
    prefix = checked_prefix(uri)
    fs, path = _fs(spark, prefix)
    if not fs.exists(path):
        return 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix).select("path")
    n = files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_deleting(s3_options(spark)), "n long").agg(F.sum("n")).first()[0] or 0
    fs.delete(path, True)
    return int(n)


def abort(spark: SparkSession, staging: str) -> int:
    return delete_prefix(spark, staging)


def publish(df: DataFrame, base: str, run: str, node: str, attempt: int = 1) -> DataFrame:
    """Stage and commit, and go on from the committed files: a checkpoint that outlives the application.

    A committed dataset is never replaced by a later attempt; if attempts run at once, all go on from the first one's. Asking first whether there is one saves work only.
    """
    spark, uri = df.sparkSession, committed_path(base, run, node)
    if not is_committed(spark, uri):
        commit(spark, stage(df, base, run, node, attempt), uri)
    return read_committed(spark, uri)


def first_commit(attempts: DataFrame, keys: list[str], order: list[str], ready: str) -> DataFrame:
    """Resolve commits over a table of attempts: of those that are `ready`, the first of each output is COMMITTED, later ones ABORTED; terminal rows stay."""
    rank = F.row_number().over(Window.partitionBy(*keys, F.expr(ready)).orderBy(*order))
    done = attempts.filter("state = 'COMMITTED'").select(*keys, F.lit(True).alias("__done")).distinct()
    rows = attempts.withColumn("__rank", rank).join(done, keys, "left")
    new = F.when(F.expr(f"state = 'STAGING' and ({ready})"), F.when((F.col("__rank") == 1) & F.col("__done").isNull(), "COMMITTED").otherwise("ABORTED"))
    return rows.withColumn("state", F.coalesce(new, "state")).drop("__rank", "__done")


def abort_rows(artifacts: DataFrame, condition: str) -> DataFrame:
    """The next snapshot of artifacts: staged ones that meet the condition are aborted; terminal rows stay."""
    return artifacts.withColumn("state", F.when(F.expr(f"state = 'STAGING' and ({condition})"), "ABORTED").otherwise(F.col("state")))


def committed_only(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter("state = 'COMMITTED'")
