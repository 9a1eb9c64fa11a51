"""Tables of which each version shares the partitions that didn't change with the one before.

Rows lie in `parts` partitions by a hash of their key. A version is a small file that names, for each partition, the folder its rows are in.
A change writes the partitions it touches to new folders, and then creates the next version's file, in one step that fails if there is one: so readers
see one version or the next, never a mixture, and of two writers at once one is told to begin again. Folders of earlier versions stay until `forget` deletes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.publication import PublicationError, _fs, _read, create_once, delete_prefix


class Conflict(PublicationError):
    """Another writer made this version first."""


class Snapshots:
    """A table at a folder, with the columns of its key."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], parts: int = 64):
        self.spark, self.base, self.keys, self.parts = spark, base.rstrip("/"), keys, parts

    def _file(self, version: int) -> str:
        return f"{self.base}/versions/{version:09d}.json"

    def version(self) -> int:
        """The newest version; -1 before the first."""
        fs, path = _fs(self.spark, f"{self.base}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each partition that has rows."""
        found = _read(self.spark, self._file(self.version() if version is None else version))
        if found is None:
            raise PublicationError(f"{self.base} has no such version")
        return {int(p): folder for p, folder in found["folders"].items()}

    def _part(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.base}/{f}" for f in folders)) if folders else None

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        found = _read(self.spark, self._file(self.version() if version is None else version))
        rows = self._read(sorted(set(self.folders(version).values())))
        return rows if rows is not None else self.spark.createDataFrame([], found["schema"])

    def _write(self, rows: DataFrame, touched: list[int], kept: dict[int, str], version: int) -> int:
        """Write the rows of the touched partitions, and make the version of them and of those kept."""
        run = f"data/{version:09d}-{uuid.uuid4().hex}"
        schema = rows.schema.simpleString()[7:-1] if rows.columns else ""
        rows.withColumn("__part", self._part()).repartition("__part").write.partitionBy("__part").parquet(f"{self.base}/{run}")
        fs, path = _fs(self.spark, f"{self.base}/{run}")
        made = {int(s.getPath().getName().split("=")[1]): f"{run}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.isDirectory()}
        folders = {p: f for p, f in kept.items() if p not in touched} | made
        if not create_once(self.spark, self._file(version), {"folders": {str(p): f for p, f in sorted(folders.items())}, "schema": schema}):
            delete_prefix(self.spark, f"{self.base}/{run}")
            raise Conflict(f"version {version} of {self.base} was made by another writer")
        return version

    def create(self, rows: DataFrame) -> int:
        """The first version; an error if there is one."""
        return self._write(rows, list(range(self.parts)), {}, 0)

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """The next version: old rows with keys in `rows` or `gone` go, `rows` are added. Only partitions with such keys are read and written.

        Returns the version; the newest one if nothing is to change.
        """
        now = self.version()
        folders = self.folders(now)
        keys = [df.select(*self.keys) for df in (rows, gone) if df is not None]
        named = keys[0] if len(keys) == 1 else keys[0].unionAll(keys[1])
        touched = [r[0] for r in named.select(self._part()).distinct().collect()]  # at most `parts`
        if not touched:
            return now
        old = self._read([folders[p] for p in touched if p in folders])
        new = rows
        if old is not None:
            stay = old.join(named.distinct(), self.keys, "left_anti")
            new = stay if rows is None else stay.unionByName(rows)
        return self._write(new if new is not None else self.read(now).limit(0), touched, folders, now + 1)

    def forget(self, keep: int = 1) -> int:
        """Delete the versions before the last `keep`, and folders that none of those names. Returns the number of folders deleted. For when no writer is at work and nobody reads an old version."""
        last = self.version()
        kept = {f for v in range(max(0, last - keep + 1), last + 1) for f in self.folders(v).values()}
        gone = {f for v in range(max(0, last - keep + 1)) if (found := _read(self.spark, self._file(v))) for f in found["folders"].values()} - kept
        for folder in gone:
            delete_prefix(self.spark, f"{self.base}/{folder}")
        fs, _ = _fs(self.spark, self.base)
        for v in range(max(0, last - keep + 1)):
            fs.delete(_fs(self.spark, self._file(v))[1], False)
        return len(gone)
