"""A Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from its root.

Every row is a leaf, whose digest is that of its columns. The leaves of a group (a source), in order, are cut into runs of
`FAN` and each run gives one node, the digest of its children's; so on up to the group's one subroot. The subroots, in order
of groups, give the root in the same way. A digest is the lowercase hex sha256 of the concatenated inputs.

`Manifest.records` is the store: a record for each node, from its digest to its children. A request for a leaf starts
at the root. At each level, a digit of the leaf's rank, to the base `FAN`, picks the child to go on with; the
children not picked, to its left and right, are a segment of the path. Reversed, the segments are the leaf's proof: to fold it, the leaf's digest
is put between the two parts of each segment in turn and hashed.

Requests for leaves with a common beginning of ranks go down together, as one row for each node, and part at the last level. So
what is moved of a proof, other than in the task that hashes it, is one for each run of leaves.

Levels are built by grouping on (group, rank div FAN), so no key has more than FAN rows, however large
a group is; ranks come from one count for each range of the order. The number of rounds grows with the logarithm of the rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, read
from quern.llm.common import fold as fold_of
from quern.operators.selection import positions

FAN, _DIGIT = 16, 4  # children of a node; bits of a digit
#: Nodes of a level, in a row, that share a record if their digests agree. A digest that a great many nodes have, as those of
#: one repeated row do, has a record for each such stretch, so that it isn't one key for all of them.
STRETCH = 4096

_NO_PATH = "cast(array() AS array<struct<left: string, right: string>>)"


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: `-` for a null, else UTF-8 byte count, `:` and value for each."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _level(nodes: DataFrame) -> DataFrame:
    """The parents of nodes (grp, n, place, digest), with their children."""
    at = F.shiftright("place", _DIGIT).alias("place")
    up = nodes.groupBy("grp", "n", at).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x.digest).alias("children"))
    return up.select("grp", "n", "place", F.sha2(_joined(F.col("children")), 256).alias("digest"), "children")


def _tree(leaves: DataFrame, most: int, scratch: Scratch, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Tops (grp, digest, height) of groups of leaves (grp, n, place, digest), n being the group's size and `most` the largest, and the levels from the lowest on: (grp, n, place, digest, children)."""
    below = leaves.select("grp", "n", "place", "digest")
    levels: list[DataFrame] = []
    tops = below.filter("n = 1").select("grp", "digest", F.lit(0).alias("height"))
    while FAN ** len(levels) < most:
        level = scratch.save(_level(below.filter(F.col("n") > FAN ** len(levels))), f"{name}-{len(levels)}")
        levels.append(level)
        below = level.select("grp", "n", "place", "digest")
        tops = tops.unionAll(below.filter(F.col("n") <= FAN ** len(levels)).select("grp", "digest", F.lit(len(levels)).alias("height")))
    return scratch.save(tops, f"{name}-tops"), levels


def _found(front: DataFrame, level: DataFrame) -> DataFrame:
    """Nodes (grp, place, digest, path) with the children that the store's records of the level give for their digests."""
    stretch = F.expr(f"place div {STRETCH}").alias("stretch")
    records = level.select("digest", stretch, "children").groupBy("digest", "stretch").agg(F.first("children").alias("children"))
    return front.select("grp", "place", "digest", "path", stretch).join(records, ["digest", "stretch"]).select("grp", "place", "path", "children")


def _with_segment(path: Column, children: Column, digit: Column) -> Column:
    """The path with the children that `digit` doesn't pick before its first segment."""
    left, right = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(FAN))
    return F.concat(F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right"))), path)


def _step(front: DataFrame, level: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """From nodes (grp, place, digest, path) to their children, or to those of them with a (grp, place) in `wanted`."""
    down = _found(front, level).select("grp", "place", "path", "children", F.posexplode("children").alias("digit", "digest"))
    out = down.select("grp", (F.col("place") * FAN + F.col("digit")).alias("place"), "digest", _with_segment(F.col("path"), F.col("children"), F.col("digit")).alias("path"))
    return out if wanted is None else out.join(wanted, ["grp", "place"], "left_semi")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path, from the leaf up, give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s.left, digest, s.right), 256))


def path_digest(path: Column) -> Column:
    """The digest of a proof: of all its siblings, level by level from the leaf up, left to right."""
    return F.sha2(_joined(F.transform(path, lambda s: F.concat(s.left, s.right))), 256)


@dataclass
class Manifest:
    """Leaves (grp, n, place, digest, kept), subroots (grp, ordinal, digest, height), the levels of their trees and of the tree over subroots, and the root (None without rows)."""

    leaves: DataFrame
    subroots: DataFrame
    levels: list[DataFrame]
    upper: list[DataFrame]
    root: str | None

    def records(self) -> DataFrame:
        """The store: (digest, children) of each node that isn't a leaf, each once."""
        out = self.leaves.select("digest", F.array("digest").alias("children")).limit(0)
        for level in (*self.levels, *self.upper):
            out = out.unionAll(level.select("digest", "children"))
        return out.dropDuplicates(["digest"])

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """(kept, leaf, subroot, root, path) of all leaves, or of those whose digests are the column `leaf` of `requests`. A path has segments (left, right) from the leaf up."""
        scratch = Scratch(self.leaves.sparkSession, "merkle_proofs")
        leaves, asked, wanted = self.leaves, None, lambda k: None
        if requests is not None:
            leaves = leaves.join(requests.select(F.col("leaf").alias("digest")).distinct(), "digest", "left_semi")
            asked = scratch.save(leaves.select("grp", "place").distinct(), "asked")
            wanted = lambda k: asked.select("grp", F.shiftright("place", _DIGIT * k).alias("place")).distinct()
        subroots = self.subroots if asked is None else self.subroots.join(asked.select("grp").distinct(), "grp", "left_semi")
        # from the root to the subroots, by the digits of their ordinals
        front = self.subroots.sparkSession.range(1 if self.root else 0).select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("place"), F.lit(self.root).alias("digest"), F.expr(_NO_PATH).alias("path"))
        for k in range(len(self.upper) - 1, -1, -1):
            some = None if asked is None else subroots.select(F.lit("").alias("grp"), F.shiftright("ordinal", _DIGIT * k).alias("place")).distinct()
            front = scratch.save(_step(front, self.upper[k], some), f"upper-front-{k}")
        tops = front.select(F.col("place").alias("ordinal"), "path").join(subroots, "ordinal")
        tops = scratch.save(tops.select("grp", F.lit(0).cast("long").alias("place"), "digest", "path", "height"), "begin")
        # from the subroots to the runs of leaves, by the digits of ranks
        nodes = ("grp", "place", "digest", "path")
        front = tops.filter(F.col("height") == max(1, len(self.levels))).select(*nodes)
        for k in range(len(self.levels) - 1, 0, -1):
            front = scratch.save(_step(front, self.levels[k], wanted(k)), f"front-{k}")
            front = front.unionAll(tops.filter(F.col("height") == k).select(*nodes))
        runs = tops.filter("height = 0").select("grp", F.col("place").alias("run"), "path", F.lit(None).cast("array<string>").alias("children"))
        if self.levels:
            runs = runs.unionAll(_found(front, self.levels[0]).select("grp", "place", "path", "children"))
        runs = runs.join(self.subroots.select("grp", F.col("digest").alias("subroot")), "grp")
        out = leaves.withColumn("run", F.shiftright("place", _DIGIT)).join(runs, ["grp", "run"])
        digit = F.col("place").bitwiseAND(F.lit(FAN - 1)).cast("int")
        path = F.when(F.col("children").isNull(), F.col("path")).otherwise(_with_segment(F.col("path"), F.col("children"), digit))
        return out.select("kept", F.col("digest").alias("leaf"), "subroot", F.lit(self.root).alias("root"), path.alias("path"))


def manifest(df: DataFrame, columns: list[str], group: str, order: str, keep: list[Column]) -> Manifest:
    """The manifest of a table: leaves are digests of `columns`, grouped by `group` (null first, then bytewise), in order of `order` (null first).

    Rows of a group that agree in `order` are ordered by their digests; rows given twice are two leaves. `keep` comes along with each leaf, in the struct
    `kept`. An empty table has no root. Other columns are ignored. Groups may be of any number and size.
    """
    scratch = Scratch(df.sparkSession, "merkle")
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all others
    rows = df.select(grp.alias("grp"), F.col(order).alias("by"), leaf_digest([F.col(c) for c in columns]).alias("digest"), F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"))
    rows = scratch.save(rows, "rows")
    placed, _ = positions(rows, ["grp", "by", "digest", "row"], "position")
    sizes = scratch.save(placed.groupBy("grp").agg(F.min("position").alias("first"), F.count("*").alias("n")), "sizes")
    leaves = scratch.save(placed.join(sizes, "grp").select("grp", "n", (F.col("position") - F.col("first")).alias("place"), "digest", "kept"), "leaves")
    scratch.drop("rows")
    tops, levels = _tree(leaves, sizes.agg(F.max("n")).first()[0] or 0, scratch, "level")
    subroots, n = positions(tops, ["grp"], "ordinal")
    subroots = scratch.save(subroots, "subroots")
    over = subroots.select(F.lit("").alias("grp"), F.lit(n).cast("long").alias("n"), F.col("ordinal").alias("place"), "digest")
    top, upper = _tree(over, n, scratch, "upper")
    root = top.first()
    return Manifest(leaves, subroots, levels, upper, root.digest if root else None)


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, its proof, and the root folded from what may have been tampered with."""
    docs = read(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    altered = F.when(fold_of("doc_id", 5) == 0, leaf_digest([*map(F.col, columns[:-1]), lowered]))
    out = manifest(docs, columns, "source", "doc_id", [F.col("doc_id").cast("long").alias("doc_id"), altered.alias("altered")]).proofs()
    out = out.select("kept.doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("kept.altered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
