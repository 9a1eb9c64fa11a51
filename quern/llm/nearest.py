"""Approximate nearest neighbours by cosine: an inverted index whose lists are scanned with adaptive dimensions.

Vectors are scaled to length 1 and turned by a random rotation, after which any first d of the D coordinates estimate a distance:
D / d times the partial square, within a relative error that shrinks with d (ADSampling: Gao and Long 2023). The index keeps
each list as blocks of vectors in columns of COLUMN coordinates. A scan adds up a column at a time and tests the hypothesis that
the candidate is nearer than the worst of the neighbours so far; where it is rejected, the candidate is abandoned.
What comes through all columns gets its exact cosine, in double precision on the original vectors.

Lists. k-means on a sample of at most SAMPLE_ROWS rows and SAMPLE_BYTES fits the centroids; every row is indexed. A query first scans its FIRST nearest lists.
The worst cosine found is then a bound, and each other list is expected to hold so many rows beyond it: rows of a list spread about its centroid
like a normal variable along the query. Lists are taken in order of that number until what is left is expected to miss at most MISSED rows. So
the number of probed lists falls where the data has clusters, and grows where it has none.

Equal vectors are searched once and are one candidate, which stands for its KEPT least ids: no more of them can be among
the nearest. Lists are dealt into parts of PART_ROWS, so a list with most of all rows is scanned by many tasks, and queries
meet a part in batches: a task holds one batch and one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, read

NEAREST = 5
SAMPLE_ROWS, SAMPLE_BYTES, MAX_LISTS, ROUNDS = 1 << 15, 1 << 26, 2048, 8
#: Lists that a query scans first; rows that the lists it doesn't scan are expected to hold beyond the bound, of `nearest`.
FIRST, MISSED = 2, 0.25
COLUMN, PART_ROWS, BLOCK_ROWS, BATCH_ROWS = 16, 8192, 512, 256
#: Slack of the test: errors of more than ERROR / sqrt(d) are as rare as those of a normal variable beyond that many deviations.
ERROR = 2.1
_SLACK = 1e-5  # for single precision


def usable(column: str) -> Column:
    """Whether a vector takes part: no null, no component that is null, NaN or infinite, not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of lists of `dims` numbers as an array of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / top  # so that squares neither overflow nor vanish
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


@dataclass
class Lists:
    """The rotation and the centroids (rotated); after counting, the rows of each list and their mean squared distance from it."""

    rotation: np.ndarray
    centroids: np.ndarray
    rows: np.ndarray | None = None
    spread: np.ndarray | None = None

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return unit(vectors) @ self.rotation

    def of(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each vector, and the squared distance from it."""
        d = (self.centroids * self.centroids).sum(1) - 2 * (turned @ self.centroids.T)
        best = d.argmin(1)
        return best, np.maximum(0, d[np.arange(len(best)), best] + 1)

    def first(self, turned: np.ndarray) -> np.ndarray:
        """The FIRST nearest lists of each vector, in rows."""
        d = (self.centroids * self.centroids).sum(1) - 2 * (turned @ self.centroids.T)
        return np.argsort(d, 1, kind="stable")[:, :FIRST]

    def further(self, turned: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of the other lists to scan for rows with a cosine beyond `bound`."""
        deviation = np.sqrt(np.maximum(self.spread, 1e-12) / self.centroids.shape[1])
        expected = self.rows * _beyond((bound[:, None] - turned @ self.centroids.T) / deviation)
        np.put_along_axis(expected, self.first(turned), 0.0, 1)
        order = np.argsort(-expected, 1, kind="stable")
        left = np.take_along_axis(expected, order, 1)[:, ::-1].cumsum(1)[:, ::-1]  # in this list and all that come after
        query, at = np.nonzero(left > MISSED)
        return query, order[query, at]


def _beyond(z: np.ndarray) -> np.ndarray:
    """The probability that a normal variable exceeds z (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-np.minimum(z * z, 1400) / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, tail, 1 - tail)


def fit(sample: np.ndarray, n: int, seed: int = 7) -> Lists:
    """Rotation and centroids from a sample of a table of n vectors."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))
    rotation = q * np.sign(np.diag(r))
    x = unit(sample) @ rotation
    k = int(max(1, min(round(n**0.5), MAX_LISTS, len(x) // 16)))
    lists = Lists(rotation, x[np.sort(rng.choice(len(x), k, replace=False))])
    for _ in range(ROUNDS):
        total, count = np.zeros_like(lists.centroids), np.zeros(k)
        for part in np.array_split(x, max(1, len(x) * k >> 22)):
            at = lists.of(part)[0]
            np.add.at(total, at, part)
            count += np.bincount(at, minlength=k)
        lists.centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], lists.centroids)
    return lists


def abandoning_scan(queries: np.ndarray, columns: list[np.ndarray], dims: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, candidate) pairs that no test rejects, and the coordinates compared.

    `queries` are rotated unit vectors in rows, `columns` those of the candidates, cut into columns of coordinates; `bound` is the squared
    distance that a candidate of each query may have at most.
    """
    done, compared = 0, 0
    query = candidate = partial = None
    for block in columns:
        begin, done = done, done + block.shape[1]
        part = queries[:, begin:done]
        if query is None:
            partial = (part * part).sum(1)[:, None] + (block * block).sum(1) - 2 * (part @ block.T)
            compared += partial.size * block.shape[1]
        else:
            step = part[query] - block[candidate]
            partial = partial + np.einsum("ij,ij->i", step, step)
            compared += len(query) * block.shape[1]
        slack = (1 + ERROR / done**0.5) ** 2 * done / dims if done < dims else 1.0
        limit = bound * (slack * (1 + _SLACK)) + _SLACK
        if query is None:
            query, candidate = np.nonzero(partial <= limit[:, None])
            partial = partial[query, candidate]
        else:
            keep = partial <= limit[query]
            query, candidate, partial = query[keep], candidate[keep], partial[keep]
    return query, candidate, compared


INDEX = "list int, part int, size int, ids binary, vectors binary, columns array<binary>"
ASKED = "list int, part int, batch long, ids binary, vectors binary, bounds binary"
FOUND = "query long, candidate long, least long, score double"


class Best:
    """The best candidates of a batch of queries so far: score, largest first, ties to the smaller of their least ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, kept: int):
        self.ids, self.vectors, self.bounds, self.kept = ids, vectors, bounds, kept
        self.query, self.candidate, self.score = np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0)

    def limit(self) -> np.ndarray:
        """The squared distance that a further candidate of each query may have: that of the worst of those kept, if they are enough."""
        worst = self.bounds.copy()
        count = np.bincount(self.query, minlength=len(self.ids))
        if len(self.query):
            low = np.full(len(self.ids), np.inf)
            np.minimum.at(low, self.query, self.score)
            worst = np.where(count >= self.kept, np.maximum(worst, low), worst)
        return np.where(np.isfinite(worst), 2 - 2 * worst, np.inf)

    def add(self, query: np.ndarray, candidate: np.ndarray, score: np.ndarray) -> None:
        query, candidate, score = np.concatenate([self.query, query]), np.concatenate([self.candidate, candidate]), np.concatenate([self.score, score])
        order = np.lexsort((candidate[:, 0], candidate[:, 1], -score, query))
        query, candidate, score = query[order], candidate[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.kept
        self.query, self.candidate, self.score = query[keep], candidate[keep], score[keep]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), *(pa.array(np.ascontiguousarray(self.candidate[:, k])) for k in (0, 1)), pa.array(self.score)], [x.split()[0] for x in FOUND.split(", ")])


def scan(dims: int, kept: int):
    """A function for mapInArrow over pairs of a batch of queries and a block of a list's part: the best `kept` candidates of each query, in what the task sees of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for rows in batches:
            for k in range(rows.num_rows):
                row = rows.slice(k, 1).to_pylist()[0]
                if (row["list"], row["part"], row["batch"]) != now:
                    if best is not None:
                        yield best.rows()
                    now = row["list"], row["part"], row["batch"]
                    original = np.frombuffer(row["q_vectors"], np.float64).reshape(-1, 2, dims)
                    best = Best(np.frombuffer(row["q_ids"], np.int64), original[:, 0], np.frombuffer(row["bounds"], np.float64), kept)
                    turned = original[:, 1].astype(np.float32)
                ids, vectors = np.frombuffer(row["ids"], np.int64).reshape(-1, 2), np.frombuffer(row["vectors"], np.float64).reshape(-1, dims)
                columns = [np.frombuffer(c, np.float32).reshape(len(ids), -1) for c in row["columns"]]
                begin = 0
                while begin < len(ids):  # without a bound, a few rows are compared in full to get one
                    end = min(len(ids), 32) if begin == 0 and np.isinf(best.limit()).any() else len(ids)
                    q, c, _ = abandoning_scan(turned, [x[begin:end] for x in columns], dims, best.limit())
                    c = c + begin
                    for part in np.array_split(np.arange(len(q)), max(1, len(q) * dims >> 20)):
                        best.add(q[part], ids[c[part]], cosines(best.vectors[q[part]], vectors[c[part]]))
                    begin = end
        if best is not None:
            yield best.rows()

    return run


class NearestIndex:
    """An index of vectors (cid, least, embedding), all different; `least` is the least id of the rows that have the vector."""

    def __init__(self, vectors: DataFrame, dims: int, scratch: Scratch):
        """Fit lists on a bounded sample, and write the blocks of all vectors."""
        self.dims, self.scratch, self.spark = dims, scratch, vectors.sparkSession
        n = vectors.count()
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
        share = min(1.0, most / max(n, 1))
        sampled = vectors.filter(F.pmod(F.xxhash64(F.lit(13), "embedding"), F.lit(1 << 20)) <= int(share * (1 << 20))).select(F.col("embedding").cast("array<double>")).limit(2 * most)
        sample = sampled.toArrow().column(0).combine_chunks()
        self.lists = lists = fit(matrix(sample, dims) if len(sample) else np.eye(1, dims), n)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at, distance = lists.of(lists.turned(matrix(batch.column(1), dims)))
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0), batch.column(2), batch.column(1), pa.array(distance)], ["list", "cid", "least", "embedding", "distance"])

        rows = vectors.select("cid", F.col("embedding").cast("array<double>").alias("embedding"), "least")
        assigned = rows.mapInArrow(assign, "list int, cid long, least long, embedding array<double>, distance double")
        assigned = scratch.save(assigned, "assigned")
        counts = assigned.groupBy("list").agg(F.count("*").alias("rows"), F.avg("distance").alias("spread"))
        lists.rows, lists.spread = np.zeros(len(lists.centroids)), np.zeros(len(lists.centroids))
        for row in counts.collect():  # at most MAX_LISTS
            lists.rows[row.list], lists.spread[row.list] = row.rows, row.spread
        parts = self.parts()

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, part, cid, vectors, least in _grouped(batches, dims, BLOCK_ROWS):
                turned = lists.turned(vectors).astype(np.float32)
                columns = [turned[:, c : c + COLUMN].tobytes() for c in range(0, dims, COLUMN)]
                yield pa.RecordBatch.from_pylist([{"list": at, "part": part, "size": len(cid), "ids": np.stack([cid, least], 1).tobytes(), "vectors": vectors.tobytes(), "columns": columns}], _arrow(INDEX))

        dealt = assigned.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "part").select("list", "part", "cid", "embedding", "least")
        self.blocks = scratch.save(dealt.mapInArrow(block, INDEX), "blocks")
        scratch.drop("assigned")

    def parts(self) -> DataFrame:
        """(list, parts) of all lists that have rows, at most MAX_LISTS."""
        return self.spark.createDataFrame([(k, -(-int(n) // PART_ROWS)) for k, n in enumerate(self.lists.rows) if n] or [(-1, 1)], "list int, parts int")

    def search(self, queries: DataFrame, kept: int) -> DataFrame:
        """(query, candidate, least, score): the `kept` best candidates found of each query of (cid, embedding), itself included if it is indexed."""
        queries = queries.select("cid", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(float("-inf")).alias("bound"))
        near = self.scratch.save(_top(self._probe(queries, False, kept), kept), "near")
        worst = near.groupBy("query").agg(F.when(F.count("*") >= kept, F.min("score")).otherwise(float("-inf")).alias("worst"))
        bounded = queries.join(worst.withColumnRenamed("query", "cid"), "cid", "left").select("cid", "embedding", F.coalesce("worst", "bound").alias("bound"))
        return _top(near.unionAll(self._probe(bounded, True, kept)), kept)

    def _probe(self, queries: DataFrame, further: bool, kept: int) -> DataFrame:
        dims, lists = self.dims, self.lists

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                turned = lists.turned(matrix(batch.column(1), dims))
                if further:
                    query, at = lists.further(turned, batch.column(2).to_numpy())
                else:
                    first = lists.first(turned)
                    query, at = np.repeat(np.arange(len(first)), first.shape[1]), first.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(batch.column(c).take(pa.array(query)) for c in range(3))], ["list", "cid", "embedding", "bound"])

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, (at, part, ids, vectors, bounds) in enumerate(_grouped(batches, dims, BATCH_ROWS)):
                both = np.stack([vectors, lists.turned(vectors)], 1)
                yield pa.RecordBatch.from_pylist([{"list": at, "part": part, "batch": number, "ids": ids.tobytes(), "vectors": both.tobytes(), "bounds": bounds.tobytes()}], _arrow(ASKED))

        routed = queries.mapInArrow(route, "list int, cid long, embedding array<double>, bound double")
        dealt = routed.join(F.broadcast(self.parts()), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "embedding", "bound")
        batches = dealt.repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(together, ASKED)
        batches = batches.select("list", "part", "batch", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "bounds")
        pairs = batches.join(self.blocks.hint("merge"), ["list", "part"])
        return pairs.mapInArrow(scan(dims, kept), FOUND)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _grouped(batches: Iterator[pa.RecordBatch], dims: int, most: int) -> Iterator[tuple]:
    """From rows (list, part, cid, embedding, one more) in order of (list, part): groups of at most `most` rows of one part, as arrays."""
    held: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> Iterator[tuple]:
        nonlocal held
        at, part = table["list"].to_numpy(), table["part"].to_numpy()
        ends = np.append(np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0)) + 1, len(at))
        begin = 0
        for end in ends:
            while end - begin >= most or (end > begin and (last or end < len(at))):
                rows = table.slice(begin, min(most, end - begin)).combine_chunks()
                yield int(at[begin]), int(part[begin]), rows["cid"].to_numpy(), matrix(rows["embedding"].combine_chunks(), dims), rows.column(4).to_numpy()
                begin += rows.num_rows
        held = table.slice(begin)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= most:
            yield from cut(held, False)
    if held is not None and held.num_rows:
        yield from cut(held, True)


def _top(found: DataFrame, kept: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least", "candidate"))
    return found.withColumn("place", place).filter(F.col("place") <= kept).drop("place")


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = NEAREST) -> DataFrame:
    """The k nearest rows of `vectors` to each row of `queries` (both id, vector) by cosine, without the row itself: query_id, rank, vec_id, score.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id, nor
    those of another length than most of `vectors` have (of two such, the smaller). A row is known by id and vector: given
    twice, it is one; two rows with one id are two. Ties go to the smaller id. Fewer than k candidates give fewer rows, a query that is alone none. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding")).filter(usable("embedding") & F.col("vec_id").isNotNull())
    asked = queries.select(F.col(id_column).cast("long").alias("query_id"), F.col(column).alias("embedding")).filter(usable("embedding") & F.col("query_id").isNotNull())
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = lengths.dims if lengths else 1
    rows, asked = rows.filter(F.size("embedding") == dims), asked.filter(F.size("embedding") == dims).distinct()
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = rows.distinct().withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # queries that are no row of `vectors` are looked up too: their classes have no ids
    known = asked.join(classes.select("embedding", "cid"), "embedding", "left")
    asked = scratch.save(known.withColumn("qid", F.coalesce("cid", -1 - F.monotonically_increasing_id())), "asked")
    index = NearestIndex(classes.select("cid", "embedding", F.get("ids", F.lit(0)).alias("least")), dims, scratch)
    found = index.search(asked.groupBy(F.col("qid").alias("cid")).agg(F.first("embedding").alias("embedding")), k + 1)
    members = found.withColumnRenamed("candidate", "cid").join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"), "cid")
    answer = F.struct((-F.col("score")).alias("order"), "vec_id", "score", "cid")
    answers = members.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(answer)), 1, k + 1).alias("answers"))  # at most (k + 1) ** 2 for each
    own = lambda a: (a.vec_id == F.col("query_id")) & (a.cid == F.col("qid"))
    taken = asked.join(answers.withColumnRenamed("query", "qid"), "qid").select("query_id", F.slice(F.filter("answers", lambda a: ~own(a)), 1, k).alias("answers"))
    return taken.select("query_id", F.posexplode("answers").alias("at", "a")).select("query_id", (F.col("at") + 1).alias("rank"), "a.vec_id", "a.score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
