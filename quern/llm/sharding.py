"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to `bits` bits each, a row's cell on the Hilbert curve is its sort
key, and the sorted rows are cut into runs of equal counts. Rows that are close in all dimensions come
to lie in the same files, so a filter on any of them can skip the others.

The order needs each row's global position. No task ever sees all rows: positions are the offset of
the row's cell, plus that of its slice of the cell, plus its rank in the slice. Cells are at most
2 ** (bits * dimensions), and a cell with many rows is dealt into slices by a hash of the id; a slice that is
still large, since it holds one row many times, is dealt once more by row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, fresh, read

#: Rows of one slice of a cell; larger only when that would make more than MAX_SLICES slices.
SLICE_ROWS, MAX_SLICES = 512, 1 << 16


def bucket(column: Column | str, bits: int) -> Column:
    """A category as one of 2 ** bits numbers, by hash; null is a category."""
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(1 << bits)).cast("int")


def magnitude(column: Column | str, bits: int) -> Column:
    """The binary logarithm of a count, cut to `bits` bits; null and negative numbers count as 0."""
    value = F.greatest(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0)), F.lit(0))
    return F.least(F.floor(F.log2(value + 1)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(df: DataFrame, dims: list[str], bits: int, to: str) -> DataFrame:
    """Add the Hilbert index of integer columns `dims`, each in [0, 2 ** bits), by Skilling's transposition (2004).

    Every step is a column expression. Meant for tables of distinct cells, not of rows.
    """
    keep = df.columns
    x = [f"__h{i}" for i in range(len(dims))]
    df = df.select(*keep, *(F.col(d).cast("long").alias(a) for d, a in zip(dims, x, strict=True)))
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, name in enumerate(x):
            set_bit = F.col(name).bitwiseAND(F.lit(1 << level)) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(name)).bitwiseAND(F.lit(low))
            first = F.when(set_bit, F.col(x[0]).bitwiseXOR(F.lit(low)))
            if i == 0:
                df = df.withColumn(name, first.otherwise(F.col(name)))
            else:
                df = df.withColumns({x[0]: first.otherwise(F.col(x[0]).bitwiseXOR(swap)), name: F.when(set_bit, F.col(name)).otherwise(F.col(name).bitwiseXOR(swap))})
    for a, b in zip(x, x[1:]):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    flip: Column = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__flip", flip)
    index: Column = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for name in x:
            bit = F.shiftright(F.col(name).bitwiseXOR(F.col("__flip")), level).bitwiseAND(F.lit(1))
            index = F.shiftleft(index, 1).bitwiseOR(bit)
    return df.select(*keep, index.alias(to))


def hilbert_positions(df: DataFrame, dims: dict[str, Column], bits: int, tie: list[Column], keep: list[Column], name: str = "hilbert") -> tuple[DataFrame, int]:
    """Rows of `keep` with `curve` (index of the cell) and `position` (gapless from 0 along the curve); and the number of rows.

    Inside a cell, rows are ordered by slice, then by `tie`. A cell's number is bounded, so the cells are
    broadcast; rows are shuffled once, without their texts.
    """
    scratch = Scratch(df.sparkSession, name)
    if bits * len(dims) > 14:
        raise ValueError("at most 14 bits in all, so that the table of cells stays small")
    names = [f"d{i}" for i in range(len(dims))]
    rows = df.select(*(c.alias(n) for n, c in zip(names, dims.values(), strict=True)), F.xxhash64(*tie).alias("__mix"), F.monotonically_increasing_id().alias("__row"), F.struct(*tie).alias("__tie"), *keep)
    rows = scratch.save(rows, "rows")
    cells = rows.groupBy(*names).count()
    cells = hilbert_index(cells, names, bits, "curve")
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.save(cells.withColumn("before", F.coalesce(F.sum("count").over(along), F.lit(0))), "cells")
    total = cells.agg(F.sum("count")).first()[0] or 0
    size = max(SLICE_ROWS, -(-total // MAX_SLICES))
    cells = cells.withColumn("slices", F.ceil(F.col("count") / F.lit(size)))
    placed = rows.join(F.broadcast(cells), names).withColumn("slice", F.pmod("__mix", "slices"))
    large = placed.groupBy("curve", "slice").agg(F.count("*").alias("rows")).filter(F.col("rows") > 4 * size)
    large = scratch.save(large.select("curve", "slice", F.ceil(F.col("rows") / F.lit(size)).alias("parts")), "large")  # at most one for 4 * size rows
    part = F.coalesce(F.pmod("__row", F.col("parts")), F.lit(0))
    placed = placed.join(F.broadcast(large), ["curve", "slice"], "left").withColumn("slice", F.struct("slice", part.alias("part")))
    slices = placed.groupBy("curve", "slice", "before").count()
    inside = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("curve", "slice", (F.col("before") + F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("curve", "slice").orderBy("__tie")) - 1)
    out = ranked.join(starts, ["curve", "slice"]).withColumn("position", F.col("start") + F.col("rank"))
    return out.drop(*names, "__mix", "__row", "parts", "__tie", "count", "before", "slices", "slice", "rank", "start"), total


def _metadata(bits: int) -> tuple[dict[str, Column], Column, Column]:
    """Dimensions of documents, their size and the checksum of their text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    return {"source": bucket("source", bits), "lang": bucket("lang", bits), "size": magnitude(size, bits)}, size, crc


def _shard(total: int, shards: int) -> Column:
    return F.expr(f"cast((position * {shards}L) div {max(total, 1)}L as int)")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = 4) -> DataFrame:
    """Deal documents (doc_id, text, lang, source) into `shards` runs of the Hilbert curve over source, language and size.

    Counts of shards differ by one at most. Null in any column is a value like any other; a null text has
    size 1. Repeated rows are each placed. An empty table gives an empty result. Other columns are ignored.
    """
    dims, size, crc = _metadata(bits)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    rows, total = hilbert_positions(docs, dims, bits, [F.col("doc_id"), crc, size], [F.col("doc_id"), size.alias("size"), crc.alias("text_crc32")], "hilbert_shards")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return rows.withColumn("shard", _shard(total, shards)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = 4) -> None:
    """Write documents as one folder a shard, rows in order of the curve, so that file statistics of any dimension allow skipping.

    Whole rows are placed, so each row is written once, null and repeated ids and repeated rows too. The folders are named by `shard`,
    with underscores added where the documents have such a column.
    """
    dims, size, crc = _metadata(bits)
    rows, total = hilbert_positions(docs, dims, bits, [F.col("doc_id"), crc, size], [F.struct(*docs.columns).alias("row")], "write_shards")
    name, place = fresh(docs, "shard"), fresh(docs, "__place")
    placed = rows.select(_shard(total, shards).alias(name), F.col("position").alias(place), "row.*")
    placed.repartitionByRange(shards, name).sortWithinPartitions(name, place).drop(place).write.partitionBy(name).parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(read(spark, sf_dir, "documents"))
