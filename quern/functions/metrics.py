"""Counts, duration buckets, and rates over trailing time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Usual bounds of duration histograms, in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def counts(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def durations(rows: DataFrame, seconds: Column, *labels: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative buckets (le), number and sum of durations by label; negative ones count as 0. One pass, then a row for each bound and infinity."""
    d = rows.filter(seconds.isNotNull()).select(*labels, F.greatest(seconds, F.lit(0.0)).alias("d"))
    sums = [F.count_if(F.col("d") <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = d.groupBy(*labels).agg(F.count("*").alias("n"), F.sum("d").alias("total"), *sums)
    each = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("count")))
    return wide.select(*labels, "n", "total", F.explode(each).alias("b")).select(*labels, "n", "total", "b.le", "b.count")


def trailing(rows: DataFrame, at: str, seconds: int, labels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Each row with measures over the rows of its labels in the `seconds` up to and with its own time.

    The window is partitioned by labels and, so that a frequent label is not one task's work, by blocks of the
    window's length: each row is also dealt to the next block, where it only counts for others. Any aggregate will do, but Spark
    computes it anew for each row, in time that is the rows times those of a window: see `trailing_sums` and `trailing_percentile`.
    """
    epoch = F.unix_micros(F.col(at).cast("timestamp"))
    block = F.floor(epoch / F.lit(seconds * 1_000_000))
    both = rows.withColumns({"__t": epoch, "__b": block, "__own": F.lit(True)}).unionAll(rows.withColumns({"__t": epoch, "__b": block + 1, "__own": F.lit(False)}))
    w = Window.partitionBy(*labels, "__b").orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    return both.withColumns({k: v.over(w) for k, v in measures.items()}).filter("__own").drop("__t", "__b", "__own")


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def trailing_sums(rows: DataFrame, at: str, seconds: int, labels: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Each row with sums of amounts (numbers, 1 to count) over the rows of its labels in the `seconds` up to and with its own time.

    A running sum, so time is that of sorting, whatever a window holds: a row adds its amounts at its time and takes them back once the
    window has passed it. So that a frequent label is not one task's work, sums run in blocks of the window's length, to which
    rows of the block before are dealt as well. Sums of whole numbers are exact; of floating-point ones they are as good as a running sum is.
    """
    width = seconds * 1_000_000
    t, block = F.col("__t"), F.floor(_micros(at) / F.lit(width))
    changes = F.array(*(F.struct(when.alias("t"), F.lit(later).alias("later"), F.lit(sign).alias("sign")) for when, later, sign in ((t, 0, 1), (t, 1, 1), (t + width + 1, 1, -1))))
    each = rows.select(F.struct(*rows.columns).alias("__row"), *labels, _micros(at).alias("__t"), block.alias("__b"), *(v.alias(k) for k, v in amounts.items())).withColumn("__c", F.explode(changes))
    own = F.col("__c.later") == 0
    w = Window.partitionBy(*labels, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stream = each.select(F.when(own, F.col("__row")).alias("__row"), *labels, (F.col("__b") + F.col("__c.later")).alias("__b"), F.col("__c.t").alias("__t"), *((F.col(k) * F.col("__c.sign")).alias(k) for k in amounts))
    return stream.withColumns({k: F.sum(k).over(w) for k in amounts}).filter("__row is not null").select("__row.*", *amounts)


def kth_in_ranges(places: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each range start..end of `places` (the numbers from 0, each once), its k-th least number (k from 0), for all ranges at once by a wavelet matrix: one step a bit."""
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(max(len(places) - 1, 0).bit_length())):
        one = (places >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b = zeros[start], zeros[end]
        up = k >= b - a
        k = np.where(up, k - (b - a), k)
        start, end = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + end - b, b)
        found |= up.astype(np.int64) << bit
        places = np.concatenate([places[~one], places[one]])
    return found


def _percentiles(times: np.ndarray, values: np.ndarray, asked: np.ndarray, width: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The exact, interpolated percentile of the values in the `width` up to each time asked for, and how many they are."""
    order = np.argsort(times, kind="stable")
    times, by_value = times[order], np.argsort(values[order], kind="stable")  # NaN last, as in SQL
    places, sorted_values = np.empty(len(order), np.int64), values[order][by_value]
    places[by_value] = np.arange(len(order))
    start, end = np.searchsorted(times, asked - width, "left"), np.searchsorted(times, asked, "right")
    n = end - start
    some = n > 0
    position = share * (n[some] - 1)
    low, high = np.floor(position).astype(np.int64), np.ceil(position).astype(np.int64)
    found = np.full(len(asked), np.nan)
    if some.any():
        v, w = (sorted_values[kth_in_ranges(places, start[some], end[some], k)] for k in (low, high))
        with np.errstate(invalid="ignore"):
            found[some] = np.where((low == high) | (v == w), v, (high - position) * v + (position - low) * w)
    return found, n


def trailing_percentile(rows: DataFrame, at: str, seconds: int, labels: list[str], value: str, share: float, name: str) -> DataFrame:
    """Each row with the exact percentile (interpolated) of `value` over the rows of its labels in the `seconds` up to and with its own time; null if all are null.

    Each row is dealt to its block of the window's length and to the next. In a block all rows are answered together, in time that is that of sorting, not that of rows times a window's rows. A task
    holds numbers of a label's rows in two windows (for windows too large for that, see `sliding_quantiles`).
    """
    width = seconds * 1_000_000
    block, kept = F.floor(_micros(at) / F.lit(width)), rows.schema
    blocks = F.when(block.isNull(), F.array(block)).otherwise(F.array(block, block + 1))
    each = rows.withColumns({"__t": _micros(at), "__v": F.col(value).cast("double"), "__b": F.explode(blocks)}).withColumn("__own", F.col("__b").eqNullSafe(block))

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(table["__own"])
        full = table.filter(table["__v"].is_valid())
        times, asked = (x["__t"].fill_null(0).to_numpy() for x in (full, own))  # rows without a time are a group, and one another's window
        found, n = _percentiles(times, full["__v"].to_numpy(), asked, width, share)
        return own.select(kept.names).append_column(name, pa.array(found, mask=n == 0))

    schema = StructType([*kept.fields, StructField(name, DoubleType())])
    return each.groupBy(*labels, "__b").applyInArrow(run, schema)


def by_window(rows: DataFrame, at: str, width: str, labels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures by label and tumbling window."""
    return rows.groupBy(F.window(at, width).alias("w"), *labels).agg(*(c.alias(k) for k, c in measures.items())).select(F.col("w.start").alias("window_start"), *labels, *measures)


def sliding_quantiles(rows: DataFrame, at: str, slide_s: int, slides: int, labels: list[str], value: str, shares: list[float], k: int = 800) -> DataFrame:
    """(labels, window_end, n, quantiles): for each label and step of `slide_s` seconds that has rows in its window, quantiles of `value` over the last `slides` steps.

    Each row goes into one KLL sketch, that of its label and step; a window merges the sketches of its steps. So time is linear in the rows,
    whatever the windows hold, and what is shuffled are sketches, of some `k` numbers at most. A quantile is a value of the window, the least whose rank
    reaches its share, exact for windows of fewer than `k` values; beyond, ranks are off by less than 3 / k of the rows in all but about one case of a hundred.
    Nulls and NaN of `value` and nulls of `at` don't count. A window with no such rows has no row.
    """
    step = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(slide_s * 1_000_000))
    own = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(at).isNotNull())
    sketches = own.groupBy(*labels, step.alias("step")).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    windows = sketches.withColumn("step", F.explode(F.sequence(F.col("step"), F.col("step") + slides - 1)))
    merged = windows.groupBy(*labels, "step").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    end = F.timestamp_micros((F.col("step") + 1) * F.lit(slide_s * 1_000_000))
    found = F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares))
    return merged.select(*labels, end.alias("window_end"), F.kll_sketch_get_n_double("sketch").alias("n"), found.alias("quantiles"))
