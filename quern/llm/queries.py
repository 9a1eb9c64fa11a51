"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontamination, line_dedup, lm, media, merkle, nearest, ngram_join, packing, periodic, quality, sharding, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sharding.op1_hilbert_shards,
        decontamination.op2_decontamination,
        toxicity.op3_toxicity,
        suffix_dedup.op4_suffix_dedup,
        quality.op5_quality,
        lm.op6_lm_scores,
        line_dedup.op7_line_dedup,
        packing.op8_curve_packing,
        ngram_join.op9_ngram_join,
        media.op10_media,
        nearest.op11_nearest_neighbours,
        periodic.op12_periodic_runs,
        merkle.op13_merkle_proofs,
    )
}

ORACLE_SQL: dict[str, str] = {}
