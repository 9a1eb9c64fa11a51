from __future__ import annotations

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table of documents from (doc_id, text) pairs."""

    def make(rows, extra: bool = False):
        df = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source=f"s{k % 3}", n_chars=len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)
        if extra:  # columns with names that operators use inside
            for c in ("id", "key", "n", "cls", "bucket", "mark", "found", "score", "line", "root", "__score", "part"):
                df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return make


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{k * k % 977}" for k in range(20_000))
    return [(1, None), (2, ""), (3, "   \n\t\n"), (4, "one"), (5, "one two three"), (6, long), (7, long + " end"), (8, "same text here " * 30), (8, "same text here " * 30), (9, "same text here " * 30), (None, "no id at all but some words"), (10, "ünïcödé 日本語テキスト " * 20), (11, "a\r\nb\x0bc\x00d"), (12, "x" * 5000)]
