"""Every query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.queries import history_q, pipeline_q, rules_q
from quern.queries.views import TABLES

ALL = {n: (r.queries[n], sql) for r in (pipeline_q.R, history_q.R, rules_q.R) for n, sql in r.oracles.items()}


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_numeric_dtype(frame[c]) and not pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = pd.to_numeric(frame[c]).astype(float).round(6)
        frame[c] = frame[c].map(lambda x: "null" if x is None or x is pd.NA or str(x) == "NaT" or (isinstance(x, float) and np.isnan(x)) else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ALL))
def test_same_rows(spark, duck, sf, name):
    query, sql = ALL[name]
    got, want = normal(query(spark, sf).toPandas()), normal(duck.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)
