"""Every registered query of the library against its SQL in DuckDB, and those without SQL for shape."""

from __future__ import annotations

import math
import os

import pandas as pd
import pytest

from millrace.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).tz_localize(None).isoformat()
    if hasattr(x, "item"):
        return _norm(x.item())
    return x


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(_norm(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck(registry.ORACLE_SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns
