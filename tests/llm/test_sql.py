"""Queries of this subpackage against their SQL over whole tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.llm import registry
from test_queries import rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck(registry.ORACLE_SQL[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0 and rows_of(got) == rows_of(want)
