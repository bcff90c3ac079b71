"""Numbered queries against their SQL."""

import os

import oracle
import pytest

from sensorloom.llm import queries, registry

SF_DIR = os.environ.get("LLM_ORACLE_SF_DIR", "/root/testdata/sf0.001")

assert queries


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = oracle.connect(SF_DIR)
    assert oracle.compare(registry.QUERIES[name](spark, SF_DIR), con, registry.ORACLES[name]) == []
