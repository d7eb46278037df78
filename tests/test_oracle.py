"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.compare import differences, oracle_connection

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_every_query_has_sql():
    """But for those of the training-data operators, whose own tests check what SQL cannot state."""
    own = {*contract.llm.queries(), "pipeline"} if contract.llm else set()
    assert set(contract.queries()) - own == set(contract.oracle_sql()) - own


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    assert differences(contract.queries()[name](spark, SF_DIR), oracle, contract.oracle_sql()[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_line_ids_are_unique(spark, sf):
    from millrace.sources.samples import line_id
    from millrace.sources.tables import table

    lines = table(spark, f"/root/testdata/{sf}", "lineitem")
    assert lines.select(line_id().alias("id")).distinct().count() == lines.count()
