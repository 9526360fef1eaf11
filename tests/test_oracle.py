"""Registered queries against their SQL on DuckDB, on the smallest data folder.

The slow ones run only with ``ORACLE_ALL=1``.
"""

import os
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = f"{oracle.DATA}/sf0.001"
SLOW = ("crawl_", "reachable", "stream_", "search_", "shared_", "anchored", "admission", "circuit",
        "save_", "table_counts", "metric_rows", "retain", "term_stats", "build_index")
NAMES = [n for n in entry.queries() if os.environ.get("ORACLE_ALL") or not n.startswith(SLOW)]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test data is not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    good, note, _ = oracle.compare(
        spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR
    )
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
