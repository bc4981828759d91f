"""Catalog queries against their SQL on the smallest tables, where those are present."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from compare import TABLES, normal  # noqa: E402

from kinweave.plans.catalog import QUERIES  # noqa: E402
from kinweave.plans.oracles import ORACLES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")
SAMPLE = ("get_impact", "impact_path", "get_supertypes", "context_topk", "record_errors", "staged_check", "debounce_batches", "sql_objects")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLES[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([c[0] for c in cursor.description], cursor.fetchall())
