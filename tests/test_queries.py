"""Registered queries against DuckDB on the smallest data folder.

A quick part runs by default; CHECK_ALL=1 runs every query (or use tools/check.py).
"""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import rows

SF_DIR = "/root/testdata/sf0.001"
QUICK = """image_scan pixel_scan metadata_scan non_composite leg_attach grand_total hsv_convert homogeneity unsharp clahe
morph_close region_fill gabriel_edges spearman map_at_50 uncertainty_topk label_sync_stream""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUICK) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()) if os.environ.get("CHECK_ALL") else QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = contract.queries()[name](spark, SF_DIR)
    cur = con.execute(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 11
