import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables aren't here")


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) & set(driver.registry.SQL)))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    out = driver.queries()[name](spark, DATA)
    want = con.sql(driver.oracle_sql()[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out.columns, [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in out.collect()]) == rows(want.columns, [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want.fetchall()])
    spark.catalog.clearCache()


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
