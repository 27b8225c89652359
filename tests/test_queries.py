"""Every core query against its SQL on the smallest tables, where those and DuckDB are at hand."""

import decimal
import math
import os

import pytest

from slidelake.plans import catalogue

DATA = os.environ.get("SLIDELAKE_TESTDATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(float(v))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cursor = db.execute(catalogue.ORACLE[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_data_queries_run(spark):
    counts = {n: catalogue.QUERIES[n](spark, DATA).count() for n in ("p1_found", "p2_found", "p3_found", "p3_table", "p5_found")}
    assert all(counts.values())


def test_no_cartesian_product_and_pushed_filter(spark):
    plan = catalogue.QUERIES["tile_inside"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = catalogue.QUERIES["barcode_base64"](spark, DATA)._jdf.queryExecution().toString()
    assert "EqualTo(attr_name,PIM_DP_UFS_BARCODE)" in plan
