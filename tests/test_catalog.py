"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def normal(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(v, bool | str):
        return v
    try:
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    except (TypeError, ValueError):
        return str(v)


def test_oracles(spark):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    wrong = []
    for name in catalog.QUERIES:
        got = catalog.QUERIES[name](spark, SF).toPandas()
        if name not in catalog.ORACLES:
            continue
        want = c.sql(catalog.ORACLES[name]).df()
        columns = sorted(got.columns)
        a, b = (sorted((tuple(normal(v) for v in r) for r in x[columns].itertuples(index=False)), key=repr) for x in (got, want))
        if sorted(want.columns) != columns or a != b:
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["subset_projection"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan


def test_backward_fill_by_text_over_long_gaps(spark, tmp_path):
    """Gaps longer than a range, also among the rows without a key, and no frame left open to the last row."""
    import duckdb

    spark.range(3000).selectExpr("id AS event_id", "CASE WHEN id % 500 = 3 THEN 'view' || id WHEN id % 41 = 5 THEN NULL ELSE 'click' END AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["blank_out_backward_by_text"](spark, str(tmp_path))
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(c.sql(catalog.ORACLES["blank_out_backward_by_text"]).fetchall(), key=repr)
