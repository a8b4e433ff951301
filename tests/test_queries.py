"""Every registered query of the reference's operators runs on the small tables and matches its SQL."""

from __future__ import annotations

import glob
import os

import pytest
from ledgershift import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = sql.execute(plans.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 and set(entry.oracle_sql()) <= set(entry.queries())


def test_unit_errors_of_all_events(spark, tmp_path):
    """Conflicts of events that a sample by event_id would leave out are reported."""
    events = "select * from values (7, 0, 'view', timestamp '2001-01-02', 1.0), (8, 0, 'view', timestamp '2001-01-03', 2.0), (50, 1, 'view', timestamp '2001-01-04', 5.0) as t(event_id, user_id, event_type, ts, value)"
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in plans.QUERIES["unit_consistency_errors"](spark, str(tmp_path)).collect()] == [("view", "0", "2001-01-01", "conflicting_values")]


def test_period_parse_reads_names_of_months(spark, tmp_path):
    """A month name and a year of two digits is a month, so that only full dates have no period."""
    spark.sql("select * from values (3L, timestamp '1997-05-09'), (4L, timestamp '1997-05-09'), (9L, timestamp '1998-12-31') as t(o_orderkey, o_orderdate)").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["period_parse"](spark, str(tmp_path)).collect())
    assert got == [(3, "none", "none"), (4, "month", "2097-05-01"), (9, "month", "2098-12-01")]
