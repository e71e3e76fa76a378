"""Every registered query runs, and equals its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from sievemill.plans import catalog


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def shown(v):
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            return f"{float(v):.6g}"
        return str(v).replace("+00:00", "")

    return sorted(tuple(shown(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def base(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, base, name):
    found = catalog.QUERIES[name](spark, sf)
    got = [tuple(r) for r in found.collect()]
    if name in catalog.ORACLES:
        r = base.execute(catalog.ORACLES[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(found.columns)
        assert rows(got, found.columns) == rows(r.fetchall(), columns)
    else:
        assert got


def test_report_document_of_large_and_small_durations(spark, sf, tmp_path):
    """Sums from 1e7 on, as larger tables have them, and single durations of any size."""
    c = duckdb.connect()
    value = "CASE event_id % 4 WHEN 0 THEN event_id * 65536.25 WHEN 1 THEN 10000000 WHEN 2 THEN 0.000244140625 ELSE 0.5 END::DOUBLE"
    c.execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.execute(catalog.ORACLES["report_document"]).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["report_document"](spark, str(tmp_path)).collect()] == want


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
