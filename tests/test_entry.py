import os

import duckdb
import pytest

import __spark_entry__ as entry
from readloom.plans.oracle import ORACLE
from readloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def repairs(rows):
    """Edits are told exactly where the structure is at fault, quotes among them where they are."""
    assert rows and {r.reason for r in rows} <= {"quoting", "columns", "name", "bases", "quals", "number", "length"}
    for r in rows:
        assert (r.quote_edits + r.delimiter_edits > 0) == (r.reason in ("quoting", "columns")) == bool(r.operations)
        assert (r.quote_edits > 0) == (r.reason == "quoting")
    return True


def generated(rows):
    assert [r.read_no for r in sorted(rows)] == list(range(1, 1001)) and len({r.bases for r in rows}) == 1000
    assert all(len(r.bases) == len(r.quals) == 50 and set(r.bases) <= set("ACGT") and all(2 <= ord(c) - 33 <= 40 for c in r.quals) for r in rows)
    return True


#: What holds of the results that SQL can't give.
PROPERTIES = {"p4_repairs": repairs, "generated_reads": generated}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    collected = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert PROPERTIES[name](collected)
        return
    rows = sorted((tuple(r[c] for c in columns) for r in collected), key=repr)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr) == rows


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE) == set(PROPERTIES)
