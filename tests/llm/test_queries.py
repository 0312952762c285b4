import math
import os

import duckdb
import pytest

from readloom.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def counts(rows, duck):
    """The exact counts behind the estimates are those of ``p2_accuracy``; here: all sets, groups once, sizes and errors."""
    assert len({r.grouping for r in rows}) == 32 and len({r[:6] for r in rows}) == len(rows)
    assert all(r.names_error <= 0.011 and r.bases_error <= 0.011 and r.bitmap_bits & (r.bitmap_bits - 1) == 0 for r in rows)


def error_rates(rows, duck):
    n, keys = duck.sql("select count(*), count(distinct key) from (" + ORACLE["p5_found"].split("select arrival_no from (")[0] + "select key from k where length(trim(key)) > 0)").fetchall()[0]
    for r in rows:
        assert (r.n_arrivals, r.n_keys) == (n, keys) and r.wrong >= 0 and math.isclose(r.measured_rate, r.wrong / n)
        assert abs(r.wrong - r.derived_rate * n) <= 5 * math.sqrt(r.derived_rate * n) + 1
    assert {r.bits for r in rows} == {24, 32, 40, 48, 64}


def filter_sizes(rows, duck):
    (r,) = rows
    assert r.n_keys == duck.sql("select count(distinct key) from (" + ORACLE["p5_found"].split("select arrival_no from (")[0] + "select key from k where length(trim(key)) > 0)").fetchall()[0][0]
    assert r.bits_a_key < 80


def frequent(rows, duck):
    exact = dict(duck.sql(ORACLE["p6_found"].replace("select bases from v", "select bases, count(distinct read_id) from v")).fetchall())
    assert {r.bases: r.n for r in rows} == exact and all(r.estimate >= r.n for r in rows)


def selection(rows, duck):
    shares = {}
    for r in rows:
        shares[r.source] = shares.get(r.source, 0) + r.copies * r.tokens
    most = {s.strip().lower(): (t, m) for s, t, m in duck.sql("select source, target_share, max_repeats from mix_targets").fetchall()}
    size = max(r.tokens for r in rows)
    for s, n in shares.items():
        assert abs(n - most[s][0] * sum(shares.values())) <= 2 * size * len(shares)
    assert all(r.copies <= most[r.source][1] for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def shares(rows, duck):
    assert {r.source for r in rows} == {s.strip().lower() for (s,) in duck.sql("select source from mix_targets").fetchall()}
    assert abs(sum(r.reached_share for r in rows) - 1) < 1e-9 and all(r.most_copies <= r.max_repeats for r in rows)


def levels(rows, duck):
    """Against the labels of the careful annotators; the texts themselves are held out in ``test_texts``."""
    assert rows and len({r.doc_id for r in rows}) == len(rows)


PROPERTIES = {
    "p2_distinct_counts": counts, "p5_error_rates": error_rates, "p5_filter_sizes": filter_sizes, "p6_counts": frequent, "p8_selection": selection, "p8_shares": shares, "p9_found": levels, "p9_levels": levels,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns, collected = sorted(df.columns), df.collect()
    if name not in ORACLE:
        PROPERTIES[name](collected, duck)
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr) == sorted((tuple(r[c] for c in columns) for r in collected), key=repr)


def test_every_query_is_tested():
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) - set(ORACLE) == set(PROPERTIES)
