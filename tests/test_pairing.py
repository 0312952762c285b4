from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from readloom.operators import normalise, pairing

SCHEMA = "file_no int, read_no bigint, name string, bases string, quals string, forward string, number string, read_key string, n_reads int"


def frame(spark, rows):
    """rows: (file_no, read_no, name, bases); columns with clashing names beside them."""
    return spark.createDataFrame([(*r, "I" * len(r[3] or ""), "x", "y", "z", 0) for r in rows], SCHEMA)


def by_hand(rows):
    from re import fullmatch

    groups = defaultdict(list)
    for f, n, name, b in rows:
        if name is not None:
            m = fullmatch(r"(.*)[.|:/_]([0-9]+)", name)
            groups[m.group(1) if m else name].append((int(m.group(2)) if m else f, f, n, name, b))
    out = {}
    for key, reads in groups.items():
        reads.sort()
        low, high = reads[0], [r for r in reads if r[0] == reads[-1][0]][0]
        out[key] = (low[3], high[3] if high[0] > low[0] else None, len(reads))
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from(["a", "b", "c", "d", None]), st.sampled_from(["", "/1", "/2", ".1", "/10"]), st.sampled_from(["ACGT", "", None, "A" * 3000])), max_size=14))
def test_assembly_against_brute_force(spark, picks):
    rows = [(f, i, None if k is None else k + s, b) for i, (f, k, s, b) in enumerate(picks, 1)]
    got = {r.read_key: (r.forward.name, r.reverse.name if r.reverse else None, r.n_reads) for r in pairing.assemble(frame(spark, rows)).collect()}
    assert got == by_hand(rows)


def test_partitions_do_not_matter(spark):
    rows = [(1 + i % 2, i, f"k{i // 2}/{1 + i % 2}", "ACGT") for i in range(201)]
    one, many = frame(spark, rows).coalesce(1), frame(spark, rows[::-1]).repartition(7)
    assert sorted(map(str, pairing.assemble(one).collect())) == sorted(map(str, pairing.assemble(many).collect()))
    assert len(list(pairing.iterate(pairing.assemble(many)))) == 100 and len(list(pairing.iterate(pairing.assemble(many), True))) == 101
    c = pairing.pair_counts(pairing.assemble(many)).first()
    assert (c.n_pairs, c.n_orphans, c.n_reads, c.n_bases) == (100, 1, 201, 804)


def test_hot_key_and_slots(spark):
    rows = [(1, i, "hot/1", "A") for i in range(300)] + [(2, 1, "hot/2", "C"), (2, 2, "hot/3", "C"), (1, 1000, "x/1", "G")]
    df = frame(spark, rows)
    assert [(r.read_key, r.number, r.n) for r in pairing.duplicate_slots(df).collect()] == [("hot", 1, 300)]
    assert [r.n_numbers for r in pairing.unexpected_numbers(df).collect()] == [3]
    assert {r.read_key: r.n_reads for r in pairing.assemble(df).collect()} == {"hot": 302, "x": 1}


def test_bad_names(spark):
    df = frame(spark, [(1, 1, "plain", "A"), (2, 1, "plain", "C"), (1, 2, None, "A")])
    a = pairing.assemble(df).collect()
    assert len(a) == 1 and a[0].forward.bases == "A" and a[0].reverse.bases == "C"
    assert pairing.assemble(df, on_bad_name="drop").collect() == []
    with pytest.raises(Exception, match="INVALID_READ_NAME"):
        pairing.assemble(df, on_bad_name="error").collect()


def test_empty(spark):
    df = frame(spark, [])
    assert pairing.assemble(df).collect() == []
    assert tuple(pairing.pair_counts(pairing.assemble(df)).first()) == (0, 0, 0, 0)
    assert pairing.numbered(df.select("name"), ["name"]).collect() == []


def test_normalised_names_and_counter(spark):
    rows = [(1, 1, "M/1", "ACGU"), (2, 1, "M/2", "ACGT"), (1, 2, "LEFT_ONLY/10", "A"), (2, 2, "RIGHT_ONLY/20", "C"), (1, 3, "cas:1 1:N:0:AC", "A"), (2, 3, "cas:1 2:N:0:AC", "A")]
    out = normalise.normalise_paired(frame(spark, rows), prefix="E").collect()
    assert {(r.counter, r.slot, r.output_name) for r in out} == {
        (1, 0, "E.1 LEFT_ONLY/10"), (2, 1, "E.2 M/1"), (2, 2, "E.2 M/2"), (3, 0, "E.3 RIGHT_ONLY/20"), (4, 1, "E.4 cas:1 1:N:0:AC"), (4, 2, "E.4 cas:1 2:N:0:AC"),
    }


def test_counter_is_total(spark):
    rows = [(1, i, f"k{i:05d}", "A") for i in range(1000)]
    got = pairing.numbered(frame(spark, rows).repartition(9).select("name"), ["name"]).collect()
    assert sorted((r.counter, r.name) for r in got) == [(i + 1, f"k{i:05d}") for i in range(1000)]


def test_interleave(spark):
    rows = [(1, i, "a", "A") for i in (1, 2, 3)] + [(2, 1, "b", "C")]
    turns = lambda stop: [(r.file_no, r.read_no) for r in pairing.interleave(frame(spark, rows), (), stop).orderBy("turn").collect()]
    assert turns(False) == [(1, 1), (2, 1), (1, 2), (1, 3)]
    assert turns(True) == [(1, 1), (2, 1), (1, 2)]


def test_pair_by_name(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "record_no bigint, qname string")
    assert {r.record_no: (r.pair_no, r.slot) for r in pairing.pair_by_name(df).collect()} == {1: (0, 1), 3: (0, 2), 4: (1, 0), 2: (0, 0)}


@pytest.mark.parametrize("stretch", [2, 5])
def test_one_name_is_counted_in_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(pairing, "STRETCH", stretch)
    df = spark.createDataFrame([(i, "*" if i % 3 else None) for i in range(1, 41)], "record_no bigint, qname string").repartition(3)
    got = {r.record_no: (r.qname, r.pair_no, r.slot) for r in pairing.pair_by_name(df).collect()}
    for name in ("*", None):
        mine = sorted(n for n, g in got.items() if g[0] == name)
        alone = len(mine) % 2
        assert [got[n][1:] for n in mine] == [(k // 2, 0 if alone and k == len(mine) - 1 else k % 2 + 1) for k in range(len(mine))]
