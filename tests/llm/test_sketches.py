import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import distinct, heavy, seen

READS = "read_id bigint, bases string, value string, h bigint, n int, slot int, key bigint"


def reads(spark, rows):
    return spark.createDataFrame([(r, b, "v", 1, 2, 3, 4) for r, b in rows], READS)


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    values = ["hot"] * 3000 + [f" warm{i % 7} " for i in range(1400)] + ["ACGU", "acgt"] * 30 + [None, "", " ", "*"] * 20
    values += [f"rare{rng.randrange(10**9)}" for _ in range(4500)] + ["L" * 50_000] * 60
    rng.shuffle(values)
    return list(enumerate(values))


def brute_frequent(rows, support):
    n, ids = Counter(), {}
    for r, b in rows:
        if r is not None:
            ids[r] = b
    for b in ids.values():
        t = (b or "").strip().upper().replace("U", "T")
        if t not in ("", "*"):
            n[t] += 1
    return {k: v for k, v in n.items() if v >= support * len(ids)}


@pytest.mark.parametrize("buckets,cells", [(4096, 1 << 16), (2, 4), (1, 1)])
def test_frequent(spark, skewed, buckets, cells):
    rows = skewed + skewed[:500] + [(None, "hot")]
    got = heavy.frequent(reads(spark, rows).repartition(5), 0.005, buckets, cells).collect()
    assert {r.bases: r.n for r in got} == brute_frequent(rows, 0.005)
    assert all(r.estimate >= r.n for r in got)


def test_frequent_ties_and_empty(spark):
    rows = [(i, "AB"[i % 2]) for i in range(10)]
    assert sorted(r.bases for r in heavy.p6_found(reads(spark, rows), 0.5).collect()) == ["A", "B"]
    assert heavy.p6_found(reads(spark, [])).collect() == []
    assert heavy.p6_found(reads(spark, [(1, None)])).collect() == []


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    data = rng.zipf(1.3, 20_000).astype(np.int64) * 0x5DEECE66D
    s = heavy.HeavyLight(16, 64, 8)
    for part in np.array_split(data, 13):
        s.add(part)
    true = Counter(data.tolist())
    held = dict(zip(s.key[s.votes > 0].tolist(), s.votes[s.votes > 0].tolist()))
    assert s.votes.sum() + s.cells.sum() == len(data) == s.rows
    assert all(held.get(k, 0) + s.cells[k & s.cell_mask] >= v for k, v in true.items())


ARRIVALS = "arrival_no bigint, name string, h bigint, open boolean, target bigint, f int"


def arrivals(spark, rows):
    return spark.createDataFrame([(n, k, 1, True, 2, 3) for n, k in rows], ARRIVALS)


def brute_seen(rows):
    first, out = {}, set()
    for n, name in sorted({(n, k) for n, k in rows if k is not None and n is not None}):
        k = name.strip()
        k = k[1:] if k.startswith("@") else k
        if k.strip():
            if k in first and first[k] != n:
                out.add(n)
            first.setdefault(k, n)
    return out


ARRIVAL_POOL = [f"read{i}" for i in range(400)] + ["@x", " @x", "@@x", "x", "X", " ", "", "@", "@ ", None, "é", "　y", "y", "L" * 20_000]


def some_arrivals(seed, n=1500):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.35 else rng.choice(ARRIVAL_POOL)) for i in range(1, n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_seen_before(spark, ranges):
    rows = some_arrivals(2)
    df = arrivals(spark, rows + rows[:30]).repartition(6)
    got = [r.arrival_no for r in seen.seen_before(df, ranges=ranges).select("arrival_no").distinct().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_seen(rows)
    assert {r.arrival_no for r in seen.p5_found(df).collect()} == brute_seen(rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_stored_filters_answer_later_arrivals(spark, parts):
    rows = some_arrivals(4)
    got = [r.arrival_no for r in seen.incremental(arrivals(spark, rows + rows[:30]).repartition(5), parts).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_seen(rows)


def test_merged_filters_hold_all_keys(spark):
    rows = some_arrivals(5)
    a, b = arrivals(spark, rows[:900]), arrivals(spark, rows[500:])
    both = seen.merged(seen.filters(a, 4).unionByName(seen.filters(b, 4))).collect()
    whole = seen.filters(arrivals(spark, rows), 4).collect()
    load = lambda r: seen.QuotientFilter.load(r.bits, r.n, r.quotient_bits, bytes(r.occupied), bytes(r.starts), bytes(r.remainders)).fingerprints().tolist()
    assert {r.range: load(r) for r in both} == {r.range: load(r) for r in whole}
    r = seen.filter_sizes(arrivals(spark, rows)).first()
    assert r.n_keys == len({k for k in (None if n is None else n.strip().removeprefix("@").strip() and n.strip().removeprefix("@") for _, n in rows) if k})


def test_answers_come_from_lookups_in_several_filters(monkeypatch):
    rng = np.random.default_rng(9)
    h = rng.integers(-(2**63), 2**63, 6000)
    h[3000:] = h[rng.integers(0, 6000, 3000)]
    asked, levels = 0, 0
    real = seen.QuotientFilter.contains

    def counted(self, f):
        nonlocal asked
        asked += len(f)
        return real(self, f)

    monkeypatch.setattr(seen.QuotientFilter, "contains", counted)
    add = seen.Held.add

    def watched(self, new):
        nonlocal levels
        add(self, new)
        levels = max(levels, len(self.levels))

    monkeypatch.setattr(seen.Held, "add", watched)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(6000, np.int32)), pa.array(np.arange(6000)), pa.array(h), pa.array(np.ones(6000, np.int32)), pa.nulls(6000)], names=["range", "arrival_no", "h", "state", "filter"])
    got = [x for b in seen._filter((64,), 0, False)(iter([batch])) for x in b.column(0).to_pylist()]
    first, want = {}, set()
    for i, x in enumerate(h.tolist()):
        if x in first:
            want.add(i)
        first.setdefault(x, i)
    assert set(got) == want and asked > 3000 and levels >= 2


def test_seen_empty(spark):
    assert seen.p5_found(arrivals(spark, [])).collect() == []
    assert seen.error_report(arrivals(spark, [])).collect() == []


@pytest.mark.parametrize("bits,quotient_bits", [(64, None), (64, 16), (40, 8), (24, None), (33, 4), (13, None)])
def test_quotient_filter(bits, quotient_bits):
    rng = np.random.default_rng(bits)
    f = np.unique(rng.integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - bits))
    q = seen.QuotientFilter(f, bits, quotient_bits)
    assert (q.fingerprints() == f).all() and q.contains(f).all()
    other = np.concatenate([f + np.uint64(1), f - np.uint64(1), rng.integers(0, 2**62, 5000, dtype=np.int64).astype(np.uint64) >> np.uint64(64 - bits)]) & np.uint64(2**bits - 1)
    assert (q.contains(other) == np.isin(other, f)).all()
    again = seen.QuotientFilter.load(*q.row())
    assert (again.contains(other) == np.isin(other, f)).all() and (again.fingerprints() == f).all()
    a, b = seen.QuotientFilter(f[::2], bits, quotient_bits), seen.QuotientFilter(f[1::3], bits, quotient_bits)
    assert (a.merge(b).fingerprints() == np.union1d(f[::2], f[1::3])).all()


def test_small_quotient_filters():
    for held in ([], [5], [0, 2**64 - 1]):
        q = seen.QuotientFilter(np.array(held, np.uint64))
        assert q.contains(np.array([0, 5, 6, 2**64 - 1], np.uint64)).tolist() == [x in held for x in (0, 5, 6, 2**64 - 1)]
        assert q.fingerprints().tolist() == held
    # memory: the remainder and about four bits of a key
    f = np.unique(np.random.default_rng(1).integers(0, 2**63, 1 << 16, dtype=np.int64).astype(np.uint64))
    assert seen.QuotientFilter(f).nbytes / len(f) < 6.6


def test_error_rates(spark):
    rows = [(i, f"k{i % 9000}") for i in range(1, 20_001)]
    got = {r.bits: r for r in seen.error_report(arrivals(spark, rows), (16, 24, 64)).collect()}
    assert got[64].wrong == 0 and got[64].n_keys == 9000 and got[64].n_arrivals == 20_000
    d, m = got[16].derived_rate * 20_000, got[16].wrong
    assert abs(d - m) < 5 * math.sqrt(d)  # measured within five standard errors of the derived rate
    found = set(r.arrival_no for r in seen.seen_before(arrivals(spark, rows), (24,)).collect())
    assert brute_seen(rows) <= found and len(found) - len(brute_seen(rows)) == got[24].wrong


SEQ = "read_id bigint, file_id bigint, name string, bases string, sequenced_at timestamp, day date, kind string, word int, bits bigint"
MAN = "file_id bigint, run_accession string, center string, platform string, day string, kind string"


def test_distinct_counts(spark):
    rng = random.Random(4)
    day = [datetime(2025, 1, d, 12) for d in (1, 2)] + [None]
    files = {1: ("r1", " lab ", "P"), 2: ("r1", "LAB", "P"), 3: ("r2", None, "Q")}
    rows = []
    for i in range(6000):
        f = 1 if rng.random() < 0.5 else rng.choice([2, 3])
        rows.append((i, f, rng.choice([f"n{rng.randrange(3000)}", f"@n{rng.randrange(3000)} ", None, " ", "*"]), rng.choice([f"acgu{rng.randrange(50)}", f"ACGT{rng.randrange(50)}", None]), rng.choice(day)))
    df = spark.createDataFrame([(*r, None, "k", 1, 1) for r in rows + rows[:100]], SEQ)
    man = spark.createDataFrame([(k, *v, "x", "y") for k, v in files.items()], MAN)
    true = {}
    for _, f, name, b, at in rows:
        run, center, platform = files[f]
        values = {"day": at and at.date(), "file_id": f, "run_accession": run, "center": center and center.strip().upper(), "platform": platform}
        n = (name or "").strip().removeprefix("@")
        t = (b or "").strip().upper().replace("U", "T")
        for s in distinct.SETS:
            g = true.setdefault((",".join(s), *(values[c] if c in s else None for c in ("day", "center", "platform", "run_accession", "file_id"))), (set(), set()))
            if n not in ("", "*"):
                g[0].add(n)
            if t not in ("", "*"):
                g[1].add(t)
    got = {(r.grouping, r.day, r.center, r.platform, r.run_accession, r.file_id): r for r in distinct.distinct_counts(df, man).collect()}
    assert set(got) == set(true)
    for k, r in got.items():
        for value, error, exact in ((r.distinct_names, r.names_error, len(true[k][0])), (r.distinct_bases, r.bases_error, len(true[k][1]))):
            assert error <= distinct.TARGET_ERROR
            assert abs(value - exact) <= max(1.5, 5 * error * exact)


def test_distinct_every_combination(spark):
    columns = ("day", "center", "platform", "run_accession", "file_id")
    files = {1: ("r1", "A", "P"), 2: ("r1", None, "P"), 3: ("r1", " a", "Q"), 4: ("r2", "B", "P")}
    rows = [(i, 1 + i % 4, f"n{i}", f"ACGT{i}", datetime(2025, 1, 1 + i % 3), None, "k", 1, 1) for i in range(24)] + [(24, None, "n24", "A", None, None, "k", 1, 1)]
    man = spark.createDataFrame([(k, *v, "x", "y") for k, v in files.items()], MAN)
    got = {(r.grouping, *(r[c] for c in columns)): round(r.distinct_names) for r in distinct.distinct_counts(spark.createDataFrame(rows, SEQ), man).collect()}
    want = {}
    for _, f, _, _, at, *_ in rows:
        run, center, platform = files.get(f, (None, None, None))
        v = {"day": at and at.date(), "center": center and center.strip().upper(), "platform": platform, "run_accession": run, "file_id": f}
        for k in range(32):
            s = [c for j, c in enumerate(columns) if k >> j & 1]
            g = (",".join(s), *(v[c] if c in s else None for c in columns))
            want[g] = want.get(g, 0) + 1
    assert got == want and got["center,run_accession", None, "A", None, "r1", None] == 12


def test_distinct_parts_merge_and_sizes(spark):
    df = spark.range(20_000).selectExpr("cast(id % 2 as int) as half", "concat('x', id % 12000) as v")
    lm = distinct.bitmap_bits(20_000).bit_length() - 1
    made = lambda rows, size: distinct.partials(rows, [("1L", str(size), False)], {"v": "v"})
    halves = [made(df.where(f"half = {h}"), lm + h).drop("base") for h in (0, 1)]  # unlike sizes fold to the smaller
    a, b = (distinct.estimates(p).first() for p in (distinct.merged(halves[0].unionByName(halves[1])), made(df, lm)))
    assert a == b and a.lm == lm and abs(a.estimate - 12_000) < 12_000 * 5 * distinct.TARGET_ERROR
    for n in (1, 100, 10**6, 10**9):
        m = distinct.bitmap_bits(n)
        assert distinct.standard_error(n, m) <= distinct.TARGET_ERROR or n == 1
    assert distinct.bitmap_bits(0) == 64


def test_bitmap_sizes_follow_the_groups(spark):
    ns = [0, 1, 5, 1000, 4300, 17_000, 10**6, 10**9]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n bigint").selectExpr(distinct.log_size_sql("n")).collect()]
    assert [1 << x for x in got] == [distinct.bitmap_bits(n) for n in ns]
    rows = [(i, 1 if i < 20_000 else 2, f"n{i}", "A", datetime(2025, 1, 1), None, "k", 1, 1) for i in range(20_100)]
    man = spark.createDataFrame([(1, "r1", "A", "P", "x", "y"), (2, "r2", "B", "P", "x", "y")], MAN)
    got = {(r.grouping, r.file_id): r for r in distinct.distinct_counts(spark.createDataFrame(rows, SEQ), man).collect() if r.grouping in ("", "file_id")}
    assert got["file_id", 2].bitmap_bits == distinct.bitmap_bits(100) < got["file_id", 1].bitmap_bits == distinct.bitmap_bits(20_000)
    assert abs(got["file_id", 2].distinct_names - 100) <= 5 * 100 * distinct.TARGET_ERROR
    assert all(r.names_within and r.bases_within for r in distinct.accuracy(spark.createDataFrame(rows, SEQ), man).collect())


def test_distinct_empty(spark):
    assert distinct.distinct_counts(spark.createDataFrame([], SEQ), spark.createDataFrame([], MAN)).collect() == []
