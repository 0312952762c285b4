import random

import pytest

from readloom.llm.neardup import coverage, p1_found, p1_groups

SCHEMA = "record_id bigint, bases string, id bigint, token string, text string, df int, a int, b int, rep int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(r, b, 1, "t", "x", 1, 2, 3, 4, 5) for r, b in rows], SCHEMA)


def seq(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def brute(rows):
    norm = {}
    for r, b in rows:
        if b is not None and r is not None:
            t = b.strip().upper().replace("U", "T")
            if len(t) >= 16:
                norm[r] = t
    ids = sorted(norm)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if coverage(norm[a], norm[b]) >= 0.8 and coverage(norm[b], norm[a]) >= 0.8}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out, n = [], 0
    adapter = seq(rng, 30)

    def add(b):
        nonlocal n
        n += 1
        out.append((n, b))

    for _ in range(25):
        base = seq(rng, rng.randint(40, 300))
        add(adapter + base)
        for _ in range(rng.randint(0, 3)):
            b = list(base)
            for _ in range(rng.randint(0, 1 + len(b) // 40)):
                b[rng.randrange(len(b))] = rng.choice("ACGT")
            if rng.random() < 0.5:
                cut = rng.randrange(len(b))
                b = b[cut:] + b[:cut]
            if rng.random() < 0.4:
                cut = rng.randrange(len(b))
                b[cut:cut] = seq(rng, 8)
            add("".join(b) if rng.random() < 0.7 else "".join(b).lower().replace("t", "u"))
    twin = seq(rng, 100)
    for _ in range(3):
        add(twin)
    add(adapter * 3)  # hot tokens only
    add(adapter * 3 + "A")
    for b in (None, "", "*", " ", "ACGT", "A" * 15, "A" * 16, "A" * 16, "A" * 500, "A" * 600, "acgu" * 2000, "ACGT" * 2000 + "C"):
        add(b)
    add(out[0][1])
    return out + out[:2]  # two rows delivered again


@pytest.mark.parametrize("hot", [256, 3])
def test_against_brute_force(spark, rows, hot):
    got = [tuple(r) for r in p1_found(frame(spark, rows), hot=hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_large_groups_of_copies(spark):
    rng = random.Random(1)
    base = seq(rng, 120)
    rows = [(i, base) for i in range(1, 101)] + [(200, base[:118] + "TT"), (201, seq(rng, 100))]
    got = {tuple(r) for r in p1_found(frame(spark, rows), expand=10).collect()}
    assert got == {(1, i) for i in range(2, 101)} | {(1, 200)}


def test_groups(spark, rows):
    pairs = brute(rows)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted(pairs):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.record_id: r.group_id for r in p1_groups(frame(spark, rows)).collect()}
    assert all(got[x] == find(x) for x in got)
    assert {x for p in pairs for x in p} <= set(got)


def test_empty(spark):
    assert p1_found(frame(spark, [])).collect() == []
    assert p1_groups(frame(spark, [(1, None)])).collect() == []


def test_runs_over_batches():
    """Counting of sorted postings cut anywhere into batches, against plain counting."""
    import pyarrow as pa

    from readloom.llm import neardup as N

    rng = random.Random(0)
    for _ in range(200):
        hot, rows = rng.choice([2, 5]), []
        for t in range(rng.randint(1, 12)):
            kinds = [N.PLAIN] * rng.choice([1, 1, 2, 3, hot, hot + 1, hot + 2, 20]) + [N.KNOWN] * rng.choice([0, 0, 0, 3]) + [N.MARK] * rng.choice([0, 0, 0, 1])
            mine = [(t, rng.randrange(1000), -1 if k == N.MARK else (i << 32) | 50 | (N._KNOWN if k == N.KNOWN else 0), k) for i, k in enumerate(kinds)]
            rows += sorted(mine, key=lambda r: r[2])
        want = []
        for t in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == t]
            real = [r for r in own if r[3] != N.MARK]
            is_hot = any(r[3] for r in own) or len(real) > hot
            if is_hot or len(real) > 1:
                want += [(t, r[1], (r[2] & (N._KNOWN - 1)) >> 32, 50, hot + 1 if is_hot else len(real)) for r in real]
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(0, 8)))) if len(rows) > 1 else []
        batches = []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            c = list(zip(*rows[a:b]))
            batches.append(pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())], names=["token", "id", "at"]))
        got = [tuple(x.values()) for o in N._shared(hot)(iter(batches)) for x in o.to_pylist()]
        assert sorted(got) == sorted(want)


def test_known_hot_tokens_are_marked(monkeypatch):
    """A token that floods a partition: one mark, its later rows are known, the earlier ones plain."""
    import pyarrow as pa

    from readloom.llm import neardup as N

    monkeypatch.setattr(N, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(["ACGTACGTACGTACGT"] * 60)], names=["id", "text"])
    rows = [x for o in N._explode(16, 1, 25)(iter([batch])) for x in o.to_pylist()]
    kinds = [N.MARK if r["at"] < 0 else N.KNOWN if r["at"] >= N._KNOWN else N.PLAIN for r in rows]
    assert len({r["token"] for r in rows}) == 1
    assert (kinds.count(N.MARK), kinds.count(N.PLAIN), kinds.count(N.KNOWN)) == (1, 30, 30)


@pytest.mark.parametrize("window", [1, 2, 3, 7])
def test_shared_stretches_share_minimisers(window):
    """Every 16 letters that two texts share give both the same token, wherever they stand; none reaches over a text's end."""
    import numpy as np

    from readloom.llm import neardup as N

    rng = random.Random(window)
    core = seq(rng, 40)
    texts = [core, seq(rng, 17) + core + seq(rng, 5), seq(rng, 16), "A" * 30, core[3:19], seq(rng, 3) + core[10:30]]
    sizes = np.array([len(t) for t in texts])
    codes = N.kmer_codes(np.frombuffer("".join(texts).encode(), np.uint8), 17 - window)
    owner, place = N.minimisers(codes, np.cumsum(sizes) - sizes, sizes - 15, window)
    token = [texts[o][p : p + 17 - window] for o, p in zip(owner.tolist(), place.tolist())]
    assert all(len(t) == 17 - window for t in token)
    of = [{p: t for o, p, t in zip(owner.tolist(), place.tolist(), token) if o == i} for i in range(len(texts))]
    taken = lambda i, begin: {p - begin for p in of[i] if begin <= p < begin + window}
    for k in range(25):
        windows = [(i, t.find(core[k : k + 16])) for i, t in enumerate(texts)]
        sets = [taken(i, at) for i, at in windows if at >= 0]
        assert set.intersection(*sets)
    assert window == 1 or len(of[1]) < len(texts[1]) - 15


@pytest.mark.parametrize("window", [1, 5])
def test_other_windows(spark, rows, window):
    from readloom.llm.neardup import alike_texts, sequences

    texts = sequences(frame(spark, rows)).groupBy("text").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    held = {r.id for r in texts.collect()}
    got = {tuple(r) for r in alike_texts(texts, hot=4, window=window).collect()}
    assert got == {p for p in brute(rows) if set(p) <= held}


@pytest.mark.parametrize("n, every", [(84, 17), (150, 17)])
def test_tokens_left_out_by_the_partner(spark, n, every):
    rng = random.Random(3)
    rows = []
    for i in range(0, 30, 3):
        a = seq(rng, n)
        b = "".join(next(y for y in "ACGT" if y != x) if j % every == every - 1 else x for j, x in enumerate(a))
        rows += [(i, a), (i + 1, b), (i + 2, seq(rng, n) + a + seq(rng, n))]
    want = brute(rows)
    assert want == {(i, i + 1) for i in range(0, 30, 3)}
    assert {tuple(r) for r in p1_found(frame(spark, rows)).collect()} == want
    groups = {r.record_id: r.group_id for r in p1_groups(frame(spark, rows)).collect()}
    assert all(groups[i] == groups[i + 1] == i and groups[i + 2] == i + 2 for i in range(0, 30, 3))
