import pytest

from readloom.operators import validate as V

SCHEMA = "file_id bigint, read_no bigint, name string, bases string, quals string, style string, error string, rule string, n int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "e", "r", 1, "k") for r in rows], SCHEMA).drop("style", "key")


def manifest(spark, runs):
    return spark.createDataFrame([(f, r, False, "x") for f, r in runs], "file_id bigint, run_accession string, quick boolean, extra string")


@pytest.mark.parametrize(
    "name,bases,quals,want",
    [
        ("n", "ACGT", "IIII", None), ("n", "", "I", V.EMPTY_READ), ("n", None, "I", V.EMPTY_READ), ("n", "A", " ", V.EMPTY_QUALITY), ("n", "A", None, V.EMPTY_QUALITY), ("n", "AC", "I", V.LENGTH_MISMATCH),
        ("x" * 257, "A", "I", V.NAME_LENGTH), (" " + "x" * 256, "A", "I", None), ("n", "AX", "II", V.NOT_IUPAC), ("n", "acgtn", "IIIII", None), ("n", "*", "I", V.NOT_IUPAC), ("n", "NNN", "III", V.NOT_AUTCG),
        ("n", "NNA", "III", V.NOT_AUTCG), ("n", "NA", "II", None), (None, "A", "I", None),
    ],
)
def test_content(spark, name, bases, quals, want):
    r = V.insdc_report(frame(spark, [(1, 1, name, bases, quals)])).first()
    assert r.error == want


def test_sam_star(spark):
    rows = frame(spark, [(1, 1, "n", "*", "*"), (2, 1, "n", "ACGT", "*")])
    assert {r.file_id: r.error for r in V.insdc_report(rows, is_sam=True).collect()} == {1: V.EMPTY_READ, 2: V.EMPTY_QUALITY}


def test_first_error_and_limit(spark):
    rows = frame(spark, [(1, 3, "c", "X", "I"), (1, 2, "b", "AC", "I"), (1, 1, "a", "A", "I")])
    r = V.insdc_report(rows).first()
    assert (r.error, r.read_name, r.read_index, r.n_reads) == (V.LENGTH_MISMATCH, "b", 2, 3)
    assert V.insdc_report(rows, limit=1).first().error is None


def test_low_quality_is_opt_in(spark):
    rows = frame(spark, [(1, 1, "a", "A", "!"), (1, 2, "b", "A", "!"), (1, 3, "c", "A", "I")])
    assert V.insdc_report(rows).first().error is None
    assert V.insdc_report(rows, check_quality=True).first().error == V.LOW_QUALITY


def test_report(spark):
    c = "i:1:F:1:1:1:{} {}:N:0:A"
    rows = [(1, 1, c.format(1, 1), "A", "I"), (1, 2, "plain", "A", "I")]  # style broken
    rows += [(2, 1, "a", "A", "I"), (2, 2, " ", "A", "I")]  # blank name
    rows += [(3, 1, "a", "A", "é")]
    rows += [(4, 1, "a", "A", "I"), (4, 2, "a", "A", "I")]  # repeated
    rows += [(5, i, f"r{i}/1", "A", "I") for i in range(1, 7)] + [(6, i, f"r{i if i <= 2 else i + 50}/2", "A", "I") for i in range(1, 7)]  # 33 %
    rows += [(7, i, f"r{i}/1", "A", "I") for i in range(1, 7)] + [(8, i, f"r{i if i <= 1 else i + 50}/2", "A", "I") for i in range(1, 7)]  # 16.7 %
    rows += [(9, 1, "n", "A", "I"), (10, 1, "n/2", "A", "I"), (10, 2, "n/3", "A", "I")]  # three labels, two files
    m = manifest(spark, [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "e"), (7, "f"), (8, "f"), (9, "g"), (10, "g"), (11, "h")])
    got = {r.file_id: r for r in V.validate(frame(spark, rows), m).collect()}
    assert got[1].error == V.NOT_CASAVA and got[1].read_index == 2
    assert got[2].error == V.BLANK_NAME and got[3].error == V.BAD_QUALITY
    assert got[4].error == "Multiple occurrences of a read name" and got[4].read_name == "a"
    assert got[5].valid and got[6].valid and abs(got[5].pairing_pct - 100 / 3) < 1e-9
    assert not got[7].valid and "20%" in got[7].error
    assert got[9].n_labels == 3 and not got[9].valid
    assert got[11].error == V.NO_READS and got[11].n_reads == 0
    assert set(got) == set(range(1, 12))


def test_duplicates(spark):
    rows = [(1, i, "hot", "A", "I") for i in range(1, 30_001)] + [(1, 30_001, "x", "A", "I"), (2, 1, "hot", "A", "I"), (1, 30_002, None, "A", "I")]
    got = V.duplicate_names(frame(spark, rows)).collect()
    assert [(r.file_id, r.name, r.n) for r in got] == [(1, "hot", 30_000)] and list(got[0].places) == list(range(1, 101))
    got = {r.file_id: (r.n_added, r.n_possible_duplicates) for r in V.possible_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (30_001, 29_999), 2: (1, 0)}


def test_labels_shown(spark):
    rows = [(i, 1, f"n{i}", "A", "I") for i in range(1, 31)]
    keyed = V.pair_keys(frame(spark, rows).join(manifest(spark, [(i, "r") for i in range(1, 31)]).drop("extra"), "file_id"))
    r = V.label_counts(keyed).first()
    assert (r.n_files, r.n_labels, r.too_many) == (30, 30, False) and list(r.labels) == sorted(map(str, range(1, 31)))[:10]


def test_empty(spark):
    reads = frame(spark, [])
    assert V.insdc_report(reads).collect() == [] and V.duplicate_names(reads).collect() == []
    assert [r.error for r in V.validate(reads, manifest(spark, [(1, "a")])).collect()] == [V.NO_READS]
    assert V.validate(reads, manifest(spark, [])).collect() == []


def test_places_of_a_name_that_fills_a_file(spark, monkeypatch):
    monkeypatch.setattr(V, "STRETCHES", (3, 9, 27))
    df = spark.range(1, 201).selectExpr("1L as file_id", "id as read_no", "if(id % 5 = 0, concat('n', id), 'hot') as name").repartition(4)
    r = V.duplicate_names(df, 7).collect()
    assert len(r) == 1 and r[0].n == 160 and r[0].places == [1, 2, 3, 4, 6, 7, 8]


def test_limits_can_be_lifted(spark):
    rows = [(1, 5, "a", "AC", "II"), (1, 200_000_000, "b", "", "II")]
    df = spark.createDataFrame(rows, "file_id bigint, read_no bigint, name string, bases string, quals string")
    man = manifest(spark, [(1, "r")])
    assert V.validate(df, man).first().valid and V.validate(df, man).first().n_reads == 1
    r = V.validate(df, man, limits=None).first()
    assert (r.error, r.read_index, r.n_reads) == (V.EMPTY_READ, 200_000_000, 2)
    assert V.validate(df, man, limits=(5, 5)).first().n_reads == 1
