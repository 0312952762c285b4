import math

import pytest

from readloom.operators.units import alias_dictionary, manifest_facts, p3_found, to_phred, weighted_distance

READS = "read_id bigint, file_id bigint, bases string, raw_quals string, unit string, scale string, f int, concept string"
MANIFEST = "file_id bigint, quality_score string, remark string, scale string, word string"


def odds(s):
    return math.floor(10 * math.log10(10 ** (s / 10) + 1) + 0.5)


def prob(p):
    return math.floor(-10 * math.log10(p) + 0.5)


FILES = [
    (1, "PHRED_33", None), (2, "PHRED_64", None), (3, "LOGODDS", None), (4, None, None), (5, None, None), (6, None, None), (7, "PHRED_64", "sample 33 of 64; scores: Sanger style, offset 33"),
    (8, "PHRED_33", "old run, odds based scores at offset 64"), (9, None, "log-odds numbers, one per base"), (10, "LOGODDS", "numeric Phred values, one per base"), (11, None, None), (12, None, "no remark; 64 samples pooled"), (13, "PHRED_33", "qualites are solexxa type"),
]
CASES = [
    (1, "ACGT", "IIII", None), (1, "ACGT", " II#I ", None), (2, "ACGT", "hhhB", 40 * 3 + 2), (2, "ACGT", " hhhB\t", 122), (3, "ACG", ";@h", odds(-5) + odds(0) + odds(40)),
    (4, "ACG", "!hh", None), (4, "A", "h", None),  # Standard by its lowest character
    (5, "ACG", ";hh", odds(-5) + 2 * odds(40)), (5, "A", "*", None), (6, "ACG", "@hh", 80), (7, "AC", "hh", None), (8, "AC", "hh", 2 * odds(40)),
    (9, "AC", "40 -5", odds(40) + odds(-5)), (10, "AC", "phred: 37,38", 75), (11, "AC", "3\t-5", odds(3) + odds(-5)), (11, "AC", "20;21", odds(20) + odds(21)), (12, "AC", "20;21", 41), (12, "A", "Q 7", 7),
    (1, "AC", "p 0.01;0.001", 50), (1, "AC", "0.01995% 0.1%", prob(0.0001995) + 30), (1, "AC", "err: 1.995e-04;1e-3", prob(1.995e-4) + 30), (1, "AC", "P(error) 0.5 0", 3), (13, "AC", "hh", 2 * odds(40)), (1, "AC", "pct 10 0 1", 30), (1, "AC", "1e-1% 1.995e-04", prob(1e-3) + prob(1.995e-6)), (2, "AC", "h\u00e9", 40 + 0xE9 - 64), (4, "AC", "20,", None),
    (1, "AC", None, None), (1, "AC", "  ", None), (1, None, "IIII", None), (99, "AC", "hh", 80), (1, "A" * 30000, "I" * 30000, None), (2, "A" * 30000, "h" * 30000, 1_200_000), (1, "ACGTA", "37,37", 74), (1, "ACGTA", "9,9;9", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f, b, q, "u", "s", 1, "c") for i, (f, b, q, _) in enumerate(CASES)]
    reads = spark.createDataFrame(rows + rows[2:4], READS)
    manifest = spark.createDataFrame([(a, b, c, "z", "z") for a, b, c in FILES], MANIFEST)
    return {r.read_id: r.phred_total for r in p3_found(reads, manifest).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_totals(found, i):
    want = CASES[i][3]
    if CASES[i][2] == "37,37":  # as long as its bases: offset-33 text
        want = None
    assert found.get(i) == want


def test_empty(spark):
    reads, manifest = spark.createDataFrame([], READS), spark.createDataFrame([], MANIFEST)
    assert p3_found(reads, manifest).collect() == []
    assert to_phred(reads, manifest).columns == ["read_id", "file_id", "unit", "phred_total", "n_values"]


def test_aliases(spark):
    words = spark.createDataFrame([("phred",), ("phread",), ("solexia",), ("probabilty",), ("qualites",), ("pooled",), ("operator",), ("p",), ("x",), ("",), ("phred",)], "w string")
    got = {r.spelling: r.concept for r in alias_dictionary(words).collect()}
    assert got == {"phred": "PHRED", "phread": "PHRED", "solexia": "LOGODDS", "probabilty": "PROB", "qualites": "QUALITY", "p": "PROB"}


def test_distance():
    assert weighted_distance("phred", "phred") == 0
    assert weighted_distance("phredd", "phred") == 0.5
    assert weighted_distance("hpred", "phred") == 1
    assert weighted_distance("", "abc") == 3


@pytest.mark.parametrize(
    "remark,scale,offset",
    [
        ("QUAL encoding = phred+33", "PHRED", 33), ("QUAL encoding = solexa+64 (may drop below '@')", "LOGODDS", 64), ("standard FASTQ qualities (starts at '!')", "PHRED", 33),
        ("operator changed at plate 64; Phred scores shifted by 64", "PHRED", 64), ("error probability of each base instead of a score", None, None), ("library kept at 4 C for 33 days", None, None),
        ("numeric Phred values, one per base", "PHRED", None), ("numeric scores, Solexa odds scale", "LOGODDS", 64),
    ],
)
def test_remarks(spark, remark, scale, offset):
    m = spark.createDataFrame([(1, None, remark, "", "")], MANIFEST)
    r = manifest_facts(m).first()
    assert (r.remark_scale if r else None, r.remark_offset if r else None) == (scale, offset)
