import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.operators.errparse import csv_edits, edits_of, error_parse, fields_of, line_edits, p4_found, sam_edits

SCHEMA = "raw_id bigint, layout string, raw_text string, reason string, fits boolean, body int, name string"
CASES = [
    ("csv", "n,ACGT,IIII", None),
    ("csv", '"n, ""x""",ACGT,"I,""I"', None),
    ("csv", "n,ACGT,IIII\r\n", None),
    ("csv", "n,ACGT,IIII\n\n", "columns"),
    ("csv", 'n"x,ACGT,IIII', "quoting"),
    ("csv", '"n,ACGT,IIII', "quoting"),
    ("csv", '"n"x,ACGT,IIII', "quoting"),
    ("csv", 'n,ACGT,"IIII', "quoting"),
    ("csv", "n,ACGT", "columns"),
    ("csv", "n,ACGT,II,II", "columns"),
    ("csv", '"a","b","c","d"', "columns"),
    ("csv", 'a"b,c', "quoting"),
    ("csv", "", "columns"),
    ("csv", " ,ACGT,IIII", "name"),
    ("csv", "x" * 257 + ",ACGT,IIII", "name"),
    ("csv", "  " + "x" * 256 + " ,ACGT,IIII", None),
    ("csv", "n,,IIII", "bases"),
    ("csv", "n,ACXT,IIII", "bases"),
    ("csv", "n,acgtn.-,IIIIIII", None),
    ("csv", "n,ACGT, ", "quals"),
    ("csv", "n,ACGT,II\x07I", "quals"),
    ("csv", "n,ACGT,III", "length"),
    ("csv", "n,*,I", "bases"),
    ("fastq", "@n\nACGT\n+\nIIII", None),
    ("fastq", "@n\nACGT\n+n\n@III\n", None),
    ("fastq", "n\nACGT\n+\nIIII", "columns"),
    ("fastq", "@n\nACGT\nIIII", "columns"),
    ("fastq", "@n\nACGT\n-\nIIII", "columns"),
    ("fastq", "@n\nACGT\n+\nIIII\nX", "columns"),
    ("fastq", "@\nACGT\n+\nIIII", "name"),
    ("fastq", "@n\nACGT\n+\n", "quals"),
    ("fastq", "@n\n\n+\n\n", "bases"),
    ("fastq", "@n\nACGT\n+\nIII", "length"),
    ("sam", "q\t0\t*\t0\t*\t*\t*\t0\t0\tACGT\tIIII", None),
    ("sam", "q\t0\t*\t0\t*\t*\t*\t0\t-7\tACGT\tIIII\tNM:i:2\tXC:A:k\n", None),
    ("sam", "q\t0\t*\t0\t*\t*\t*\t0\t0\tACGT", "columns"),
    ("sam", "q\t0\t*\t0\t*\t*\t*\t0\t0\tACGT\tIIII\tjunk", "columns"),
    ("sam", "q\t0x4\t*\t0\t*\t*\t*\t0\t0\tACGT\tIIII", "number"),
    ("sam", "q\t0\t*\t0\t*\t*\t*\t0\t\tACGT\tIIII", "number"),
    ("sam", "q\t0\t*\t0\t*\t*\t*\t0\t0\t*\tIIII", "bases"),
    ("sam", "q\t0\t*\t0\t*\t*\t*\t0\t0\tACGT\t*", "quals"),
    ("sam", "q\tx\t*\t0\t*\t*\t*\t0\t0\tACG\tIIII", "number"),
    ("csv", None, "columns"),
    ("other", "x", "columns"),
    (None, "x", "columns"),
    (" CSV ", "n,ACGT,IIII", None),
    ("csv", "n,ACGT," + "I" * 50_000, "length"),
    ("csv", "n," + "ACGT" * 20_000 + "," + "I" * 80_000, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, layout, text, "x", True, 1, "clash") for i, (layout, text, _) in enumerate(CASES)]
    raw = spark.createDataFrame(rows + rows[:5], SCHEMA)
    loaded, failed = error_parse(raw)
    return {r.raw_id: r for r in loaded.collect()}, {r.raw_id: r for r in failed.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reason(parsed, i):
    loaded, failed = parsed
    want = CASES[i][2]
    assert (i in loaded) == (want is None)
    assert (failed[i].reason if i in failed else None) == want
    if want in ("quoting", "columns"):
        assert failed[i].quote_edits + failed[i].delimiter_edits > 0 and failed[i].operations


def test_loaded_values(parsed):
    r = parsed[0][1]
    assert (r.name, r.bases, r.quals) == ('n, "x"', "ACGT", 'I,"I')


def test_empty_and_repeats(spark):
    raw = spark.createDataFrame([], SCHEMA)
    assert p4_found(raw).collect() == []
    rows = spark.createDataFrame([(1, "csv", "x", "", True, 1, "")] * 3, SCHEMA)
    assert len(p4_found(rows).collect()) == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('a,"\n ', max_size=6), min_size=3, max_size=3))
def test_written_rows_cost_nothing(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert csv_edits(out.getvalue())[:2] == (0, 0)


@settings(max_examples=300, deadline=None)
@given(st.text('a,"', max_size=9))
def test_cost_is_zero_only_for_rows_that_parse(text):
    """Brute force: the grammar of a row, by hand."""

    def parses(t):
        fields, i = 0, 0
        while True:
            if i < len(t) and t[i] == '"':
                i += 1
                while True:
                    if i >= len(t):
                        return None
                    if t[i] == '"':
                        if t[i + 1 : i + 2] == '"':
                            i += 2
                            continue
                        i += 1
                        break
                    i += 1
            else:
                while i < len(t) and t[i] not in ',"':
                    i += 1
            fields += 1
            if i == len(t):
                return fields
            if t[i] != ",":
                return None
            i += 1

    n = parses(text)
    quotes, delimiters, ops = csv_edits(text)
    assert (quotes == 0) == (n is not None)
    if n is not None:
        assert delimiters == abs(n - 3)
    assert bool(ops) == bool(quotes + delimiters)


def test_line_edits():
    assert line_edits(["@n", "A", "+", "I"]) == (0, "")
    assert line_edits(["@n", "A", "I"])[0] in (1, 2)
    assert line_edits(["n", "A", "+", "I"]) == (1, "insert @@1")
    assert line_edits(["@n", "A", "+", "I", "X"]) == (1, "delete line end@5")
    assert line_edits([]) == (4, ";".join(["insert line end@0"] * 4))


SAM = ["q", "0", "chr1", "7", "60", "4M", "*", "0", "-3", "ACGT", "IIII"]


def test_sam_edits_say_where():
    """A column that is missing, or one too many, is found by the types of the columns."""
    assert sam_edits("\t".join(SAM + ["NM:i:2"])) == (0, "")
    for gone in (1, 3, 5, 9):
        edits, ops = sam_edits("\t".join(SAM[:gone] + SAM[gone + 1 :]))
        assert edits == 1 and ops.startswith("insert tab@")
    assert sam_edits("\t".join(SAM[:3] + ["x y"] + SAM[3:])) == (1, "delete tab@4")
    assert sam_edits("\t".join(SAM + ["junk"])) == (1, "delete tab@12")
    assert sam_edits("\t".join(SAM[:2]) + "\n" + "\t".join(SAM[2:]))[0] == 2


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["csv", "fastq", "sam", "other"]), st.text('a,"\n\r\t@+A1:', max_size=40))
def test_no_edit_is_needed_exactly_where_a_row_fits(kind, text):
    quotes, delimiters, ops = edits_of(kind, text)
    assert (fields_of(kind, text) is not None) == (quotes + delimiters == 0) == (ops == "")


def test_copies_that_differ(spark):
    rows = spark.createDataFrame([(1, "csv", "n,A", "", True, 1, ""), (1, "csv", "b,A,I", "", True, 1, ""), (1, "csv", "a,A,I", "", True, 1, ""), (1, "csv", "a,A,", "", True, 1, "")], SCHEMA)
    good, bad = error_parse(rows.repartition(3))
    assert [r.name for r in good.collect()] == ["a"] and [r.reason for r in bad.collect()] == ["columns"] == [r.reason for r in p4_found(rows).collect()]
