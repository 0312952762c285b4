import math

from pyspark.sql import functions as F

from readloom.functions import bases, names, quality, regions, sam

CASAVA = "inst:1:FC:1:1:0:0 1:Y:18:ATCACG+GCGCTA"


def test_casava_names(column):
    v = [CASAVA, "a:1 2:N:0:", "a:1\t1:N:2", "a:1 1:N:3:X", "a:1 1:X:0:A", "plain", None, "", "a:1 12:Y::", "a:1  1:N:0"]
    assert column(names.is_casava, v) == [True, True, True, False, False, False, None, False, False, True]
    assert column(names.base_name, v)[:3] == ["inst:1:FC:1:1:0:0", "a:1", "a:1"]
    assert column(names.read_index, v)[:4] == ["1", "2", "1", None]
    assert column(names.barcode, v)[:3] == ["ATCACG+GCGCTA", None, None]
    assert column(names.is_filtered, v) == [True] + [False] * 9


def test_keys_and_numbers(column):
    v = ["READ/1", "READ.2", "READ:10", "READ_20", "READ|3", "A00:5:HX:2:1101:6768:1", "A-0:5:H-X:2:1101:6768:1", CASAVA, "plain", None, "x/99999999999"]
    assert column(names.read_key, v) == ["READ", "READ", "READ", "READ", "READ", None, None, "inst:1:FC:1:1:0:0", None, None, "x"]
    assert column(names.pair_number, v) == [1, 2, 10, 20, 3, None, None, 1, None, None, None]
    assert column(names.key_or_name, v)[5] == v[5]
    assert column(lambda c: names.validator_key(c, F.lit(False)), ["a/1", "a/5", "a/0"]) == ["a", "a/5", "a/0"]
    assert column(lambda c: names.validator_label(c, F.lit(False), F.lit("f")), ["a/4", "a/5"]) == ["4", "f"]


def test_output_names(column):
    assert column(names.single_base_name, ["a/1", "a/b/1", "a", CASAVA]) == ["a", "a/b", "a", "inst:1:FC:1:1:0:0"]
    assert column(lambda c: names.numbered(c, "E", F.lit(3)), ["n", None]) == ["E.3 n", None]
    assert column(lambda c: names.numbered(c, None, F.lit(3)), ["n"]) == ["n"]
    assert column(lambda c: names.orphan_output_name(c, names.read_key(c), names.pair_number(c)), ["LEFT_ONLY/10", CASAVA]) == ["LEFT_ONLY/10", CASAVA]
    assert column(names.is_generated_name, ["E.1 7/1", "E.1 x", "E.1 12", "one", "E.1 /1"]) == [True, False, True, None, False]
    assert column(lambda c: names.error_text(F.lit("bad"), c, F.lit(4)), ["n", None]) == ["Read Name: n, Read Index: 4, bad", "Read Index: 4, bad"]
    assert column(lambda c: names.joined_text(c, F.lit(" b  c ")), ["a"]) == ["a b c"]


def test_quality_vectors(column):
    assert column(quality.values, ['!"}~', "", None]) == [[0, 1, 92, 93], [], None]
    shown = lambda e: column(lambda c: quality.values(quality.normalise(c, e)), [";<=>?@ABC{|}~"])[0]
    assert shown("Solexa") == [0, 0, 0, 0, 0, 3, 4, 4, 5, 59, 60, 61, 62]
    assert column(lambda c: quality.values(quality.normalise(c, "Illumina")), ["@A}~"]) == [[0, 1, 61, 62]]
    assert column(lambda c: quality.normalise(c, "Standard"), ['!"#${|}~', None]) == ['!"#${|}~', None]
    assert column(lambda c: quality.normalise(c, "Solexa"), [";<=>{|}~"]) == ["!!!!\\]^_"]
    assert column(lambda c: quality.normalise(c, "Illumina"), ["@ABC{|}~"]) == ['!"#$\\]^_']


def test_detection(column):
    assert column(lambda c: quality.detect_encoding(quality.lowest_code(c)), ["!I", ";h", "@h", "FFJ", "", None, ":"]) == ["Standard", "Solexa", "Illumina", "Illumina", None, None, "Standard"]


def test_decode_encode(column):
    assert column(lambda c: quality.decode(c, "SOLEXA"), [";@~", "!"]) == [[-5, 0, 62], None]
    assert column(lambda c: quality.decode(c, "ILLUMINA_1_5"), ["B", "C"]) == [None, [3]]
    assert column(lambda c: quality.encode(quality.decode(c, "ILLUMINA_1_3"), "SANGER"), ["@h"]) == ["!I"]


def test_logodds(column):
    scores = list(range(-5, 60))
    assert column(quality.logodds_to_phred, scores, "int") == [math.floor(10 * math.log10(10 ** (s / 10) + 1) + 0.5) for s in scores]
    assert column(quality.phred_to_logodds, [0, 1, 2, 3, 10, 40], "int") == [-5, -5, -2, 0, 10, 40]


def test_mean_quality(column):
    assert column(quality.mean_quality, ["II", "!I", "", None]) == [40.0, 20.0, None, None]
    assert column(quality.is_high_quality, ["??", ">>", "", None]) == [True, False, False, False]


def test_bases(column):
    assert column(bases.replace_uracil, ["GACGGAUCuAUAGCAAAACu", None]) == ["GACGGATCtATAGCAAAACt", None]
    assert column(bases.reverse_complement, ["ACGTNacgt", "", None]) == ["acgtNACGT", "", None]
    assert column(bases.count_autcg, ["AUTCGn", "autcg", "", None]) == [5, 5, 0, None]
    assert column(bases.is_iupac, ["ACGTURYSWKMBDHVN.-", "acgt", "AX", "", "A\n", None]) == [True, True, False, False, False, None]
    assert column(lambda c: bases.is_valid_reference(c, 2), ["ACx", "aC", ""]) == [True, False, True]
    assert column(bases.sequence_md5, [""]) == ["d41d8cd98f00b204e9800998ecf8427e"]
    assert column(lambda c: bases.fastq_text(c, F.lit("ACG"), F.lit("*"), F.lit(1)), ["n"]) == ["@n/1\nACG\n+\n!!!"]
    assert column(lambda c: bases.size_bytes(c, F.lit("ab")), ["é", None]) == [4, 2]


def test_sam(column):
    assert column(sam.segment_index, [0, 77, 141, 4, 64], "int") == [0, 1, 2, 0, 0]
    assert column(lambda c: sam.unmapped_flags(F.lit(True), c, F.lit(False)), [1, 2], "int") == [77, 141]
    assert column(lambda c: sam.unmapped_flags(F.lit(False), c, F.lit(True)), [1], "int") == [516]
    assert column(sam.blank_star, ["*", "A", None]) == ["", "A", None]


def test_regions(column):
    assert column(lambda c: regions.slice_clipped(c, F.lit(3), F.lit(4)), ["ABCDEFGH", "ABCD", "AB", None]) == ["CDEF", "CD", "", None]
    assert column(lambda c: regions.slice_clipped(c, F.lit(12), F.lit(2), 10), ["ABCDE"]) == ["CD"]
    assert regions.format_path("anything/%2s/%3s/%s", "0123456789") == "anything/01/234/56789"
    assert column(lambda c: regions.slice_zero_based(c, F.lit(1), F.lit(3)), ["ABCDE", "AB"]) == ["BCD", "B"]
    assert regions.format_path("x/%s", "ab") == "x/ab"
    assert column(lambda c: regions.format_path_column("a/%2s/%3s/%s", c), ["0123456789"]) == ["a/01/234/56789"]
    parts = column(regions.split_ref_path, ["/a/%2s/%s:http://h:80/x/%s;ftp://h/%s:/b"])[0]
    assert parts == ["/a/%2s/%s", "http://h:80/x/%s", "ftp://h/%s", "/b"]


def test_strict_slice_raises(spark):
    import pytest

    df = spark.createDataFrame([("ABC",)], "b string")
    with pytest.raises(Exception, match="outside"):
        df.select(regions.slice_strict(F.col("b"), F.lit(3), F.lit(2))).collect()
    assert df.select(regions.base_at(F.col("b"), F.lit(2)).alias("x")).first().x == "B"
