from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom.operators import convert, reference, sampler, stats

SAM = "record_no bigint, qname string, flags int, bases string, quals string, slot string, n int, counter string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SAM).drop("slot", "n", "counter") if rows else spark.createDataFrame([], SAM).drop("slot", "n", "counter")


def test_sam_to_fastq(spark):
    rows = [(1, "a", 77, "ACGT", "IIII"), (2, "u", 4, "AC", "*"), (3, "a", 157, "AACC", "ABCD"), (4, "lone", 77, "G", "I"), (5, "a", 256 + 77, "T", "I"), (6, "bad", 512, "T", "I"), (7, "nul", None, None, None)]
    out = {r.record_no: (r.segment_index, r.name, r.bases, r.quals) for r in convert.sam_to_fastq(records(spark, rows)).collect()}
    assert out == {1: (1, "a/1", "ACGT", "IIII"), 3: (2, "a/2", "GGTT", "DCBA"), 2: (0, "u", "AC", "!!"), 4: (0, "lone", "G", "I"), 7: (0, "nul", "", "")}
    out = {r.record_no: r.name for r in convert.sam_to_fastq(records(spark, rows), prefix="P").collect()}
    assert out == {2: "P.1 u", 1: "P.2 a/1", 3: "P.2 a/2", 7: "P.3 nul", 4: "P.4 lone"}
    c = convert.record_counters(records(spark, rows)).first()
    assert (c.total, c.skipped_secondary, c.skipped_qc, c.n_reads) == (7, 1, 1, 5)
    assert convert.first_reverse_read(records(spark, rows)).first().record_no == 3


def test_sam_empty(spark):
    e = records(spark, [])
    assert convert.sam_to_fastq(e).collect() == [] and convert.first_reverse_read(e).collect() == []
    assert tuple(convert.record_counters(e).first()) == (0, 0, 0, 0, 0)


def test_fastq_to_sam_and_back(spark):
    rows = [(1, 1, "p/1", "ACGU", "IIII"), (2, 1, "p/2", "AC", "II"), (1, 2, "o/1", "A", "I"), (1, 3, "c:1 1:Y:0:ACGT", "A", "I"), (2, 3, "c:1 2:N:0:", "A", "I")]
    reads = spark.createDataFrame(rows, "file_no int, read_no bigint, name string, bases string, quals string")
    out = {(r.qname, r.flags): r for r in convert.fastq_to_sam(reads).collect()}
    assert set(out) == {("p", 77), ("p", 141), ("o", 4), ("c:1", 77 + 512), ("c:1", 141)}
    assert out["p", 77].line == "p\t77\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tRG:Z:A"
    assert out["c:1", 589].line.endswith("\tBC:Z:ACGT\tRG:Z:A")
    back = convert.sam_to_fastq(spark.createDataFrame([(i, k[0], k[1], r.bases, r.quals) for i, (k, r) in enumerate(out.items())], "record_no bigint, qname string, flags int, bases string, quals string"))
    assert {r.name for r in back.collect()} == {"p/1", "p/2", "o", "c:1"}  # the filtered read is left out
    bad = spark.createDataFrame([(1, 1, "n", "A-", "II")], reads.schema)
    with pytest.raises(Exception, match="SAM_RECORD_ERROR"):
        convert.fastq_to_sam(bad).collect()
    assert convert.fastq_to_sam(bad, strict=False).first().error == "SAM_RECORD_ERROR"


def test_histograms(spark):
    rows = [(1, "AACG", "II"), (1, None, ""), (None, "a", "!"), (2, "C" * 20_000, "#")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "g bigint, b string, q string, symbol string, n int")
    got = {(r.g, r.kind, r.symbol): r.n for r in stats.symbol_histogram(df, "g", {"bases": "b", "quals": "q"}).collect()}
    want = Counter()
    for g, b, q in rows:
        for k, t in (("bases", b), ("quals", q)):
            want.update((g, k, s) for s in t or "")
    assert got == dict(want)
    h = stats.symbol_histogram(df, "g", {"bases": "b"})
    assert stats.histogram_difference(h, h, ("g", "kind", "symbol")).where("g is not null").collect() == []
    d = stats.histogram_difference(h.where("g = 1"), h.where("g = 2")).collect()
    assert {(r.symbol, r.n_a, r.n_b) for r in d} == {("A", 2, None), ("C", 1, 20_000), ("G", 1, None)}
    assert stats.symbol_histogram(df.limit(0), "g", {"bases": "b"}).collect() == []


def test_intervals_and_models(spark):
    h = spark.createDataFrame([("@", 1), ("h", 2), ("~", 1)], "symbol string, n bigint")
    got = {r.interval: r.weight for r in stats.interval_weights(h).collect()}
    assert got == {"S": 0.25, "X": 0.75, "I": 0.75, "L": 0.25}
    assert all(abs(sum(stats.model_shares(m)) - 1) < 1e-12 for m in ("PHRED", "LOGODDS"))
    p = stats.model_shares("PHRED")
    # brute force over a grid of probabilities
    import math

    n = Counter(int(-10 * math.log10(i / 200_000)) for i in range(1, 200_000))
    total = sum(v for k, v in n.items() if -5 <= k <= 40)
    assert max(abs(p[i] - n.get(s, 0) / total) for i, s in enumerate(stats.SCORES)) < 1e-4
    exact = spark.createDataFrame([(chr(33 + s), int(1e9 * x)) for s, x in zip(stats.SCORES, p) if x > 0], "symbol string, n bigint")
    d = {r.model: r.distance for r in stats.scoring_distances(exact).collect()}
    assert d["PHRED"] < 1e-6 < d["LOGODDS"]


def test_sampler(spark):
    df = spark.createDataFrame([("ACGTN", "GEFD#~"), ("", ""), (None, None), ("A" * 999, "I" * 999)], "b string, q string")
    r = df.select("b", sampler.unpack_bases(sampler.pack_bases(F.col("b")), F.length("b")).alias("u"), sampler.pack_scores(F.col("q")).alias("s"), sampler.squeeze_bases(F.col("b")).alias("z")).collect()
    assert [x.u for x in r] == [x.b for x in r]
    assert list(sampler.unpack(bytes(r[0].s), 6, 6)) == [0, 1, 2, 3, 4, 38]
    assert bytes(r[0].z) == bytes([0x01, 0x23, 0x4F])
    with pytest.raises(Exception, match="without a code"):
        spark.createDataFrame([("AX",)], "b string").select(sampler.pack_bases(F.col("b"))).collect()
    with pytest.raises(EOFError):
        sampler.unpack(b"\0", 3, 3)


def test_generator(spark):
    a, b = (sampler.generate_reads(spark, 50, 20, low=3, high=30).orderBy("read_no").collect() for _ in range(2))
    assert a == b and a[0].name == "FASTQ_GENERATOR:000000001/1"
    assert all(len(r.bases) == 20 and set(r.bases) <= set("ACGT") and all(3 <= ord(c) - 33 <= 30 for c in r.quals) for r in a)
    assert sampler.generate_reads(spark, 0).collect() == []


def test_reference(spark, tmp_path):
    import hashlib

    seqs = {hashlib.md5(s).hexdigest(): s for s in (b"ACGT", b"GGGG")}
    m = list(seqs)
    headers = spark.createDataFrame([(1, "HD", {"VN": "1"}), (2, "SQ", {"SN": "a", "LN": "4", "M5": m[0].upper()}), (3, "SQ", {"SN": "b", "LN": "x"}), (4, "SQ", {"SN": "a", "LN": "9"}), (5, "RG", {"ID": "1", "SM": " "}), (6, "SQ", {"SN": "c", "M5": "0" * 32}), (7, "SQ", None)], "line_no int, record string, tags map<string,string>")
    sq = reference.sq_lines(headers)
    assert {r.sn: (r.line_no, r.ln, r.m5) for r in sq.collect()} == {"a": (2, 4, m[0]), "b": (3, None, None), "c": (6, None, "0" * 32)}
    assert [r.sn for r in reference.missing_checksums(sq).collect()] == ["b"]
    assert reference.sample_of(headers).first().sm is None
    table = {k: v.decode() for k, v in seqs.items()}
    found = reference.lookup(sq.select("m5"), table.get)
    assert {r.m5: r.bases for r in found.collect()} == {m[0]: "ACGT", "0" * 32: None}
    assert {r.m5: r.found for r in reference.confirm(sq, spark.createDataFrame([(m[0],)], "x string")).collect()} == {m[0]: True, "0" * 32: False}
    store = spark.createDataFrame([(m[0], "acgt")], "m5 string, bases string")
    assert {r.sn: (r.bases, r.tier) for r in reference.resolve(sq, [store.limit(0), store]).collect()} == {"a": ("ACGT", 1), "b": (None, None), "c": (None, None)}
    verdicts = reference.check_md5(sq, spark.createDataFrame([("a", "ACGT"), ("b", "GGGG")], "sn string, bases string"))
    assert {r.sn: r.verdict for r in verdicts.collect()} == {"a": "equal", "b": "filled", "c": "no_sequence"}
    asked = []
    s = reference.Store(str(tmp_path), fetch=lambda k: asked.append(k) or seqs.get(k), wait=0)
    assert s.get(m[0]) == b"ACGT" and s.get(m[0]) == b"ACGT" and s.get(None) is None and s.get("f" * 32, lambda: b"ac") == b"AC"
    again = reference.Store(str(tmp_path), wait=0)
    assert again.get(m[0]) == b"ACGT" and again.hits["disk"] == 1 and s.hits == {"memory": 1, "disk": 0, "remote": 1}
    fa, fai = tmp_path / "x.fa", tmp_path / "x.fa.fai"
    fa.write_text(">c1 d\nACGTA\nCGT\n>c2\nGG\n")
    fai.write_text("c1\t8\t6\t5\t6\nc2\t2\t20\t2\t3\n")
    assert reference.fasta_region(str(fa), str(fai), "c1", 4, 7) == "TACG"
    with pytest.raises(ValueError):
        reference.fasta_region(str(fa), str(fai), "c1", 4, 9)
    assert {r.contig: r.bases for r in reference.read_fasta(spark, str(fa)).collect()} == {"c1": "ACGTACGT", "c2": "GG"}
    assert reference.read_fai(spark, str(fai)).count() == 2
    replies = spark.createDataFrame([('{"metadata": {"id": "i", "md5": "m"}}',), ("{}",), (None,)], "reply string")
    assert [tuple(r) for r in reference.parse_metadata(replies).collect()] == [("i", "m"), (None, None), (None, None)]
    assert reference.cache_folder({"REF_CACHE": "/x"}) == "/x" and reference.cache_folder({"HOME": "/h"}).startswith("/h/")
