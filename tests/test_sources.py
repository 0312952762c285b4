import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from readloom import cli
from readloom.operators import convert
from readloom.sources import bam, fastq, files, manifest, sam


def text(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randint(1, 60)
        q = "".join(rng.choice("@+IAB#") for _ in range(size))
        out.append(f"@r{i}/1\n{''.join(rng.choice('ACGT') for _ in range(size))}\n+\n{q}\n")
    return "".join(out)


def key(df):
    return sorted(((r.file_no, r.read_no, r.name, r.bases, r.raw_quals) for r in df.collect()))


def test_strict_whole_split_and_compressed(spark, tmp_path):
    t = text(700)
    plain = tmp_path / "a.fastq"
    plain.write_text(t)
    (tmp_path / "b.dat").write_bytes(gzip.compress(t[:9000].encode()) + gzip.compress(t[9000:].encode()))
    (tmp_path / "c.dat").write_bytes(bz2.compress(t.encode()))
    whole = key(fastq.read_fastq(spark, str(plain)))
    assert len(whole) == 700 and [w[1] for w in whole] == list(range(1, 701))
    for size in (333, 1000, 7777):
        assert key(fastq.read_fastq(spark, str(plain), splitBytes=size)) == whole
    two = key(fastq.read_fastq(spark, [str(tmp_path / "b.dat"), str(tmp_path / "c.dat")]))
    assert [x[1:] for x in two if x[0] == 1] == [x[1:] for x in two if x[0] == 2] == [x[1:] for x in whole]
    assert fastq.read_fastq(spark, str(plain), maxReadsPerFile=5).count() == 5


def test_strict_errors_and_blank_lines(spark, tmp_path):
    p = tmp_path / "x.fastq"
    p.write_text("\n@a\nAC\n+\nII\n\n@b\r\nA\r\n+b\r\nI\r\n\n")
    assert [(r.name, r.plus) for r in fastq.read_fastq(spark, str(p)).orderBy("read_no").collect()] == [("a", ""), ("b", "b")]
    for broken in ("a\nA\n+\nI\n", "@a\nA\nI\n", "@a\nA\n+\nII\n", "@a\nA\n+\n"):
        p.write_text("@ok\nA\n+\nI\n" + broken)
        rows = fastq.read_fastq(spark, str(p), on_error="row").orderBy("read_no").collect()
        assert rows[0].name == "ok" and rows[1].error and rows[1].line_no >= 5
        with pytest.raises(Exception, match="line"):
            fastq.read_fastq(spark, str(p)).collect()
    p.write_text("")
    assert fastq.read_fastq(spark, str(p)).collect() == []


def test_lenient_grammar():
    read = lambda t: list(fastq.lenient_records(iter(t.splitlines(True))))
    assert read("@a b\nAC\nGT \n+x y\nII\nII\n") == [("a b", "ACGT", "x y", "IIII")]
    assert read("@a\nACG\n+\n40 -5 2\n") == [("a", "ACG", "", chr(73) + chr(28) + chr(35))]
    assert read("@a\nAC\n+\n@I\n@b\nA\n+\nI") == [("a", "AC", "", "@I"), ("b", "A", "", "I")]
    assert read("@a\nAC\n+\nI") == [] and read("") == []
    for broken in ("@a\nAX\n+\nII\n", "@a\nA\n+\nII\n", "a\nA\n+\nI\n", "@" + "x" * 257 + "\nA\n+\nI\n", "@a\nACG\n+\n1 2\n", "@i:1 1:N:0:A\nA\n+\nI\n@plain\nA\n+\nI\n", "@a\nAC\n+\nI\x07\n"):
        with pytest.raises(fastq.FastqError):
            read(broken)
    with pytest.raises(fastq.FastqError):
        list(fastq.lenient_records(iter(["@a\n", "AC\n", "+\n", "II\n"]), expected_length=3))


def test_write_and_split(spark, tmp_path):
    df = spark.createDataFrame([(0, "u", "AC", "II"), (1, "p/1", "A", None), (1, "q/1", "C", "*")], "segment_index int, name string, bases string, quals string")
    fastq.write_fastq(df, str(tmp_path / "o"), compression="gzip")
    assert fastq.read_fastq(spark, str(tmp_path / "o")).count() == 3
    fastq.write_fastq_split(df, str(tmp_path / "s"))
    made = fastq.merge_split(str(tmp_path / "s"), str(tmp_path / "m"), gzipped=True)
    assert [m.rsplit("/", 1)[1] for m in made] == ["m.fastq.gz", "m_1.fastq.gz"]
    assert sorted(r.raw_quals for r in fastq.read_fastq(spark, made[1]).collect()) == ["!", "!"]
    assert fastq.orphan_path("x_1.fastq.gz", "x_2.fastq.gz") == "x.fastq.gz" and fastq.orphan_path("a.fq", "b.fq") == "a.fq.orphans"


def test_sniffing(tmp_path):
    p = tmp_path / "x"
    for data, kind in ((b"CRAM\3", "cram"), (b"CR", "plain"), (b"", "plain"), (b"BZh9", "bzip2"), (b"\x1f\x8b\x08", "gzip")):
        p.write_bytes(data)
        assert files.sniff(str(p)) == kind
    assert not files.is_cram(str(tmp_path / "none"))
    z = tmp_path / "t.tar.gz"
    import io
    import tarfile

    with tarfile.open(z, "w:gz") as t:
        info = tarfile.TarInfo("a")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert files.open_named(str(z)).read() == b"abc"
    with pytest.raises(NotImplementedError):
        files.open_named(_touch(tmp_path / "y.bgz"))


def _touch(p):
    p.write_bytes(b"")
    return str(p)


SAM_TEXT = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:c\tLN:5\tUR:file:/x\n@RG\tID:A\tSM:s\n@CO\tfree text\nq1\t77\t*\t0\t*\t*\t*\t0\t0\tACGT\tIIII\tRG:Z:A\tBC:Z:A:B\nq1\t157\t*\t0\t0\t*\t*\t0\t0\tAACC\tABCD\n"


def test_sam(spark, tmp_path):
    p = tmp_path / "x.sam"
    p.write_text(SAM_TEXT)
    for split in (40, 1 << 20):
        rows = sam.read_sam(spark, str(p), splitBytes=split).orderBy("record_no").collect()
        assert [(r.record_no, r.qname, r.flags, r.mapq, r.bases, r.tags) for r in rows] == [(5, "q1", 77, "*", "ACGT", {"RG": "A", "BC": "A:B"}), (6, "q1", 157, "0", "AACC", {})]
    head = {r.record: r.tags for r in sam.read_sam_header(spark, str(p)).collect()}
    assert head["SQ"] == {"SN": "c", "LN": "5", "UR": "file:/x"} and head["CO"] == {}
    sam.write_sam(spark.createDataFrame([("q\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI",)], "line string"), str(tmp_path / "o"), sam.header_lines("s", True))
    assert sam.read_sam(spark, str(tmp_path / "o")).first().qname == "q"
    with pytest.raises(ValueError):
        sam.header_lines(" ", False)
    with pytest.raises(ValueError, match="fasta"):
        sam.read_reads(spark, str(p), "fasta")
    with pytest.raises(NotImplementedError):
        sam.read_reads(spark, str(p), "cram")


def test_bam_round_trip(spark, tmp_path):
    rows = [("q1", 77, "ACGTN", "IIII#", "ACGT"), ("q2", 4, "A", "*", None), ("q3", 4, "", "*", None)] + [(f"r{i}", 4, "ACG" * 50, "I" * 150, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "qname string, flags int, bases string, quals string, barcode string").repartition(3)
    bam.write_bam(df, str(tmp_path / "o"), "sample")
    got = sam.read_reads(spark, str(tmp_path / "o"), "bam")
    back = {r.qname: (r.flags, r.bases, r.quals, r.tags.get("BC"), r.pos, r.rname) for r in got.collect()}
    assert len(back) == 3003 and back["q1"] == (77, "ACGTN", "IIII#", "ACGT", 0, "*") and back["q2"][1:3] == ("A", "*") and back["q3"][1] == "*"
    with pytest.raises(ValueError):
        bam.write_bam(df, str(tmp_path / "p"), " ")
    (tmp_path / "bad.bam").write_bytes(gzip.compress(b"nope"))
    with pytest.raises(Exception, match="not a BAM"):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).collect()


def test_manifest(spark):
    m = spark.createDataFrame([(2, "a.fq", "FASTQ ", "PHRED_64"), (1, "/x/b.bam", "bam", "PHRED_33"), (3, "c", None, None), (4, "d", "fastq", "LOGODDS")], "file_id bigint, file string, file_type string, quality_score string")
    got = {r.file_id: (r.file_type, r.path, r.scoring, r.ascii_offset) for r in manifest.raw_files(m, "/base").collect()}
    assert got == {2: ("fastq", "/base/a.fq", "phred", "FROM64"), 1: ("bam", "/x/b.bam", None, None), 3: (None, "/base/c", None, None), 4: ("fastq", "/base/d", "log_odds", None)}
    assert manifest.submission_format(m) == "bam"
    with pytest.raises(ValueError):
        manifest.submission_format(m.limit(0))


def test_command_line_round_trip(spark, tmp_path):
    a, b = tmp_path / "a_1.fastq", tmp_path / "a_2.fastq"
    a.write_text("".join(f"@r{i}/1\nACGU\n+\nhhhB\n" for i in range(5)) + "@only/1\nA\n+\nh\n")
    b.write_text("".join(f"@r{i}/2\nAC\n+\nhh\n" for i in range(5)))
    assert cli.run_normalise(spark, [str(a), str(b)], str(tmp_path / "n"), "E") == {"n_pairs": 5, "n_orphans": 1, "n_reads": 11, "n_bases": 31}
    made = fastq.merge_split(str(tmp_path / "n"), str(tmp_path / "m"))
    first = fastq.read_fastq(spark, made[1]).orderBy("name").first()
    assert (first.name, first.bases, first.raw_quals) == ("E.2 r0/1", "ACGT", "III#")
    cli.run_fastq2sam(spark, [str(a), str(b)], str(tmp_path / "sam"), "s")
    cli.run_sam2fastq(spark, str(tmp_path / "sam"), str(tmp_path / "fq"))
    back = fastq.read_fastq(spark, fastq.merge_split(str(tmp_path / "fq"), str(tmp_path / "k"))[2])
    assert {(r.name, r.bases, r.raw_quals) for r in back.collect()} == {(f"r{i}/2", "AC", "II") for i in range(5)}
    cli.run_fastq2sam(spark, [str(a)], str(tmp_path / "bam"), "s", as_bam=True)
    assert {r.qname for r in bam.read_bam(spark, str(tmp_path / "bam")).collect()} == {"r0", "r1", "r2", "r3", "r4", "only"}
    out = cli.run_validate(spark, [{"file": str(a)}, {"file": str(b)}]).collect()
    assert all(r.valid for r in out) and len(out) == 2
    assert cli.run_compare(spark, [str(a)], [str(a)]).collect() == []
    with pytest.raises(ValueError):
        cli.run_fastq2sam(spark, [str(a), str(a)], str(tmp_path / "z"), "s")
    with pytest.raises(ValueError):
        cli.run_validate(spark, [])
    assert convert.first_reverse_read(sam.read_sam(spark, str(tmp_path / "sam"))).collect() == []


def test_lenient_source(spark, tmp_path):
    p = tmp_path / "l.fastq"
    p.write_text("@a\nAC\nG\n+\nII\nI\n")
    r = fastq.read_fastq(spark, str(p), mode="lenient").first()
    assert (r.bases, r.raw_quals) == ("ACG", "III")
    assert fastq.read_fastq(spark, str(p), mode="lenient").select(F.count("*")).first()[0] == 1


def lenient_text(n, seed=3):
    """Records over several lines, with qualities that look like names, and some as numbers."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randint(1, 60)
        b, q = "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+IAB#") for _ in range(size))
        cut = lambda x: "\n".join(x[k : k + 13] for k in range(0, len(x), 13))
        form = rng.random()
        out.append(f"@r{i}\n{cut(b)}\n+\n{' '.join(str(ord(c) - 33) for c in q) if form < 0.2 and size > 2 else cut(q) if form < 0.6 else q}\n" + "\n" * (form > 0.95))
    return "".join(out)


def test_lenient_files_are_split(spark, tmp_path):
    p = tmp_path / "l.fastq"
    p.write_text(lenient_text(400))
    whole = key(fastq.read_fastq(spark, str(p), mode="lenient"))
    assert len(whole) == 400 and [w[1] for w in whole] == list(range(1, 401))
    for size in (150, 1000, 9000):
        df = fastq.read_fastq(spark, str(p), mode="lenient", splitBytes=size)
        assert key(df) == whole
    assert spark.read.format("fastq").options(mode="lenient", splitBytes=1000).load(str(p)).rdd.getNumPartitions() > 10
    p.write_text(text(300))
    assert key(fastq.read_fastq(spark, str(p), mode="lenient", splitBytes=700)) == key(fastq.read_fastq(spark, str(p)))


def test_paths_with_commas_and_brackets(spark, tmp_path):
    names = ["a,b.fastq", "[c].fastq", "d e.fastq"]
    for i, n in enumerate(names):
        (tmp_path / n).write_text(f"@r{i}\nAC\n+\nII\n")
    assert [r.name for r in fastq.read_fastq(spark, [str(tmp_path / n) for n in names]).orderBy("file_no").collect()] == ["r0", "r1", "r2"]
    assert fastq.read_fastq(spark, str(tmp_path / names[0])).count() == 1
    (tmp_path / "x,y.sam").write_text("q\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    assert sam.read_sam(spark, str(tmp_path / "x,y.sam")).first().qname == "q"


def test_alignment_files_without_records_are_no_good(spark, tmp_path):
    (tmp_path / "empty.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:1\tLN:5\n")
    (tmp_path / "good.sam").write_text("@HD\tVN:1.6\nq\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    bam.write_file(str(tmp_path / "empty.bam"), iter([]), "s")
    check = lambda *n: {r.file_id: r.error for r in cli.run_validate(spark, [{"file": str(tmp_path / x), "file_type": x[-3:]} for x in n]).collect()}
    nothing = "Submitted files must contain a minimum of 1 sequence read"
    assert check("empty.sam") == {1: nothing} == check("empty.bam") and check("good.sam", "empty.sam") == {1: None, 2: nothing}


def test_bam_of_pairs_is_sorted_by_name(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"p_{i}.fastq").write_text("".join(f"@r{k % 7}{k}/{i}\nAC\n+\nII\n" for k in range(60)))
    cli.run_fastq2sam(spark, [str(tmp_path / "p_1.fastq"), str(tmp_path / "p_2.fastq")], str(tmp_path / "sorted"), "s", as_bam=True)
    parts = files.list_files([str(tmp_path / "sorted")])
    assert all(b"SO:queryname" in gzip.decompress(open(p, "rb").read()) for p in parts)
    names = [r.qname for p in parts for r in bam.read_bam(spark, p).orderBy("record_no").collect()]
    assert len(names) == 120 and names == sorted(names)


def test_staged_validation_ends_with_the_first_reads(spark, tmp_path, monkeypatch):
    from readloom.operators import validate

    monkeypatch.setattr(validate, "QUICK_LIMIT", 2)
    monkeypatch.setattr(validate, "EXTENDED_LIMIT", 3)
    p = tmp_path / "v.fastq"
    run = lambda **x: cli.run_validate(spark, [{"file": str(p)}], **x).first()
    p.write_text("@a\nAC\n+\nII\n@b\nA!\n+\nII\n@c\nAC\n+\nII\n@d\n\n+\n\n")
    assert run(staged=True).n_reads == 2 and run(staged=True).error
    p.write_text("@a\nAC\n+\nII\n@b\nAC\n+\nII\n@c\nAC\n+\nII\n@d\n\n+\n\n")
    assert (run(staged=True).n_reads, run(staged=True).error) == (3, None) and run(quick=True).n_reads == 2
    assert run(staged=True, whole=True).error == validate.EMPTY_READ
