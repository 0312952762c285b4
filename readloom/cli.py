"""Command line: ``python -m readloom.cli COMMAND ...``.

validate, normalise (one or two FASTQ files), fastq2sam, sam2fastq, compare, reverse, generate, convert-quality.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import quality
from readloom.operators import convert, normalise, pairing, sampler, stats, validate
from readloom.sources import fastq, files, manifest, sam
from readloom.sources.bam import write_bam


def _normalised(spark: SparkSession, paths: list[str], lenient: bool = True) -> DataFrame:
    """Reads of one submission with Phred + 33 ``quals``; all files share the encoding that is detected."""
    reads = fastq.read_fastq(spark, paths, mode="lenient" if lenient else "strict")
    found = normalise.detect(reads).first()
    return normalise.normalised_reads(reads, (found and found.encoding) or "Standard")


def run_validate(spark: SparkSession, rows: list[dict], base: str | None = None, quick: bool = False, whole: bool = False, staged: bool = False) -> DataFrame:
    """Validate files given as manifest rows ``{file, file_type, quality_score}`` of one submission.

    ``quick`` looks at the first reads of each file only, ``whole`` at all of them without a limit; ``staged`` does so only if the first reads of all files are good.
    """
    if staged and not quick:
        first = run_validate(spark, rows, base, quick=True)
        if first.where("error is not null").limit(1).count():
            return first
    limits = None if whole and not quick else (validate.QUICK_LIMIT, validate.EXTENDED_LIMIT)
    if not rows:
        raise ValueError("No file provided.")
    m = spark.createDataFrame([(i, "run", r["file"], r.get("file_type", "fastq"), r.get("quality_score")) for i, r in enumerate(rows, 1)], "file_id bigint, run_accession string, file string, file_type string, quality_score string")
    kind = manifest.submission_format(m)
    listed = [r.path for r in manifest.raw_files(m, base).orderBy("file_id").collect()]  # the files of one submission
    if kind == "fastq":
        reads = _normalised(spark, listed, lenient=False).withColumn("file_id", F.col("file_no").cast("bigint"))
    else:
        records = sam.read_reads(spark, listed, kind)
        index = spark.createDataFrame([(p, i) for i, given in enumerate(listed, 1) for p in files.list_files([given])], "file string, file_id bigint")
        reads = records.join(F.broadcast(index), "file").select("file_id", F.col("record_no").alias("read_no"), F.col("qname").alias("name"), "bases", "quals")  # a row per file
        return validate.validate(reads, m.withColumn("quick", F.lit(quick)), limits=limits, is_sam=True)
    return validate.validate(reads, m.withColumn("quick", F.lit(quick)), limits=limits)


def run_normalise(spark: SparkSession, inputs: list[str], out: str, prefix: str | None = None) -> dict:
    """One file: renamed reads in ``out``.  Two: pairs and orphans in ``out``/segment_index=1, 2 and 0.  Gives the counts."""
    reads = _normalised(spark, inputs)
    if len(inputs) == 1:
        fastq.write_fastq(normalise.normalise_single(reads, prefix).orderBy("read_no").drop("name").withColumnRenamed("output_name", "name"), out)
        return normalise.single_counts(reads).first().asDict()
    bad = pairing.duplicate_slots(reads, on_bad_name="error").limit(1).collect()
    if bad:
        raise ValueError(f"SPOT_DUPLICATE: Got same spot twice: {bad[0].read_key}")
    bad = pairing.unexpected_numbers(reads, on_bad_name="error").collect()
    if bad:
        raise ValueError(f"UNEXPECTED_PAIR_NUMBER: {bad[0].n_numbers} pair numbers")
    rows = normalise.normalise_paired(reads, prefix=prefix)
    fastq.write_fastq_split(rows.orderBy("counter", "slot").select(F.col("slot").alias("segment_index"), F.col("output_name").alias("name"), "bases", "quals"), out)
    return pairing.pair_counts(pairing.assemble(reads, on_bad_name="error")).first().asDict()


def run_fastq2sam(spark: SparkSession, inputs: list[str], out: str, sample: str, as_bam: bool = False) -> None:
    """One or two FASTQ files as unaligned records of one sample."""
    if not 1 <= len(inputs) <= 2 or len(set(inputs)) != len(inputs):
        raise ValueError("one or two different files are needed")
    rows = convert.fastq_to_sam(_normalised(spark, inputs), paired=len(inputs) == 2)
    if as_bam:
        write_bam(rows, out, sample, sorted_by_name=len(inputs) == 2)
    else:
        sam.write_sam(rows.orderBy("qname", "flags") if len(inputs) == 2 else rows, out, sam.header_lines(sample, len(inputs) == 2))


def run_sam2fastq(spark: SparkSession, source: str, out: str, prefix: str | None = None, reverse: bool = True, file_format: str = "sam", compression: str | None = None) -> None:
    """Reads of a SAM or BAM file in ``out``/segment_index=0, 1 and 2."""
    fastq.write_fastq_split(convert.sam_to_fastq(sam.read_reads(spark, source, file_format), prefix, reverse).orderBy("record_no"), out, compression)


def run_compare(spark: SparkSession, a: list[str], b: list[str]) -> DataFrame:
    """Symbols whose counts differ between two sets of FASTQ files."""
    side = lambda p: stats.total_histogram(stats.symbol_histogram(fastq.read_fastq(spark, p), "file_no", {"bases": "bases", "quals": "raw_quals"}))
    return stats.histogram_difference(side(a), side(b))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="readloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("validate")
    c.add_argument("files", nargs="+")
    c.add_argument("--format", default="fastq")
    c.add_argument("--quick", action="store_true")
    c.add_argument("--whole", action="store_true")
    c.add_argument("--staged", action="store_true")
    c = sub.add_parser("normalise")
    c.add_argument("files", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--prefix")
    c = sub.add_parser("fastq2sam")
    c.add_argument("files", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--sample", required=True)
    c.add_argument("--bam", action="store_true")
    c = sub.add_parser("sam2fastq")
    c.add_argument("file")
    c.add_argument("--out", required=True)
    c.add_argument("--format", default="sam")
    c.add_argument("--prefix")
    c.add_argument("--no-reverse", action="store_true")
    c.add_argument("--compression")
    c = sub.add_parser("compare")
    c.add_argument("--first", nargs="+", required=True)
    c.add_argument("--second", nargs="+", required=True)
    c = sub.add_parser("reverse")
    c.add_argument("file")
    c.add_argument("--format", default="sam")
    c = sub.add_parser("generate")
    c.add_argument("--count", type=int, required=True)
    c.add_argument("--size", type=int, default=50)
    c.add_argument("--scoring", default="PHRED")
    c.add_argument("--offset", type=int, default=33)
    c.add_argument("--low", type=int, default=2)
    c.add_argument("--high", type=int, default=40)
    c.add_argument("--out", required=True)
    c = sub.add_parser("convert-quality")
    c.add_argument("text")
    c.add_argument("--source", default="ILLUMINA_1_3")
    c.add_argument("--target", default="SANGER")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    try:
        if a.command == "validate":
            out = run_validate(spark, [{"file": f, "file_type": a.format} for f in a.files], quick=a.quick, whole=a.whole, staged=a.staged)
            out.show(1000, False)
            return int(out.where("error is not null").limit(1).count() > 0)
        if a.command == "normalise":
            print(run_normalise(spark, a.files, a.out, a.prefix))
        elif a.command == "fastq2sam":
            run_fastq2sam(spark, a.files, a.out, a.sample, a.bam)
        elif a.command == "sam2fastq":
            run_sam2fastq(spark, a.file, a.out, a.prefix, not a.no_reverse, a.format, a.compression)
        elif a.command == "compare":
            diff = run_compare(spark, a.first, a.second)
            diff.show(1000, False)
            return int(diff.limit(1).count() > 0)
        elif a.command == "reverse":
            convert.first_reverse_read(sam.read_reads(spark, a.file, a.format)).show(1, False)
        elif a.command == "generate":
            fastq.write_fastq(sampler.generate_reads(spark, a.count, a.size, a.scoring, a.offset, a.low, a.high), a.out)
        else:
            v = spark.createDataFrame([(a.text,)], "t string").select(quality.encode(quality.decode(F.col("t"), a.source), a.target).alias("t")).first()
            print(v.t)
    except (ValueError, NotImplementedError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
