"""SAM text: source and sink; the dispatcher by format."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.sources import files, fastq


_ARROW = pa.schema([("file", pa.string()), ("chunk_no", pa.int32()), ("row_no", pa.int64()), ("value", pa.string())])


class _Part(InputPartition):
    def __init__(self, path: str, chunk_no: int, start: int, end: int, whole: bool):
        self.path, self.chunk_no, self.start, self.end, self.whole = path, chunk_no, start, end, whole


class _Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        split = int(self.options.get("splitbytes", fastq.SPLIT_BYTES))
        out = []
        for path in files.list_files(files.unpacked(self.options["path"])):
            ranges = files.chunks(path, split)
            out += [_Part(path, i, a, b, len(ranges) == 1) for i, (a, b) in enumerate(ranges)]
        return out

    def read(self, part):
        return files.batches(self._rows(part), _ARROW)

    def _rows(self, part):
        if part.whole:
            for n, line in enumerate(files.open_content(part.path), 1):
                yield part.path, part.chunk_no, n, line.rstrip(b"\r\n").decode("utf-8", "replace")
            return
        with files.open_raw(part.path) as f:
            at = max(0, part.start - 1)
            f.seek(at)
            if part.start:
                at += len(f.readline())
            n = 0
            while at < part.end and (line := f.readline()):
                at += len(line)
                n += 1
                yield part.path, part.chunk_no, n, line.rstrip(b"\r\n").decode("utf-8", "replace")


class NumberedLines(DataSource):
    """Lines of text files with their place; plain files are split."""

    @classmethod
    def name(cls):
        return "numbered_lines"

    def schema(self):
        return "file string, chunk_no int, row_no bigint, value string"

    def reader(self, schema):
        return _Lines({k.lower(): v for k, v in self.options.items()})


def read_lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """``(file, line_no, value)`` with 1-based line numbers."""
    spark.dataSource.register(NumberedLines)
    joined = files.packed(paths)
    rows = spark.read.format("numbered_lines").options(**{k: str(v) for k, v in options.items()}).load(joined)
    before = Window.partitionBy("file").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "chunk_no").agg(F.count("*").alias("n"))
    offsets = counts.select("file", "chunk_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(offsets, ["file", "chunk_no"]).select("file", (F.col("row_no") + F.col("before")).alias("line_no"), "value")


def parse_sam(lines: DataFrame) -> DataFrame:
    """SAM records of ``(file, line_no, value)``; header and blank lines left out; numbers that aren't are null."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i: at(i).try_cast("int")
    tags = F.filter(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: t.rlike("^[^:]+:[^:]:"))
    pairs = F.transform(tags, lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.regexp_extract(t, "^[^:]+:[^:]:(.*)$", 1).alias("v")))
    once = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    as_map = F.map_from_arrays(once, F.transform(once, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))
    records = lines.where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    return records.select(
        "file", F.col("line_no").alias("record_no"), at(0).alias("qname"), number(1).alias("flags"), at(2).alias("rname"), number(3).alias("pos"), at(4).alias("mapq"), at(5).alias("cigar"),
        at(6).alias("rnext"), number(7).alias("pnext"), number(8).alias("tlen"), at(9).alias("bases"), at(10).alias("quals"), as_map.alias("tags"),
    )


def parse_header(lines: DataFrame) -> DataFrame:
    """``(file, line_no, record, tags)`` of the header lines (comment lines have no tags)."""
    f = F.split(F.substring(F.col("value"), F.lit(2), F.length("value")), "\t")
    tags = F.filter(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:") & (F.get(f, F.lit(0)) != "CO"))
    keys = F.array_distinct(F.transform(tags, lambda t: F.substring(t, 1, 2)))
    values = F.transform(keys, lambda k: F.regexp_replace(F.element_at(F.filter(tags, lambda t: t.startswith(k)), 1), "^[^:]*:", ""))
    return lines.where(F.col("value").startswith("@")).select("file", "line_no", F.get(f, F.lit(0)).alias("record"), F.map_from_arrays(keys, values).alias("tags"))


def read_sam(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return parse_sam(read_lines(spark, paths, **options))


def read_sam_header(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return parse_header(read_lines(spark, paths, **options))


def sam_line(columns: dict[str, Column], tags: Column | None = None) -> Column:
    """A SAM line of the eleven columns; ``tags``: texts TAG:TYPE:VALUE."""
    fixed = ["qname", "flags", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "bases", "quals"]
    parts = [columns[c].cast("string") for c in fixed]
    line = F.concat_ws("\t", *parts)
    return line if tags is None else F.when(F.size(tags) > 0, F.concat(line, F.lit("\t"), F.array_join(tags, "\t"))).otherwise(line)


def header_lines(sample: str, sorted_by_name: bool) -> list[str]:
    """Header of an unaligned file with the one read group A."""
    if not sample or not sample.strip():
        raise ValueError("the sample has no name")
    return [f"@HD\tVN:1.6\tSO:{'queryname' if sorted_by_name else 'unsorted'}", f"@RG\tID:A\tSM:{sample}"]


def write_sam(records: DataFrame, path: str, header: list[str], mode: str = "error") -> None:
    """Write ``line`` as SAM text parts; each part begins with the header, so that each is a SAM file."""
    head = "\n".join(header) + "\n"

    def with_header(batches):
        first = True
        for pdf in batches:
            if len(pdf):
                pdf = pdf.rename(columns={"line": "value"})[["value"]]
                if first:
                    pdf.loc[pdf.index[0], "value"] = head + pdf["value"].iloc[0]
                    first = False
                yield pdf

    records.select("line").mapInPandas(with_header, "value string").write.mode(mode).text(path)


def read_reads(spark: SparkSession, paths: str | list[str], file_format: str, **options) -> DataFrame:
    """Reads of files of a format: fastq, sam or bam.  CRAM needs an external decoder; FASTA is no format of reads."""
    kind = file_format.lower()
    if kind == "fastq":
        return fastq.read_fastq(spark, paths, **options)
    if kind in ("sam", "bam"):
        for p in files.list_files([paths] if isinstance(paths, str) else list(paths)):
            if files.is_cram(p):
                raise NotImplementedError(f"{p} is a CRAM file; decode it to SAM or BAM first")
        if kind == "sam":
            return read_sam(spark, paths, **options)
        from readloom.sources.bam import read_bam

        return read_bam(spark, paths, **options)
    if kind == "cram":
        raise NotImplementedError("CRAM files must be decoded to SAM or BAM first")
    raise ValueError(f"not implemented for {file_format}")


