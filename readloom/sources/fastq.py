"""FASTQ as a Spark data source, and FASTQ sinks.

``strict``: four lines a record, blank lines between records skipped.  Plain files are split
into byte ranges; each range finds the first record that begins in it, so that a file of any size is read
by many tasks.  ``lenient``: bases and qualities over several lines, number lists as
qualities; split alike, where a range begins with two records of that form.  Compressed files are read by one task each.

A record that breaks the grammar ends its range's reading: as an error (``on_error=raise``, the default) or as a last
row with ``error`` and ``line_no`` (``on_error=row``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.functions.bases import fastq_text
from readloom.functions.names import CASAVA, MAX_NAME
from readloom.sources import files

_SCHEMA = "file string, file_no int, chunk_no int, row_no bigint, name string, bases string, plus string, raw_quals string, error string, line_no bigint"
_ARROW = pa.schema([("file", pa.string()), ("file_no", pa.int32()), ("chunk_no", pa.int32()), ("row_no", pa.int64()), *((c, pa.string()) for c in ("name", "bases", "plus", "raw_quals", "error")), ("line_no", pa.int64())])
_BAD_BASE = re.compile("[^ACGTNUactgnu.]")
_PRINTABLE = re.compile("[!-~]*")
_NUMBERS = re.compile(r"-?[0-9]{1,3}(?: +-?[0-9]{1,3})*[ -]*")
_CASAVA_LINE = re.compile("@" + CASAVA[1:])
SPLIT_BYTES = 64 << 20


class FastqError(ValueError):
    """A broken record, with the number of the line at which that shows."""

    def __init__(self, message: str, line_no: int):
        super().__init__(f"line {line_no}: {message}")
        self.message, self.line_no = message, line_no


Record = tuple[str, str, str, str]


def strict_records(lines: Iterator[str]) -> Iterator[Record]:
    """Records of four lines."""
    n = 0

    def following(what: str) -> str:
        nonlocal n
        line = next(lines, None)
        n += 1
        if line is None:
            raise FastqError(f"file ends before the {what}", n)
        return line.rstrip("\r\n")

    for raw in lines:
        n += 1
        head = raw.rstrip("\r\n")
        if not head.strip():
            continue
        if not head.startswith("@"):
            raise FastqError("the name line doesn't begin with @", n)
        bases, plus, quals = following("bases"), None, None
        plus = following("+ line")
        if not plus.startswith("+"):
            raise FastqError("the third line doesn't begin with +", n)
        quals = following("qualities")
        if len(bases) != len(quals):
            raise FastqError("bases and qualities differ in length", n)
        yield head[1:], bases, plus[1:], quals


def lenient_records(lines: Iterator[str], expected_length: int | None = None, casava: bool | None = None, more: Callable[[], bool] = lambda: True) -> Iterator[Record]:
    """Records whose bases and qualities may go over several lines; a record cut by the file's end is dropped.

    ``casava``: the form of the file's names, else that of the first; ``more``: whether a further record is wanted.
    """
    n = 0

    def following() -> str | None:
        nonlocal n
        line = next(lines, None)
        n += line is not None
        return None if line is None else line.rstrip("\r\n")

    while more() and (head := following()) is not None:
        if not head.strip():
            continue
        if len(head.strip()) > MAX_NAME + 1:
            raise FastqError("the name is too long", n)
        if casava is None:
            casava = bool(_CASAVA_LINE.match(head))
        if not (_CASAVA_LINE.match(head) if casava else head.startswith("@")):
            raise FastqError("the name line doesn't have the file's form", n)
        parts, plus = [], None
        while plus is None:
            line = following()
            if line is None:
                return
            before, found, after = line.rstrip(" ").partition("+")
            parts.append(before.replace("\r", "").rstrip(" "))
            plus = after if found else None
        bases = "".join(parts)
        if bad := sorted(set(_BAD_BASE.findall(bases))):
            raise FastqError(f"bases hold {''.join(bad)!r}", n)
        if expected_length is not None and len(bases) != expected_length:
            raise FastqError(f"{len(bases)} bases instead of {expected_length}", n)
        quals, rest = "", ""
        while len(quals) < len(bases):
            line = following()
            if line is None:
                return
            room = len(bases) - len(quals)
            if not _PRINTABLE.fullmatch(line[:room]) and _NUMBERS.fullmatch(line.strip()):
                scores = [int(x) for x in line.split() if x.strip("-")]
                if len(quals) or len(scores) != len(bases):
                    raise FastqError(f"{len(scores)} scores for {len(bases)} bases", n)
                quals = "".join(chr(x + 33) for x in scores)
                break
            quals, rest = quals + line[:room], line[room:]
            if not _PRINTABLE.fullmatch(quals):
                raise FastqError("qualities hold characters that can't be printed", n)
        if rest.strip():
            raise FastqError("extra characters after the qualities", n)
        yield head[1:], bases, plus, quals


def _first_record(lines: list[bytes]) -> int | None:
    """Index of the first line that begins a record, among lines from the midst of a file."""
    for i in range(len(lines) - 3):
        a, b, c, d = (x.rstrip(b"\r\n") for x in lines[i : i + 4])
        if a.startswith(b"@") and c.startswith(b"+") and len(b) == len(d):
            return i
    return None


def range_lines(path: str, start: int, end: int) -> Iterator[str]:
    """Lines of the strict records that begin in a byte range of a plain file."""
    with files.open_raw(path) as f:
        f.seek(max(0, start - 1))
        at = max(0, start - 1)
        if start:
            at += len(f.readline())
        ahead: list[bytes] = []
        if start:
            ahead = [line for line in (f.readline() for _ in range(12)) if line]
            first = _first_record([x for x in ahead])
            if first is None:
                return
            at += sum(map(len, ahead[:first]))
            ahead = ahead[first:]
        slot = 0
        while True:
            line = ahead.pop(0) if ahead else f.readline()
            if not line or (slot == 0 and at >= end):
                return
            at += len(line)
            yield line.decode("utf-8", "replace")
            if slot or line.strip():
                slot = (slot + 1) % 4


def _parses(lines: list[bytes], ended: bool, casava: bool) -> bool | None:
    """Whether lines begin with two lenient records, or with one that ends the file; None where more lines must tell."""
    text = iter([x.decode("utf-8", "replace") for x in lines])
    n = 0
    try:
        for n, _ in enumerate(lenient_records(text, None, casava), 1):
            if n == 2:
                return True
    except FastqError:
        return False
    return n == 1 if ended else None


def lenient_range(path: str, start: int, end: int, casava: bool, expected_length: int | None = None) -> Iterator[Record]:
    """Lenient records that begin in a byte range of a plain file."""
    with files.open_raw(path) as f:
        f.seek(max(0, start - 1))
        at, ahead, ended = max(0, start - 1), [], False
        if start:
            at += len(f.readline())
            while True:  # lines are taken until one of those in the range begins a record, or the range ends
                more = [x for x in (f.readline() for _ in range(64)) if x]
                ahead += more
                ended = len(more) < 64
                begins, place = [], at
                for i, x in enumerate(ahead):
                    if place >= end:
                        break
                    if x.startswith(b"@"):
                        begins.append(i)
                    place += len(x)
                told = {i: _parses(ahead[i:], ended, casava) for i in begins}
                found = next((i for i in begins if told[i] is not False), None)
                if found is not None and told[found]:
                    break
                if found is None and (ended or place >= end):
                    return  # no record begins in the range
            at += sum(map(len, ahead[:found]))
            ahead = ahead[found:][::-1]

        def lines() -> Iterator[str]:
            nonlocal at
            while line := ahead.pop() if ahead else f.readline():
                at += len(line)
                yield line.decode("utf-8", "replace")

        yield from lenient_records(lines(), expected_length, casava, lambda: at < end)


class _Part(InputPartition):
    def __init__(self, path: str, file_no: int, chunk_no: int, start: int, end: int, whole: bool):
        self.path, self.file_no, self.chunk_no, self.start, self.end, self.whole = path, file_no, chunk_no, start, end, whole


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        parts = []
        for k, path in enumerate(files.list_files(files.unpacked(self.options["path"])), 1):
            ranges = files.chunks(path, split)
            parts += [_Part(path, k, i, a, b, len(ranges) == 1) for i, (a, b) in enumerate(ranges)]
        return parts

    def read(self, part):
        return files.batches(self._rows(part), _ARROW)

    def _rows(self, part):
        limit = int(self.options.get("maxreadsperfile", 0))
        lenient = self.options.get("mode", "strict") == "lenient"
        length = int(self.options["expectedlength"]) if self.options.get("expectedlength") else None
        if part.whole:
            opener = files.open_named if self.options.get("compression") == "extension" else files.open_content
            lines = (line.decode("utf-8", "replace") for line in opener(part.path))
        elif not lenient:
            lines = range_lines(part.path, part.start, part.end)
        if lenient and not part.whole:
            with files.open_raw(part.path) as f:
                first = next((x for x in f if x.strip()), b"").decode("utf-8", "replace").rstrip("\r\n")
            records = lenient_range(part.path, part.start, part.end, bool(_CASAVA_LINE.match(first)), length)
        else:
            records = lenient_records(lines, length) if lenient else strict_records(lines)
        n = 0
        try:
            for n, record in enumerate(records, 1):
                if limit and n > limit:
                    return
                yield (part.path, part.file_no, part.chunk_no, n, *record, None, None)
        except FastqError as e:
            if self.options.get("on_error", "raise") == "raise":
                raise
            yield (part.path, part.file_no, part.chunk_no, n + 1, None, None, None, None, e.message, e.line_no)


class FastqDataSource(DataSource):
    """``spark.read.format("fastq")``; options path, mode, splitBytes, maxReadsPerFile, compression, expectedLength, on_error."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_fastq(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Reads of FASTQ files with ``file_no`` in the order given and the 1-based ``read_no`` in the file.

    Ranges of one file are numbered on from one another by the counts of the ranges before.
    An empty file gives no rows.
    """
    spark.dataSource.register(FastqDataSource)
    joined = files.packed(paths)
    rows = spark.read.format("fastq").options(**{k: str(v) for k, v in options.items()}).load(joined)
    columns = ["file", "file_no", "read_no", "name", "bases", "plus", "raw_quals", "error", "line_no"]
    split = int(options.get("splitBytes", SPLIT_BYTES))
    sizes = [len(files.chunks(p, split)) for p in files.list_files(files.unpacked(joined))]
    if max(sizes, default=1) == 1:
        return rows.withColumnRenamed("row_no", "read_no").select(*columns)
    counts = rows.groupBy("file_no", "chunk_no").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_no").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file_no", "chunk_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(offsets, ["file_no", "chunk_no"]).withColumn("read_no", F.col("row_no") + F.col("before")).select(*columns)


def write_fastq(reads: DataFrame, path: str, compression: str | None = None, mode: str = "error") -> None:
    """Write ``name``, ``bases``, ``quals`` (in the rows' order) as FASTQ parts in a folder."""
    writer = reads.select(fastq_text(F.col("name"), F.col("bases"), F.col("quals")).alias("value")).write.mode(mode)
    (writer.option("compression", compression) if compression else writer).text(path)


def write_fastq_split(reads: DataFrame, path: str, compression: str | None = None, mode: str = "error") -> None:
    """Three-way split by ``segment_index`` (0 unpaired, 1, 2): folders ``segment_index=i``; empty ones aren't written."""
    writer = reads.select("segment_index", fastq_text(F.col("name"), F.col("bases"), F.col("quals")).alias("value")).write.mode(mode).partitionBy("segment_index")
    (writer.option("compression", compression) if compression else writer).text(path)


def merge_split(path: str, base: str, gzipped: bool = False) -> list[str]:
    """Join the parts of a three-way split on this machine into ``base.fastq``, ``base_1.fastq``, ``base_2.fastq`` (``.gz``); files without reads aren't made."""
    import glob
    import gzip as gz
    import shutil

    made = []
    for i, suffix in enumerate(("", "_1", "_2")):
        parts = [p for p in sorted(glob.glob(f"{path}/segment_index={i}/part-*"))]
        if not parts:
            continue
        target = f"{base}{suffix}.fastq" + (".gz" if gzipped else "")
        with (gz.open(target, "wb") if gzipped else open(target, "wb")) as out:
            for p in parts:
                with files.open_content(p) as f:
                    shutil.copyfileobj(f, out)
        made.append(target)
    return made


def orphan_path(first: str, second: str) -> str:
    """Where orphans go: the common stem of ``stem_1.ext`` and ``stem_2.ext``, else ``first.orphans``."""
    pattern = r"(.*)_{}(\.fastq\.gz|\.fq\.gz|\.fastq|\.fq)"
    a, b = re.fullmatch(pattern.format(1), first), re.fullmatch(pattern.format(2), second)
    return a.group(1) + a.group(2) if a and b and a.group(1) == b.group(1) else first + ".orphans"
