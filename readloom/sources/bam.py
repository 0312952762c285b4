"""BAM: source and sink.  Blocks are gzip members; records follow the published layout."""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from readloom.schema import SAM
from readloom.sources import files

# Letters of packed bases and CIGAR operations, and the empty block that ends a file.
_BASES = "=ACMGRSVTWYHKDBN"
_CIGAR = "MIDNSHP=X"
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_INTEGERS = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I", b"f": "<f"}
_PAIRS = [a + b for a in _BASES for b in _BASES]


def _tags(data: bytes) -> dict[str, str]:
    """Tags of a record; values as SAM text has them."""
    out: dict[str, str] = {}
    i = 0
    while i + 3 <= len(data):
        tag, kind = data[i : i + 2].decode(), data[i + 2 : i + 3]
        i += 3
        if kind == b"A":
            value, i = chr(data[i]), i + 1
        elif kind in b"ZH":
            end = data.index(0, i)
            value, i = data[i:end].decode("utf-8", "replace"), end + 1
        elif kind == b"B":
            sub, n = data[i : i + 1], struct.unpack_from("<I", data, i + 1)[0]
            form, i = _INTEGERS[sub], i + 5
            size = struct.calcsize(form)
            value = ",".join([sub.decode(), *(f"{struct.unpack_from(form, data, i + k * size)[0]:g}" if sub == b"f" else str(struct.unpack_from(form, data, i + k * size)[0]) for k in range(n))])
            i += n * size
        else:
            form = _INTEGERS[kind]
            x = struct.unpack_from(form, data, i)[0]
            value, i = (f"{x:g}" if kind == b"f" else str(x)), i + struct.calcsize(form)
        out.setdefault(tag, value)
    return out


def read_records(stream: BinaryIO) -> Iterator[tuple]:
    """Records of an open, decompressed BAM, as SAM columns from qname to tags."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) < n:
            raise EOFError("the BAM ends within a record")
        return data

    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        take(4)
    named = lambda i: names[i] if i >= 0 else "*"
    while head := stream.read(4):
        if len(head) < 4:
            raise EOFError("the BAM ends within a record")
        data = take(struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flags, n, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        qname, at = data[at : at + l_name - 1].decode(), at + l_name
        ops, at = struct.unpack_from(f"<{n_cigar}I", data, at), at + 4 * n_cigar
        cigar = "".join(f"{o >> 4}{_CIGAR[o & 15]}" for o in ops) or "*"
        packed, at = data[at : at + (n + 1) // 2], at + (n + 1) // 2
        bases = "".join(map(_PAIRS.__getitem__, packed))[:n] or "*"
        raw, at = data[at : at + n], at + n
        quals = "*" if not n or raw[0] == 255 else (np.frombuffer(raw, np.uint8) + 33).tobytes().decode("latin-1")
        mate = "=" if next_ref == ref and ref >= 0 else named(next_ref)
        yield qname, flags, named(ref), pos + 1, str(mapq), cigar, mate, next_pos + 1, tlen, bases, quals, _tags(data[at:])


def _record(row: dict) -> bytes:
    """An unaligned record."""
    bases = "" if row["bases"] in (None, "*") else row["bases"].upper()
    codes = np.array([_BASES.find(b) for b in bases] + [0] * (len(bases) % 2), np.int16)
    codes[codes < 0] = 15
    packed = ((codes[::2] << 4) | codes[1::2]).astype(np.uint8).tobytes()
    quals = b"\xff" * len(bases) if row["quals"] in (None, "*") or not bases else bytes(ord(c) - 33 for c in row["quals"])
    name = row["qname"].encode() + b"\0"
    tags = b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in (("BC", row.get("barcode")), ("RG", "A")) if v)
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name), 0, 4680, 0, row["flags"], len(bases), -1, -1, 0) + name + packed + quals + tags
    return struct.pack("<i", len(body)) + body


def _block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_file(path: str, rows: Iterator[dict], sample: str, sorted_by_name: bool = False) -> int:
    """Write unaligned records as one BAM; gives their number."""
    from readloom.sources.sam import header_lines

    text = ("\n".join(header_lines(sample, sorted_by_name)) + "\n").encode()
    pending, n = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 0), 0
    system, inner = files.filesystem(path)
    with system.open_output_stream(inner) as out:
        for row in rows:
            pending += _record(row)
            n += 1
            while len(pending) >= 60_000:
                out.write(_block(pending[:60_000]))
                pending = pending[60_000:]
        if pending:
            out.write(_block(pending))
        out.write(_END)
    return n


_ARROW = pa.schema(
    [("file", pa.string()), ("record_no", pa.int64()), ("qname", pa.string()), ("flags", pa.int32()), ("rname", pa.string()), ("pos", pa.int32()), ("mapq", pa.string()), ("cigar", pa.string()), ("rnext", pa.string())]
    + [("pnext", pa.int32()), ("tlen", pa.int32()), ("bases", pa.string()), ("quals", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]
)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Part(p) for p in files.list_files(files.unpacked(self.path))]

    def read(self, part):
        return files.batches(self._rows(part), _ARROW)

    def _rows(self, part):
        if files.is_cram(part.path):
            raise NotImplementedError(f"{part.path} is a CRAM file; decode it to SAM or BAM first")
        with gzip.GzipFile(fileobj=files.open_raw(part.path)) as stream:
            for n, record in enumerate(read_records(stream), 1):
                yield (part.path, n, *record)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, sample: str, names: list[str], sorted_by_name: bool):
        self.path, self.sample, self.names, self.sorted_by_name = path, sample, names, sorted_by_name

    def write(self, rows):
        # parts in the order of their partitions
        target = f"{self.path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
        system, inner = files.filesystem(self.path)
        system.create_dir(inner, recursive=True)
        n = write_file(target, (dict(zip(self.names, r)) for r in rows), self.sample, self.sorted_by_name)
        if not n:
            system.delete_file(files.filesystem(target)[1])
        return WriterCommitMessage()


class BamDataSource(DataSource):
    """``format("bam")``: reads files whole, one task each; writes one BAM per partition (options sample and sorted)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SAM

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options["sample"], schema.fieldNames(), self.options.get("sorted") == "true")


def read_bam(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    spark.dataSource.register(BamDataSource)
    return spark.read.format("bam").load(files.packed(paths))


def write_bam(records: DataFrame, path: str, sample: str, sorted_by_name: bool = False) -> None:
    """Write ``qname, flags, bases, quals, barcode`` as unaligned BAM parts in a new folder; ``sorted_by_name``: sorted, over all parts, and marked so."""
    if not sample or not sample.strip():
        raise ValueError("the sample has no name")
    records.sparkSession.dataSource.register(BamDataSource)
    rows = records.select("qname", "flags", "bases", "quals", "barcode")
    rows = rows.orderBy("qname", "flags") if sorted_by_name else rows
    rows.write.format("bam").option("sample", sample).option("sorted", str(sorted_by_name).lower()).mode("append").save(path)


