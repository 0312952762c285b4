"""Opening files by content or by extension, and splitting plain ones."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def packed(paths: str | list[str]) -> str:
    """Paths as one option of a data source, whatever characters they hold."""
    return json.dumps([paths] if isinstance(paths, str) else list(paths))


def unpacked(option: str) -> list[str]:
    """The paths of an option; text that isn't a list is one path."""
    if option.startswith("["):
        try:
            found = json.loads(option)
        except ValueError:
            return [option]
        if all(isinstance(p, str) for p in found):
            return found
    return [option]


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, so that they reach Spark without being turned one by one."""
    rows = iter(rows)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def exists(path: str) -> bool:
    system, inner = filesystem(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def list_files(paths: list[str]) -> list[str]:
    """Files of paths; a folder stands for its files, by name, without hidden ones."""
    out = []
    for path in paths:
        system, inner = filesystem(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith((".", "_")))
            out += [path.rstrip("/") + f[len(inner.rstrip("/")) :] for f in found]
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        else:
            out.append(path)
    return out


def open_raw(path: str) -> BinaryIO:
    system, inner = filesystem(path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def size_of(path: str) -> int:
    system, inner = filesystem(path)
    return system.get_file_info(inner).size


def sniff(path: str) -> str:
    """gzip, bzip2, cram, bam, zip or plain, from the first bytes; plain for short files."""
    with open_raw(path) as f:
        head = f.read(4)
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:3] == b"BZh":
        return "bzip2"
    if head == b"CRAM":
        return "cram"
    if head == b"PK\x03\x04":
        return "zip"
    return "plain"


def is_cram(path: str) -> bool:
    """Whether a file begins as a CRAM; false for short, missing and unreadable files."""
    try:
        return sniff(path) == "cram"
    except OSError:
        return False


def open_content(path: str) -> BinaryIO:
    """The file, decompressed by what its content says (concatenated members too)."""
    kind = sniff(path)
    raw = open_raw(path)
    if kind == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if kind == "bzip2":
        return bz2.BZ2File(raw)
    return raw


def open_named(path: str) -> BinaryIO:
    """The file, decompressed by its extension: gz, gzip, bz2, zip (first entry), and the first entry of a tar."""
    low = path.lower()
    raw = open_raw(path)
    if low.endswith((".bgz", ".bgzip")):
        raise NotImplementedError("block gzip by extension")
    if low.endswith((".gz", ".gzip")):
        stream: BinaryIO = gzip.GzipFile(fileobj=raw)
    elif low.endswith(".bz2"):
        stream = bz2.BZ2File(raw)
    elif low.endswith(".zip"):
        archive = zipfile.ZipFile(raw)
        names = [n for n in archive.namelist() if not n.endswith("/")]
        stream = archive.open(names[0]) if names else io.BytesIO()
    else:
        stream = raw
    if ".tar" in low:
        archive_tar = tarfile.open(fileobj=stream, mode="r|")
        for member in archive_tar:
            if member.isfile():
                return archive_tar.extractfile(member)  # type: ignore[return-value]
        return io.BytesIO()
    return stream


def chunks(path: str, split_bytes: int) -> list[tuple[int, int]]:
    """Byte ranges of a file; one for whatever can't be split."""
    n = size_of(path)
    if sniff(path) != "plain" or n <= split_bytes:
        return [(0, n)]
    return [(i, min(n, i + split_bytes)) for i in range(0, n, split_bytes)]
