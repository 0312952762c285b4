"""Reference sequences: lookup by MD5, confirmation of the sequences a file names, regions.

Fetchers are functions of the caller (a service, a folder): ``fetch(md5) -> bases or None``.  They run in the workers
on distinct checksums, so that a sequence is asked for once however many records name it.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import bases as B
from readloom.functions import regions


class MissingReference(RuntimeError):
    """A reference sequence that can't be had."""


def sq_lines(headers: DataFrame) -> DataFrame:
    """``(line_no, sn, ln, m5, ur)`` of the @SQ lines; checksums lower-cased, blank ones null; a repeated name keeps its first line."""
    tag = lambda t: F.nullif(F.trim(F.try_element_at("tags", F.lit(t))), F.lit(""))
    rows = headers.where(F.col("record") == "SQ").select("line_no", tag("SN").alias("sn"), tag("LN").try_cast("bigint").alias("ln"), F.lower(tag("M5")).alias("m5"), tag("UR").alias("ur"))
    named = rows.where("sn is not null").groupBy("sn").agg(F.min(F.struct("line_no", "ln", "m5", "ur")).alias("s"))
    return named.select("s.line_no", "sn", "s.ln", "s.m5", "s.ur")


def sample_of(headers: DataFrame) -> DataFrame:
    """``(line_no, id, sm)`` of the @RG lines; a blank sample is null."""
    tag = lambda t: F.nullif(F.trim(F.try_element_at("tags", F.lit(t))), F.lit(""))
    return headers.where(F.col("record") == "RG").select("line_no", tag("ID").alias("id"), tag("SM").alias("sm"))


def missing_checksums(sq: DataFrame) -> DataFrame:
    """``(line_no, sn)`` of sequences without an MD5."""
    return sq.where("m5 is null").select("line_no", "sn")


def lookup(md5s: DataFrame, fetch: Callable[[str], str | None], tries: int = 4, wait: float = 0.0) -> DataFrame:
    """``(m5, bases)`` of the distinct checksums of the first column; null where none of the tries gives the sequence with that MD5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for m5 in pdf["m5"]:
                value = None
                for attempt in range(tries):
                    try:
                        value = fetch(m5)
                    except Exception:
                        value = None
                    if value is not None and hashlib.md5(value.encode()).hexdigest() == m5:
                        break
                    value = None
                    if wait and attempt + 1 < tries:
                        time.sleep(wait * 2**attempt)
                found.append(value)
            yield pd.DataFrame({"m5": pdf["m5"], "bases": pd.Series(found, dtype=object)})

    return md5s.toDF("m5").where("m5 is not null").distinct().mapInPandas(run, "m5 string, bases string")


def confirm(sq: DataFrame, known: DataFrame) -> DataFrame:
    """``(m5, found)``: whether each distinct checksum is among ``known`` (first column)."""
    have = known.toDF("m5").select(F.lower("m5").alias("m5")).distinct().withColumn("found", F.lit(True))
    return sq.where("m5 is not null").select("m5").distinct().join(have, "m5", "left").select("m5", F.coalesce("found", F.lit(False)).alias("found"))


def resolve(sq: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """``(sn, m5, bases, tier)``: the first of several stores ``(m5, bases)`` that has a sequence; tier 0 is the first, null none."""
    out = sq.select("sn", "m5")
    for i, t in enumerate(tiers):
        one = t.where("m5 is not null").groupBy(F.lower("m5").alias("m5")).agg(F.first("bases").alias(f"_b{i}"))
        out = out.join(one, "m5", "left")
    bases = F.coalesce(*(F.col(f"_b{i}") for i in range(len(tiers))))
    tier = F.coalesce(*(F.when(F.col(f"_b{i}").isNotNull(), i) for i in range(len(tiers))))
    return out.select("sn", "m5", F.upper(bases).alias("bases"), tier.alias("tier"))


def check_md5(sq: DataFrame, sequences: DataFrame) -> DataFrame:
    """``(sn, m5, computed, verdict)``: filled (no MD5 given), equal, differs, or no_sequence."""
    have = sequences.select("sn", B.sequence_md5(F.upper("bases")).alias("computed")).dropDuplicates(["sn"])
    verdict = F.when(F.col("computed").isNull(), "no_sequence").when(F.col("m5").isNull(), "filled").when(F.col("m5") == F.col("computed"), "equal").otherwise("differs")
    return sq.join(have, "sn", "left").select("sn", F.coalesce("m5", "computed").alias("m5"), "computed", verdict.alias("verdict"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA index: ``(contig, size, offset, line_bases, line_bytes)``."""
    return spark.read.csv(path, sep="\t", schema="contig string, size bigint, offset bigint, line_bases int, line_bytes int")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, bases)``; one task reads a file, a contig is a row."""
    from readloom.sources import files

    listed = spark.createDataFrame([(p,) for p in files.list_files([path])], "file string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["file"]:
                name, parts = None, []
                for raw in files.open_content(p):
                    line = raw.decode().rstrip("\r\n")
                    if line.startswith(">"):
                        if name is not None:
                            yield pd.DataFrame({"contig": [name], "bases": ["".join(parts)]})
                        name, parts = line[1:].split()[0] if line[1:].split() else "", []
                    else:
                        parts.append(line.strip())
                if name is not None:
                    yield pd.DataFrame({"contig": [name], "bases": ["".join(parts)]})

    return listed.mapInPandas(run, "contig string, bases string")


def fasta_region(path: str, fai_path: str, contig: str, start: int, stop: int) -> str:
    """Bases start to stop (1-based, inclusive) of a contig, reading only the bytes needed."""
    from readloom.sources import files

    with files.open_raw(fai_path) as f:
        rows = {r[0]: tuple(map(int, r[1:5])) for r in (x.split("\t") for x in f.read().decode().splitlines()) if len(r) >= 5}
    if contig not in rows:
        raise KeyError(contig)
    size, offset, per_line, line_bytes = rows[contig]
    if start > stop + 1 or stop > size or start < 1:
        raise ValueError(f"{contig}:{start}-{stop} is outside of the sequence")
    place = lambda i: offset + i // per_line * line_bytes + i % per_line
    with files.open_raw(path) as f:
        f.seek(place(start - 1))
        data = f.read(place(stop - 1) - place(start - 1) + 1) if stop >= start else b""
    return data.replace(b"\r", b"").replace(b"\n", b"").decode()


class Store:
    """Sequences by MD5: memory, then a folder, then a fetcher; what is fetched is checked and kept in the folder."""

    def __init__(self, folder: str | None = None, pattern: str = "%2s/%2s/%s", fetch: Callable[[str], bytes | None] | None = None, tries: int = 3, wait: float = 1.0):
        self.folder, self.pattern, self.fetch, self.tries, self.wait = folder, pattern, fetch, tries, wait
        self.memory: dict[str, bytes] = {}
        self.hits = {"memory": 0, "disk": 0, "remote": 0}

    def _path(self, md5: str) -> str | None:
        return os.path.join(self.folder, regions.format_path(self.pattern, md5)) if self.folder else None

    def get(self, md5: str | None, fallback: Callable[[], bytes | None] | None = None) -> bytes | None:
        """The bases with an MD5, or None; a file that isn't what its name says is deleted."""
        if not md5:
            return None
        if md5 in self.memory:
            self.hits["memory"] += 1
            return self.memory[md5]
        path = self._path(md5)
        if path and os.path.exists(path):
            with open(path, "rb") as f:
                data = f.read()
            if hashlib.md5(data).hexdigest() == md5:
                self.hits["disk"] += 1
                self.memory[md5] = data
                return data
            os.remove(path)
        for attempt in range(self.tries if self.fetch else 0):
            try:
                data = self.fetch(md5)
            except OSError:
                data = None
            if data and hashlib.md5(data).hexdigest() == md5:
                self.hits["remote"] += 1
                self.memory[md5] = data
                if path:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path))
                    with os.fdopen(fd, "wb") as f:
                        f.write(data)
                    os.replace(tmp, path)
                return data
            if attempt + 1 < self.tries:
                time.sleep(min(8.0, self.wait * 2**attempt))
        if fallback:
            try:
                data = fallback()
                return data.upper() if data else None
            except Exception:
                return None
        return None


def cache_folder(environment: dict[str, str] | None = None) -> str:
    """Where sequences are kept: REF_CACHE, else XDG_CACHE_HOME, else the home folder, else the temporary one."""
    env = os.environ if environment is None else environment
    if env.get("REF_CACHE"):
        return env["REF_CACHE"]
    for variable, below in (("XDG_CACHE_HOME", "hts-ref"), ("HOME", ".cache/hts-ref")):
        if env.get(variable):
            return os.path.join(env[variable], below)
    return os.path.join(tempfile.gettempdir(), "hts-ref")


def parse_metadata(replies: DataFrame, column: str = "reply") -> DataFrame:
    """``(id, md5)`` of JSON replies ``{"metadata": {"id": ..., "md5": ...}}``; nulls where a reply has none."""
    m = F.from_json(F.col(column), "metadata struct<id: string, md5: string>")
    return replies.select(m["metadata"]["id"].alias("id"), m["metadata"]["md5"].alias("md5"))
