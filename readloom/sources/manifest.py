"""Manifests: which files a submission has and how they are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_files(manifest: DataFrame, base: str | None = None) -> DataFrame:
    """Manifest rows with ``file_type`` in lower case, ``path`` (relative ones below ``base``), ``scoring`` (phred, log_odds)
    and ``ascii_offset`` (FROM33, FROM64), the last two for FASTQ files only."""
    kind = F.lower(F.trim("file_type"))
    q = F.when(kind == "fastq", F.col("quality_score"))
    path = F.col("file") if base is None else F.when(F.col("file").rlike(r"^(/|[A-Za-z]+:)"), F.col("file")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.col("file")))
    return manifest.withColumns({
        "file_type": kind, "path": path,
        "scoring": F.when(q.isin("PHRED_33", "PHRED_64"), "phred").when(q == "LOGODDS", "log_odds"),
        "ascii_offset": F.when(q == "PHRED_33", "FROM33").when(q == "PHRED_64", "FROM64"),
    })


def submission_format(manifest: DataFrame) -> str:
    """The format that governs a submission: that of its first file; FASTA and unknown ones are errors."""
    first = raw_files(manifest).orderBy("file_id").select("file_type").first()
    if first is None:
        raise ValueError("No file provided.")
    if first.file_type not in ("fastq", "bam", "cram", "sam"):
        raise ValueError(f"not implemented for {first.file_type}")
    return first.file_type
