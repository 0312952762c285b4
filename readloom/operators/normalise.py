"""Normalised FASTQ: U to T, Phred + 33 qualities, output names, three-way output.

Defined cases: as in ``pairing``; null bases or qualities stay null and count no bases; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import bases as B
from readloom.functions import names
from readloom.functions import quality as Q
from readloom.operators import pairing


def detect(reads: DataFrame, by: tuple[str, ...] = (), sample_reads: int | None = None) -> DataFrame:
    """``(by..., lowest, encoding)`` of ``raw_quals``; ``sample_reads``: only the first so many reads of each file."""
    rows = reads if sample_reads is None else reads.where(F.col("read_no") <= sample_reads)
    lowest = F.min(Q.lowest_code(F.col("raw_quals")))
    return rows.groupBy(*by).agg(lowest.alias("lowest")).withColumn("encoding", Q.detect_encoding(F.col("lowest")))


def normalised_reads(reads: DataFrame, encoding: Column | str = "Standard", uracil: bool = True) -> DataFrame:
    """Replace ``bases`` (U to T) and add ``quals`` from ``raw_quals`` of an encoding."""
    out = reads.withColumn("quals", Q.normalise(F.col("raw_quals"), encoding))
    return out.withColumn("bases", B.replace_uracil(F.col("bases"))) if uracil else out


def normalise_single(reads: DataFrame, prefix: str | None = None) -> DataFrame:
    """Add ``output_name``, numbered by ``read_no`` where there is a prefix."""
    return reads.withColumn("output_name", names.numbered(F.col("name"), prefix, F.col("read_no")))


def single_counts(reads: DataFrame) -> DataFrame:
    """``(n_reads, n_bases)``."""
    return reads.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum(F.length("bases")), F.lit(0)).cast("bigint").alias("n_bases"))


def normalise_paired(reads: DataFrame, by: tuple[str, ...] = (), prefix: str | None = None, on_bad_name: str = "error") -> DataFrame:
    """``(by..., read_key, counter, slot, output_name, bases, quals)``: slot 1 and 2 of pairs, 0 for orphans.

    Pairs and orphans share one counter, in order of ``by`` and key.
    """
    assembled = pairing.assemble(reads, by, on_bad_name)
    counted = pairing.numbered(assembled, [*by, "read_key"])
    both = F.col("reverse").isNotNull()
    casava = names.is_casava(F.col("forward.name"))
    one = lambda r, slot, name: F.struct(F.lit(slot).alias("slot"), name.alias("name"), F.col(f"{r}.bases").alias("bases"), F.col(f"{r}.quals").alias("quals"))
    forward = one("forward", 1, names.paired_output_name(F.col("forward.name"), F.col("read_key"), F.lit(1), casava))
    reverse = one("reverse", 2, names.paired_output_name(F.col("reverse.name"), F.col("read_key"), F.lit(2), casava))
    alone = one("forward", 0, names.orphan_output_name(F.col("forward.name"), F.col("read_key"), F.col("forward.number")))
    rows = counted.select(*by, "read_key", "counter", F.explode(F.when(both, F.array(forward, reverse)).otherwise(F.array(alone))).alias("r"))
    return rows.select(*by, "read_key", "counter", "r.slot", names.numbered(F.col("r.name"), prefix, F.col("counter")).alias("output_name"), "r.bases", "r.quals")
