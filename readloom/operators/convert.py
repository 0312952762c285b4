"""Conversions between SAM and FASTQ, and checks over SAM records.

SAM inputs hold ``record_no, qname, flags, bases, quals``; null flags count as 0, null bases and qualities
as ``*``.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import bases as B
from readloom.functions import names
from readloom.functions import sam as S
from readloom.operators import pairing
from readloom.sources.sam import sam_line

#: Fixed value: bases a SAM record may hold; u and U only where they become T.
SAM_BASES = r"\A[.acmgrsvtwyhkdbnACMGRSVTWYHKDBN]+\z"


def record_counters(records: DataFrame) -> DataFrame:
    """``(total, skipped_secondary, skipped_qc, n_reads, n_bases)``: secondary and supplementary records first, then failed ones."""
    flags = F.coalesce("flags", F.lit(0))
    secondary, failed = S.is_not_primary(flags), S.has(flags, S.QC_FAIL)
    kept = ~secondary & ~failed
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))
    size = F.when(kept, F.length(S.blank_star(F.coalesce("bases", F.lit("*"))))).otherwise(0)
    return records.agg(F.count("*").alias("total"), n(secondary).alias("skipped_secondary"), n(~secondary & failed).alias("skipped_qc"), n(kept).alias("n_reads"), n(size).alias("n_bases"))


def primary_reads(records: DataFrame, reverse: bool = True) -> DataFrame:
    """Records to write as reads: no secondary, supplementary or failed ones; those on the reverse strand turned back; ``segment_index`` added."""
    flags = F.coalesce("flags", F.lit(0))
    rows = records.where(~S.is_not_primary(flags) & ~S.has(flags, S.QC_FAIL)).withColumn("flags", flags)
    rows = rows.withColumn("bases", S.blank_star(F.coalesce("bases", F.lit("*")))).withColumn("quals", F.coalesce("quals", F.lit("*")))
    turned = S.has(F.col("flags"), S.REVERSE) if reverse else F.lit(False)
    bases = F.when(turned, B.reverse_complement(F.col("bases"))).otherwise(F.col("bases"))
    quals = F.when(F.col("quals") == "*", F.repeat(F.lit("!"), F.length("bases"))).when(turned, F.reverse("quals")).otherwise(F.col("quals"))
    return rows.withColumn("_b", bases).withColumn("quals", quals).drop("bases").withColumnRenamed("_b", "bases").withColumn("segment_index", S.segment_index(F.col("flags")))


def sam_to_fastq(records: DataFrame, prefix: str | None = None, reverse: bool = True, split: bool = True, max_records: int | None = None) -> DataFrame:
    """``(record_no, segment_index, name, bases, quals)`` of the output reads.

    With ``split`` records of equal name are paired; the first and second of a pair go to the outputs 1 and 2 with
    ``/1`` and ``/2`` after their names, the others to the output 0.  With a ``prefix``, names become
    ``prefix.counter name``: pairs are counted where their second record stands, single reads where they stand, and paired
    reads left without a mate last, by name.  ``max_records``: only the first so many records.
    """
    rows = primary_reads(records if max_records is None else records.where(F.col("record_no") <= max_records), reverse)
    if not split:
        named = names.numbered(F.col("qname"), prefix, F.col("counter")) if prefix is not None else F.col("qname")
        rows = pairing.numbered(rows, ["record_no"]) if prefix is not None else rows
        return rows.select("record_no", F.lit(0).alias("segment_index"), named.alias("name"), "bases", "quals")
    of_pair = rows.where("segment_index > 0")
    matched = pairing.pair_by_name(of_pair)
    single = rows.where("segment_index = 0").withColumn("pair_no", F.lit(0).cast("bigint")).withColumn("slot", F.lit(0))
    every = matched.unionByName(single)
    # of a pair the record with the lower segment is first; equal ones in their order
    keys = every.groupBy("qname", "pair_no", (F.col("segment_index") == 0).alias("alone"), F.when(F.col("segment_index") == 0, F.col("record_no")).alias("own")).agg(
        F.max("record_no").alias("last_no"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("segment_index", "record_no", "bases", "quals"))).alias("reads")
    )  # a pair at most
    late = (F.col("n") == 1) & ~F.col("alone")
    units = keys.withColumn("late", late.cast("int")).withColumn("last_key", F.when(late, F.col("qname")).otherwise("")).withColumn("at", F.when(late, F.lit(0)).otherwise(F.col("last_no")))
    units = pairing.numbered(units, ["late", "at", "last_key", "last_no"]) if prefix is not None else units.withColumn("counter", F.lit(0))
    out = units.select("qname", "counter", "n", F.posexplode("reads").alias("k", "r"))
    slot = F.when(F.col("n") == 2, F.col("k") + 1).otherwise(0)
    base = names.numbered(F.col("qname"), prefix, F.col("counter"))
    return out.select("r.record_no", slot.alias("segment_index"), F.when(slot > 0, F.concat(base, F.lit("/"), slot.cast("string"))).otherwise(base).alias("name"), "r.bases", "r.quals")


def first_reverse_read(records: DataFrame) -> DataFrame:
    """``(record_no, flags, qname, bases, quals)`` of the first primary record on the reverse strand; one row at most."""
    flags = F.coalesce("flags", F.lit(0))
    hits = records.where(~S.is_not_primary(flags) & ~S.has(flags, S.QC_FAIL) & S.has(flags, S.REVERSE))
    return hits.orderBy("record_no").limit(1).select("record_no", "flags", "qname", "bases", "quals")


def record_error(bases: Column, quals: Column, uracil: bool = False) -> Column:
    """Why a read can't be a SAM record: its bases, or lengths that differ; null where it can."""
    pattern = SAM_BASES.replace("]+", "uU]+") if uracil else SAM_BASES
    return F.when(~F.coalesce(bases, F.lit("")).rlike(pattern), "SAM_RECORD_ERROR").when(F.length(bases) != F.length(F.coalesce(quals, F.lit(""))), "BASES_QUALITIES_LENGTH_MISMATCH")


def fastq_to_sam(reads: DataFrame, by: tuple[str, ...] = (), paired: bool = True, uracil: bool = True, strict: bool = True) -> DataFrame:
    """``(by..., qname, flags, bases, quals, barcode, line)``: unaligned records of read group A.

    ``reads`` hold Phred + 33 ``quals``.  Pairs get the flags 77 and 141, other reads 4; a filtered Casava read also 0x200, its
    barcode becomes the tag BC.  ``strict`` raises for reads that can't be records; otherwise they carry ``error``.
    """
    if paired:
        assembled = pairing.assemble(reads, by)
        both = F.col("reverse").isNotNull()
        one = lambda r, slot: F.struct(F.lit(slot).alias("slot"), F.col(f"{r}.name").alias("name"), F.col(f"{r}.bases").alias("bases"), F.col(f"{r}.quals").alias("quals"))
        rows = assembled.select(*by, F.col("read_key").alias("qname"), both.alias("paired"), F.explode(F.when(both, F.array(one("forward", 1), one("reverse", 2))).otherwise(F.array(one("forward", 1)))).alias("r")).select(*by, "qname", "paired", "r.*")
    else:
        rows = reads.where("name is not null").select(*by, names.single_base_name(F.col("name")).alias("qname"), F.lit(False).alias("paired"), F.lit(1).alias("slot"), "name", "bases", "quals")
    fixed = B.replace_uracil(F.col("bases")) if uracil else F.col("bases")
    error = record_error(F.col("bases"), F.col("quals"), uracil)
    if strict:
        fixed = F.when(error.isNull(), fixed).otherwise(F.raise_error(F.concat(error, F.lit(": "), F.col("name"))).cast("string"))
    rows = rows.withColumn("flags", S.unmapped_flags(F.col("paired"), F.col("slot"), names.is_filtered(F.col("name")))).withColumn("barcode", names.barcode(F.col("name"))).withColumn("error", error).withColumn("bases", fixed)
    tags = F.array_compact(F.array(F.concat(F.lit("BC:Z:"), F.col("barcode")), F.lit("RG:Z:A")))
    line = sam_line({"qname": F.col("qname"), "flags": F.col("flags"), "rname": F.lit("*"), "pos": F.lit(0), "mapq": F.lit(0), "cigar": F.lit("*"), "rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "bases": F.coalesce("bases", F.lit("*")), "quals": F.coalesce("quals", F.lit("*"))}, tags)
    return rows.select(*by, "qname", "flags", "bases", "quals", "barcode", "error", line.alias("line"))
