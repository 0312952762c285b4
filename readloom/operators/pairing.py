"""Mate assembly: bringing the reads of a template together by key.

Inputs hold ``name, bases, quals, file_no, read_no`` and may hold any other columns; ``by`` names columns
(say a run) within which keys are unique.  Assembly is one shuffle on the key with map-side combine.

Defined cases: a name without a pair number has its whole name as key and the file's ordinal as number
(``on_bad_name="file"``), or is an error (``"error"``), or is left out (``"drop"``); null names are
left out; of reads that fill one slot twice the first by (file_no, read_no) is taken and
``duplicate_slots`` tells them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from readloom.functions import names
from readloom.session import materialise

#: Records of a name that are counted in one task.
STRETCH = 100_000
READ = "struct<number: int, file_no: int, read_no: bigint, name: string, bases: string, quals: string>"


def with_keys(reads: DataFrame, on_bad_name: str = "file") -> DataFrame:
    """Add ``read_key`` and ``number`` (pair number)."""
    name = F.col("name")
    reads = reads.where(name.isNotNull())
    if on_bad_name == "file":
        return reads.withColumn("read_key", names.key_or_name(name)).withColumn("number", names.index_or_file(name, F.col("file_no")))
    keyed = reads.withColumn("read_key", names.read_key(name)).withColumn("number", names.pair_number(name))
    if on_bad_name == "error":
        bad = F.raise_error(F.concat(F.lit("INVALID_READ_NAME: "), name))
        return keyed.withColumn("read_key", F.when(F.col("read_key").isNull(), bad.cast("string")).otherwise(F.col("read_key")))
    return keyed.where("read_key is not null")


def assemble(reads: DataFrame, by: tuple[str, ...] = (), on_bad_name: str = "file") -> DataFrame:
    """``(by..., read_key, forward, reverse, n_reads)``: the read with the lower pair number is forward.

    A key with one number is an orphan: it is forward where its number is the lowest of its ``by`` group's numbers
    or it stands alone, which leaves ``reverse`` null.
    """
    keyed = with_keys(reads, on_bad_name)
    read = F.struct(F.col("number"), F.col("file_no").cast("int").alias("file_no"), F.col("read_no").cast("bigint").alias("read_no"), "name", "bases", "quals")
    grouped = keyed.groupBy(*by, "read_key").agg(F.min(read).alias("forward"), F.max(F.struct(F.col("number"), (-F.col("file_no")).alias("f"), (-F.col("read_no")).alias("r"), read.alias("read"))).alias("last"), F.count("*").alias("n_reads"))
    reverse = F.when(F.col("last.number") > F.col("forward.number"), F.col("last.read"))
    return grouped.select(*by, "read_key", "forward", reverse.alias("reverse"), "n_reads")


def paired(assembled: DataFrame) -> DataFrame:
    """Complete pairs only (what a lazy iterator over pairs yields)."""
    return assembled.where("reverse is not null")


def iterate(assembled: DataFrame, include_orphans: bool = False) -> Iterator[Row]:
    """Pairs one by one on the driver, a partition at a time; orphans only if asked for."""
    return (assembled if include_orphans else paired(assembled)).toLocalIterator()


def orphans(assembled: DataFrame) -> DataFrame:
    return assembled.where("reverse is null")


def pair_counts(assembled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., n_pairs, n_orphans, n_reads, n_bases)``: reads are two for each pair and one for each orphan."""
    both = F.col("reverse").isNotNull()
    size = F.coalesce(F.length("forward.bases"), F.lit(0)) + F.coalesce(F.length("reverse.bases"), F.lit(0))
    n_pairs, n_orphans = F.sum(both.cast("bigint")), F.sum((~both).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return assembled.groupBy(*by).agg(F.coalesce(n_pairs, zero).alias("n_pairs"), F.coalesce(n_orphans, zero).alias("n_orphans"), F.coalesce(2 * n_pairs + n_orphans, zero).alias("n_reads"), F.coalesce(F.sum(size), zero).alias("n_bases"))


def duplicate_slots(reads: DataFrame, by: tuple[str, ...] = (), on_bad_name: str = "file") -> DataFrame:
    """``(by..., read_key, number, n)``: slots filled more than once (SPOT_DUPLICATE)."""
    return with_keys(reads, on_bad_name).groupBy(*by, "read_key", "number").agg(F.count("*").alias("n")).where("n > 1")


def unexpected_numbers(reads: DataFrame, by: tuple[str, ...] = (), on_bad_name: str = "file") -> DataFrame:
    """``(by..., n_numbers)``: groups with more than two pair numbers (UNEXPECTED_PAIR_NUMBER)."""
    return with_keys(reads, on_bad_name).groupBy(*by).agg(F.count_distinct("number").alias("n_numbers")).where("n_numbers > 2")


def pair_by_name(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pair records of equal ``qname`` in order of ``record_no``: first and second, third and fourth, and so on.

    Adds ``pair_no`` (within the name) and ``slot`` (1, 2; 0 where a record stays alone).  Records are counted within
    stretches of ``record_no`` first, so that a name that fills a file (``*``, say) isn't sorted in one task.
    """
    keyed = records.withColumn("_name", F.coalesce("qname", F.lit("\0"))).withColumn("_part", F.floor(F.col("record_no") / STRETCH))
    name = [*by, "_name"]
    sizes = keyed.groupBy(*name, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*name).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*name, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*name)).alias("_of"))
    place = F.row_number().over(Window.partitionBy(*name, "_part").orderBy("record_no"))
    rows = keyed.withColumn("_at", place).join(sizes, [*name, "_part"]).withColumn("_place", F.col("_at") + F.col("_before")).drop("_name", "_part", "_at", "_before")
    slot = F.when((F.col("_place") == F.col("_of")) & (F.col("_of") % 2 == 1), 0).otherwise((F.col("_place") - 1) % 2 + 1)
    return rows.withColumn("pair_no", F.floor((F.col("_place") - 1) / 2)).withColumn("slot", slot.cast("int")).drop("_place", "_of")


def interleave(reads: DataFrame, by: tuple[str, ...] = (), stop_at_shorter: bool = False) -> DataFrame:
    """Reads of the files of each ``by`` group in turn, as ``turn`` orders them: (read_no, file_no).

    ``stop_at_shorter``: end where a file has no further read when its turn comes.
    """
    rows = reads.withColumn("turn", F.struct("read_no", "file_no"))
    if not stop_at_shorter:
        return rows
    sizes = reads.groupBy(*by, "file_no").agg(F.max("read_no").alias("n"))
    end = sizes.groupBy(*by).agg(F.min(F.struct((F.col("n") + 1).alias("read_no"), F.col("file_no"))).alias("end"))
    return rows.withColumn("_all", F.lit(0)).join(end.withColumn("_all", F.lit(0)), [*by, "_all"]).drop("_all").where(F.col("turn") < F.col("end")).drop("end")


def numbered(rows: DataFrame, order: list[str], column: str = "counter") -> DataFrame:
    """Number rows from 1 by a total order, without gathering them in one task.

    Rows are range-partitioned and sorted once; the numbers go on from partition to partition by
    their sizes (one row a partition).
    """
    sorted_rows = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = materialise(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")  # a row per partition
