"""Validation rules of submissions.

Each rule gives a nullable error column; the first error of a read is the first rule that fails, and the
first error of a file that of its lowest ``read_no`` (``min_by``, so files are never sorted or collected).

Inputs hold ``file_id, read_no, name, bases, quals``; other columns are ignored.  Null names, bases and
qualities count as blank.  Files without reads are errors only where a manifest names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import bases as B
from readloom.functions import names
from readloom.functions import quality as Q
from readloom.functions.sam import blank_star
from readloom.session import materialise

# Messages of the rules.
NO_READS = "Submitted files must contain a minimum of 1 sequence read"
EMPTY_READ = "Submitted files must not contain any empty reads"
EMPTY_QUALITY = "Submitted files must not contain any empty quality score lines"
LENGTH_MISMATCH = "Mismatch between length of read bases and qualities"
NAME_LENGTH = "Read name length exceeds 256 characters"
NOT_IUPAC = "Reads must contain only valid IUPAC codes"
NOT_AUTCG = "Reads must contain only valid IUPAC codes, with no more than 50% of bases being non-AUTCG"
LOW_QUALITY = "When submitted file contains base quality scores then >= 50% of reads must have average quality >= 30"
NOT_CASAVA = "Read name does not match CASAVA18"
BLANK_NAME = "Read name is blank"
REPEATED_NAME = "Multiple occurrences of a read name"
FEW_PAIRS = "Detected paired fastq submission with less than 20% of paired reads"
MANY_LABELS = "More pair labels than files"
BAD_QUALITY = "Qualities hold characters that can't be printed"
QUICK_LIMIT, EXTENDED_LIMIT = 100_000, 100_000_000
MIN_PAIRING = 20.0
#: Read numbers whose lowest are gathered at a time.
STRETCHES = (10**4, 10**7, 10**10)


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n")) == ""


def insdc_error(is_sam: bool = False) -> Column:
    """First failing rule of a read's content; null where all hold."""
    b, q = (blank_star(F.col(c)) for c in ("bases", "quals")) if is_sam else (F.col("bases"), F.col("quals"))
    return (
        F.when(_blank(b), EMPTY_READ)
        .when(_blank(q), EMPTY_QUALITY)
        .when(F.length(b) != F.length(q), LENGTH_MISMATCH)
        .when(F.length(F.trim("name")) > names.MAX_NAME, NAME_LENGTH)
        .when(~B.is_iupac(b), NOT_IUPAC)
    )


def fastq_error(casava: Column, odd_quals: Column) -> Column:
    """First failing rule of a FASTQ read's name and qualities; ``casava``: the style of its file; ``odd_quals``: whether qualities can't be printed."""
    name = F.col("name")
    return (
        F.when(casava & ~F.coalesce(names.is_casava(name), F.lit(False)), NOT_CASAVA)
        .when(~casava & _blank(name), BLANK_NAME)
        .when(odd_quals, BAD_QUALITY)
    )


def file_styles(reads: DataFrame) -> DataFrame:
    """``(file_id, style)`` by the first read of each file."""
    return reads.groupBy("file_id").agg(F.min_by(F.coalesce(names.read_style(F.col("name")), F.lit("FASTQ")), "read_no").alias("style"))


def insdc_report(reads: DataFrame, is_sam: bool = False, limit: int = EXTENDED_LIMIT, check_quality: bool = False) -> DataFrame:
    """Per file: counts, first error with its read's name and index, and the file-level rules.

    ``check_quality`` turns on the rule that half of the reads must have a mean quality of 30.
    """
    rows = reads.where(F.col("read_no") <= limit).withColumn("_error", insdc_error(is_sam))
    first = F.min_by(F.struct(F.col("_error").alias("error"), F.col("name"), F.col("read_no")), F.when(F.col("_error").isNotNull(), F.col("read_no")))
    b = F.coalesce(blank_star(F.col("bases")) if is_sam else F.col("bases"), F.lit(""))
    per = rows.groupBy("file_id").agg(
        first.alias("first"), F.count("*").alias("n_reads"), F.coalesce(F.sum(F.length(b)), F.lit(0)).alias("n_bases"), F.sum(B.count_autcg(b)).alias("n_autcg"), F.sum(Q.is_high_quality(F.col("quals")).cast("bigint")).alias("n_high_quality")
    )
    return per.select("file_id", "n_reads", "n_bases", "n_autcg", "n_high_quality", file_error(F.col("first.error"), check_quality).alias("error"), F.col("first.name").alias("read_name"), F.col("first.read_no").alias("read_index"))


def file_error(first: Column, check_quality: bool = False) -> Column:
    """The first read's error, else the file-level rules on ``n_bases, n_autcg, n_reads, n_high_quality``."""
    out = F.when(first.isNotNull(), first).when((F.col("n_bases") - F.col("n_autcg")) > F.floor(F.col("n_bases") / 2), NOT_AUTCG)
    return out.when(F.col("n_high_quality") * 2 < F.col("n_reads"), LOW_QUALITY) if check_quality else out


def duplicate_names(reads: DataFrame, positions: int | None = 100) -> DataFrame:
    """``(file_id, name, n, places)``: names held more than once in a file, with their first ``positions`` read numbers.

    The numbers are reduced in steps (``STRETCHES``), so a name that fills a file of 10**13 reads costs no task more than a thousand lists
    of ``positions`` numbers.
    """
    counts = reads.where("name is not null").groupBy("file_id", "name").agg(F.count("*").alias("n")).where("n > 1")
    if positions is None:
        return counts
    chosen = reads.select("file_id", "name", "read_no").join(counts.select("file_id", "name"), ["file_id", "name"], "left_semi")
    # the lowest numbers of each stretch of read numbers, then of each thousand stretches, and so on: no task gathers more than a thousand lists
    part, low = chosen.withColumn("p", F.array("read_no")), F.col("read_no")
    for width in STRETCHES:
        stretch = F.floor(low / width)
        part = part.groupBy("file_id", "name", stretch.alias("stretch")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, positions).alias("p"))
        low = F.col("p")[0]
    flat = part.groupBy("file_id", "name").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, positions).alias("places"))
    return counts.join(flat, ["file_id", "name"])


def possible_duplicates(reads: DataFrame) -> DataFrame:
    """``(file_id, n_added, n_possible_duplicates)``: how many names were seen before in their file, without false positives."""
    return reads.groupBy("file_id").agg(F.count("name").alias("n_added"), (F.count("name") - F.count_distinct("name")).alias("n_possible_duplicates"))


def pair_keys(reads: DataFrame) -> DataFrame:
    """Add ``key`` and ``label`` as validators see them, by the style of each file."""
    styles = file_styles(reads)
    rows = reads.join(styles, "file_id")
    casava = F.col("style") == "CASAVA18"
    return rows.withColumn("key", names.validator_key(F.col("name"), casava)).withColumn("label", names.validator_label(F.col("name"), casava, F.col("file_id").cast("string")))


def pairing_percentages(keyed: DataFrame, run: str = "run_accession") -> DataFrame:
    """``(run, file_1, file_2, pairing_pct)``: the first file of a run against each other one.

    100 * repeats / reads of the longer file, where repeats are all reads of both files beyond their distinct keys.
    """
    main = keyed.groupBy(run).agg(F.min("file_id").alias("main"))
    n = keyed.groupBy(run, "file_id").agg(F.count("key").alias("n"))
    keys = keyed.select(run, "file_id", "key").where("key is not null").distinct().join(main, run)
    held = keys.groupBy(run, "main", "key").agg(F.max(F.col("file_id") == F.col("main")).alias("in_main"), F.collect_set("file_id").alias("files"))
    d1 = held.where("in_main").groupBy(run, "main").agg(F.count("*").alias("d1"))
    others = held.select(run, "main", "in_main", F.explode("files").alias("file_id")).where("file_id != main")
    di = others.groupBy(run, "main", "file_id").agg(F.count("*").alias("di"), F.sum(F.col("in_main").cast("bigint")).alias("shared"))
    joined = di.join(d1, [run, "main"], "left").join(n.select(F.col(run), F.col("file_id").alias("main"), F.col("n").alias("n1")), [run, "main"]).join(n, [run, "file_id"])
    distinct = F.coalesce("d1", F.lit(0)) + F.col("di") - F.col("shared")
    return joined.select(run, F.col("main").alias("file_1"), F.col("file_id").alias("file_2"), (100.0 * (F.col("n1") + F.col("n") - distinct) / F.greatest("n1", "n")).alias("pairing_pct"))


def label_counts(keyed: DataFrame, run: str = "run_accession", shown: int = 10) -> DataFrame:
    """``(run, n_files, n_labels, labels, too_many)``: distinct pair labels, the first ``shown`` of them, and whether they outnumber the files."""
    labels = keyed.where("label is not null").select(run, "label").distinct()
    # the shown labels by rank, so that no group gathers more than it shows
    top = labels.groupBy(run, F.substring(F.md5("label"), 1, 1).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("label")), 1, shown).alias("some"))
    some = top.groupBy(run).agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, shown).alias("labels"))
    counts = keyed.groupBy(run).agg(F.count_distinct("file_id").alias("n_files"), F.count_distinct("label").alias("n_labels"))
    return counts.join(some, run, "left").select(run, "n_files", "n_labels", "labels", (F.col("n_labels") > F.col("n_files")).alias("too_many"))


def validate(
    reads: DataFrame, manifest: DataFrame, quick: bool | None = None, check_quality: bool = False, limits: tuple[int, int] | None = (QUICK_LIMIT, EXTENDED_LIMIT), is_sam: bool = False
) -> DataFrame:
    """Per file of the manifest: ``(file_id, valid, error, read_name, read_index, n_reads, n_high_quality, pairing_pct, n_labels)``.

    Rules in order: no reads; content of reads; names and qualities of FASTQ reads; duplicate names; for runs of several
    files a pairing of at least 20 per cent and no more pair labels than files.  ``quick`` overrides the manifest's
    own choice of how many reads of a file are looked at, ``limits`` gives the two numbers; with None all reads are.  ``is_sam``: records of
    alignment files, to which only the rules of content apply; a file without records is an error all the same.

    The reads are judged once; names, pairs and labels follow from a narrow written table.
    """
    known = manifest.select("file_id", "run_accession", F.coalesce(F.lit(quick), F.col("quick"), F.lit(False)).alias("quick")).groupBy("file_id").agg(F.min(F.struct("run_accession", "quick")).alias("m")).select("file_id", "m.*")
    rows = reads.join(known, "file_id")
    if limits is not None:
        rows = rows.where(F.col("read_no") <= F.when(F.col("quick"), limits[0]).otherwise(limits[1]))
    bases = F.coalesce(blank_star(F.col("bases")) if is_sam else F.col("bases"), F.lit(""))
    judged = rows.select(
        "file_id", "run_accession", "read_no", "name", insdc_error(is_sam).alias("content"), (~F.col("quals").rlike(r"\A[!-~]*\z")).alias("odd_quals"),
        F.length(bases).alias("n_bases"), B.count_autcg(bases).alias("n_autcg"), Q.is_high_quality(F.col("quals")).cast("bigint").alias("high"),
    )
    judged = materialise(judged, "validate")
    total = [F.count("*").alias("n_reads"), F.sum("n_bases").alias("n_bases"), F.sum("n_autcg").alias("n_autcg"), F.sum("high").alias("n_high_quality")]
    of_read = lambda step, e: F.min(F.when(e.isNotNull(), F.struct(F.lit(step).alias("step"), "read_no", e.alias("error"), "name")))
    if is_sam:
        per = judged.groupBy("file_id").agg(of_read(0, F.col("content")).alias("e"), *total)
        nothing = {"f": "struct<step: int, read_no: bigint, error: string, name: string>", "dup_name": "string", "n_dup": "bigint", "pairing_pct": "double", "n_labels": "bigint", "too_many": "boolean"}
        out = known.join(per, "file_id", "left").select("*", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    else:
        keyed = pair_keys(judged)
        casava = F.col("style") == "CASAVA18"
        per = keyed.groupBy("file_id").agg(of_read(0, F.col("content")).alias("e"), of_read(2, fastq_error(casava, F.col("odd_quals"))).alias("f"), *total)
        doubled = duplicate_names(judged, None).groupBy("file_id").agg(F.min("name").alias("dup_name"), F.count("*").alias("n_dup"))
        pairs = pairing_percentages(keyed).groupBy("run_accession").agg(F.min("pairing_pct").alias("pairing_pct"))
        labels = label_counts(keyed).select("run_accession", "n_labels", "too_many")
        out = known.join(per, "file_id", "left").join(doubled, "file_id", "left").join(pairs, "run_accession", "left").join(labels, "run_accession", "left")
    content = file_error(F.col("e.error"), check_quality)
    error = (
        F.when(F.coalesce("n_reads", F.lit(0)) == 0, NO_READS)
        .when(content.isNotNull(), content)
        .when(F.col("f").isNotNull(), F.col("f.error"))
        .when(F.col("n_dup") > 0, REPEATED_NAME)
        .when(F.col("pairing_pct") < MIN_PAIRING, FEW_PAIRS)
        .when(F.col("too_many"), MANY_LABELS)
    )
    by_read = F.coalesce(F.when(F.col("e").isNotNull(), F.col("e")), F.when(content.isNull(), F.col("f")))
    return out.select(
        "file_id", error.isNull().alias("valid"), error.alias("error"), F.coalesce(by_read["name"], F.when(content.isNull() & F.col("f").isNull(), F.col("dup_name"))).alias("read_name"), by_read["read_no"].alias("read_index"),
        F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.coalesce("n_high_quality", F.lit(0)).alias("n_high_quality"), "pairing_pct", F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
    )
