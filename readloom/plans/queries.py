"""The registered queries of the core: name -> (spark, data directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import bases, names, quality, regions, sam
from readloom.operators import convert, errparse, normalise, pairing, reference, sampler, stats, units, validate
from readloom.sources import bam, fastq, files, manifest
from readloom.sources import sam as sam_files
from readloom.session import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register ``f`` under its own name."""
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.p3_found(table(spark, d, "seq_reads"), table(spark, d, "manifest_files"))


@query
def p3_units(spark: SparkSession, d: str) -> DataFrame:
    """How many reads and values each unit holds, with their mean Phred value."""
    rows = units.to_phred(table(spark, d, "seq_reads"), table(spark, d, "manifest_files"))
    return units.once(rows).groupBy("unit").agg(F.count("*").alias("n_reads"), F.sum("n_values").alias("n_values"), F.sum("phred_total").alias("phred_total"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return errparse.p4_found(table(spark, d, "raw_reads"))


@query
def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return errparse.error_parse(table(spark, d, "raw_reads"))[0]


@query
def p4_repairs(spark: SparkSession, d: str) -> DataFrame:
    return errparse.error_parse(table(spark, d, "raw_reads"))[1]


# ---------------------------------------------------------------- base relations


def _reads(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Reads delivered again count once; blank names are null, one leading @ is dropped.

    ``where`` holds or not for all deliveries of a read, so it goes before the shuffle.
    """
    t = table(spark, d, "seq_reads").where(where)
    once = t.groupBy("read_id").agg(*(F.first(c).alias(c) for c in ("file_id", "file_no", "read_no", "name", "bases", "raw_quals")))
    bare = F.regexp_replace(F.trim(F.col("name"), F.lit(" \t")), "^@", "")
    return once.withColumn("name", F.when(F.trim(bare) != "", bare))


def _run_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with their run; qualities as submitted."""
    files = table(spark, d, "manifest_files").select("file_id", "run_accession")
    return _reads(spark, d).withColumn("quals", F.col("raw_quals")).join(files, "file_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sam_records")
    columns = ("qname", "flags", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "bases", "quals")
    once = t.groupBy("record_id").agg(*(F.first(c).alias(c) for c in columns))
    return once.withColumn("record_no", F.col("record_id"))


# ---------------------------------------------------------------- names


@query
def read_name_parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return _reads(spark, d).where("name is not null").select(
        "read_id", names.read_style(n).alias("style"), names.base_name(n).alias("base_name"), names.read_index(n).alias("read_index"), names.read_key(n).alias("read_key"), names.pair_number(n).alias("pair_number"), names.single_base_name(n).alias("single_name"),
        names.strip_pair_suffix(n).alias("stripped"),
    )


@query
def casava_barcode(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return _reads(spark, d).where(names.is_casava(n)).select("read_id", names.barcode(n).alias("barcode"), names.is_filtered(n).alias("filtered"))


@query
def validator_keys(spark: SparkSession, d: str) -> DataFrame:
    keyed = validate.pair_keys(_reads(spark, d).where("name is not null"))
    return keyed.select("read_id", "style", "key", "label")


# ---------------------------------------------------------------- qualities


def _texts(spark: SparkSession, d: str) -> DataFrame:
    q = F.trim(F.col("raw_quals"), F.lit(" \t"))
    return _reads(spark, d).withColumn("raw_quals", q).where((F.length("raw_quals") > 0) & (F.col("raw_quals") != "*"))


@query
def quality_detect(spark: SparkSession, d: str) -> DataFrame:
    return normalise.detect(_texts(spark, d), ("file_id",))


def _of_score(spark: SparkSession, d: str, score: str) -> DataFrame:
    files = table(spark, d, "manifest_files").where(F.col("quality_score") == score).select("file_id")
    return _texts(spark, d).join(files, "file_id", "left_semi").where(~F.col("raw_quals").rlike(r"\s"))


@query
def quality_illumina_to_sanger(spark: SparkSession, d: str) -> DataFrame:
    return _of_score(spark, d, "PHRED_64").select("read_id", quality.normalise(F.col("raw_quals"), "Illumina").alias("quals"))


@query
def quality_solexa_to_phred(spark: SparkSession, d: str) -> DataFrame:
    return _of_score(spark, d, "LOGODDS").select("read_id", quality.normalise(F.col("raw_quals"), "Solexa").alias("quals"))


@query
def phred_logodds(spark: SparkSession, d: str) -> DataFrame:
    """Every score that occurs, as log-odds and back."""
    h = stats.symbol_histogram(_records(spark, d).where("quals != '*'").withColumn("all", F.lit(0)), "all", {"quals": "quals"})
    s = h.select((F.ascii("symbol") - 33).alias("score"))
    return s.select("score", quality.phred_to_logodds(F.col("score")).alias("logodds"), quality.logodds_to_phred(F.col("score")).alias("as_logodds_to_phred"))


@query
def quality_decode(spark: SparkSession, d: str) -> DataFrame:
    """Scores within the range of the encoding, their number and sum; null where one lies outside."""
    v = quality.decode(F.col("raw_quals"), "ILLUMINA_1_3")
    back = quality.encode(v, "SANGER")
    return _of_score(spark, d, "PHRED_64").select("read_id", F.size(v).alias("n"), F.aggregate(v, F.lit(0), lambda a, x: a + x).alias("total"), back.alias("sanger"))


@query
def read_mean_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).where("quals is not null and quals not in ('', '*')")
    return rows.select("record_id", F.round(quality.mean_quality(F.col("quals")), 6).alias("mean_quality"), quality.is_high_quality(F.col("quals")).alias("high"))


@query
def file_quality_stats(spark: SparkSession, d: str) -> DataFrame:
    high = quality.is_high_quality(F.col("raw_quals"))
    return _texts(spark, d).groupBy("file_id").agg(F.count("*").alias("read_count"), F.sum(high.cast("bigint")).alias("high_quality_read_count"))


# ---------------------------------------------------------------- bases


@query
def uracil_to_t(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).where("bases is not null").select("read_id", bases.replace_uracil(F.col("bases")).alias("bases"))


@query
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).where(sam.has(F.col("flags"), sam.REVERSE) & F.col("bases").isNotNull() & (F.col("bases") != "*"))
    return rows.select("record_id", bases.reverse_complement(F.col("bases")).alias("bases"), F.reverse("quals").alias("quals"))


@query
def md5_sequence(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).where("bases is not null and bases != '*'")
    b = F.col("bases")
    return rows.select("record_id", bases.sequence_md5(bases.upper_bases(b)).alias("md5"), bases.count_autcg(b).alias("autcg"), bases.is_iupac(b).alias("iupac"), bases.is_valid_reference(b, 50).alias("valid_reference"))


@query
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    """FASTQ text of SAM records, with the index of the segment after the name."""
    rows = _records(spark, d).where("bases is not null and bases != '*' and qname is not null")
    text = bases.fastq_text(F.col("qname"), F.col("bases"), F.col("quals"), sam.segment_index(F.col("flags")))
    return rows.select("record_id", text.alias("fastq"), bases.size_bytes(F.col("qname"), F.col("bases"), F.col("quals")).alias("size_bytes"))


@query
def region_slice(spark: SparkSession, d: str) -> DataFrame:
    """Bases 21 to 60 of each record, cut at its end, with their MD5; the record's bases begin at pos of a region."""
    rows = _records(spark, d).where("bases is not null and bases != '*'")
    start = F.col("pos") + 20
    cut = regions.slice_clipped(F.col("bases"), start, F.lit(40), F.col("pos"))
    return rows.select("record_id", cut.alias("slice"), regions.region_md5(F.col("bases"), start, F.lit(40), F.col("pos")).alias("md5"))


# ---------------------------------------------------------------- histograms


@query
def base_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.symbol_histogram(_reads(spark, d), "file_id", {"bases": "bases"}).select("file_id", "symbol", "n")


@query
def quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.total_histogram(stats.symbol_histogram(_texts(spark, d), "file_id", {"quals": "raw_quals"})).select("symbol", "n")


@query
def histogram_diff(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose counts differ between the first and second files of the runs."""
    h = stats.symbol_histogram(_reads(spark, d), "file_no", {"bases": "bases", "quals": "raw_quals"})
    return stats.histogram_difference(h.where("file_no = 1"), h.where("file_no = 2"))


@query
def qual_interval_weight(spark: SparkSession, d: str) -> DataFrame:
    h = stats.symbol_histogram(_texts(spark, d), "file_id", {"quals": "raw_quals"})
    return stats.interval_weights(h, ("file_id",)).select("file_id", "interval", F.round("weight", 9).alias("weight"))


@query
def scoring_distance(spark: SparkSession, d: str) -> DataFrame:
    h = stats.symbol_histogram(_texts(spark, d), "file_id", {"quals": "raw_quals"})
    return stats.scoring_distances(h, 33, ("file_id",)).select("file_id", "model", F.round("distance", 9).alias("distance"))


# ---------------------------------------------------------------- pairing

_RUN = ("run_accession",)


@query
def pair_assembly(spark: SparkSession, d: str) -> DataFrame:
    a = pairing.assemble(_run_reads(spark, d), _RUN)
    return a.select("run_accession", "read_key", F.col("forward.name").alias("forward_name"), F.col("reverse.name").alias("reverse_name"), F.col("forward.bases").alias("forward_bases"), "n_reads")


@query
def pair_inner(spark: SparkSession, d: str) -> DataFrame:
    a = pairing.paired(pairing.assemble(_run_reads(spark, d), _RUN))
    return a.select("run_accession", "read_key", F.col("forward.number").alias("number_1"), F.col("reverse.number").alias("number_2"))


@query
def orphans(spark: SparkSession, d: str) -> DataFrame:
    a = pairing.orphans(pairing.assemble(_run_reads(spark, d), _RUN))
    return a.select("run_accession", "read_key", F.col("forward.number").alias("number"), F.col("forward.name").alias("name"))


@query
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_counts(pairing.assemble(_run_reads(spark, d), _RUN), _RUN)


@query
def spot_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return pairing.duplicate_slots(_run_reads(spark, d), _RUN)


@query
def unexpected_pair_numbers(spark: SparkSession, d: str) -> DataFrame:
    return pairing.unexpected_numbers(_run_reads(spark, d), _RUN)


@query
def normalize_paired_names(spark: SparkSession, d: str) -> DataFrame:
    rows = normalise.normalise_paired(_run_reads(spark, d), _RUN, "OUT", on_bad_name="drop")
    return rows.select("run_accession", "read_key", "counter", "slot", "output_name", bases.replace_uracil(F.col("bases")).alias("bases"))


@query
def normalize_single(spark: SparkSession, d: str) -> DataFrame:
    rows = normalise.normalise_single(normalise.normalised_reads(_reads(spark, d).where("name is not null")), "OUT")
    return rows.select("read_id", "output_name", "bases")


@query
def normalize_counts(spark: SparkSession, d: str) -> DataFrame:
    return normalise.single_counts(_reads(spark, d))


@query
def read_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 reads of each file: the limit is the feature."""
    return _reads(spark, d, "read_no <= 100").select("read_id", "file_id", "read_no")


@query
def interleaved_until_shorter(spark: SparkSession, d: str) -> DataFrame:
    """The files of each run taken in turn until one has no read."""
    return pairing.interleave(_run_reads(spark, d), _RUN, True).select("run_accession", "file_no", "read_no", "read_id")


@query
def union_files(spark: SparkSession, d: str) -> DataFrame:
    r = _reads(spark, d, "file_no in (1, 2)").select("read_id", "file_no")
    return r.groupBy("file_no").agg(F.count("*").alias("n"))


@query
def derived_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pair and orphan counts of reads derived from order lines."""
    key, no = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    letters = F.translate(F.md5(F.concat(key, F.lit("-"), no)), "0123456789abcdef", "ACGTACGTACGTACGN")
    rows = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.concat(F.lit("R"), key, F.lit("/"), no).alias("name"), letters.alias("bases"), F.lit(None).cast("string").alias("quals"), F.col("l_linenumber").alias("file_no"), F.lit(0).cast("bigint").alias("read_no")).distinct()
    return pairing.pair_counts(pairing.assemble(rows))


# ---------------------------------------------------------------- validation


@query
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicate_names(_reads(spark, d)).select("file_id", "name", "n", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


@query
def possible_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return validate.possible_duplicates(_reads(spark, d))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return validate.pair_keys(_run_reads(spark, d).where("name is not null"))


@query
def pairing_percentage(spark: SparkSession, d: str) -> DataFrame:
    return validate.pairing_percentages(_keyed(spark, d)).select("run_accession", "file_1", "file_2", F.round("pairing_pct", 6).alias("pairing_pct"))


@query
def label_count(spark: SparkSession, d: str) -> DataFrame:
    return validate.label_counts(_keyed(spark, d)).select("run_accession", "n_files", "n_labels", F.array_join("labels", ",").alias("labels"), "too_many")


@query
def insdc_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = _run_reads(spark, d).withColumn("rule", validate.insdc_error())
    return rows.where("rule is not null").groupBy("file_id", "rule").agg(F.count("*").alias("n"), F.min("read_no").alias("first_read"))


@query
def autcg_rule(spark: SparkSession, d: str) -> DataFrame:
    r = validate.insdc_report(_run_reads(spark, d))
    return r.select("file_id", "n_bases", "n_autcg", ((F.col("n_bases") - F.col("n_autcg")) > F.floor(F.col("n_bases") / 2)).alias("too_many_others"))


@query
def first_errors(spark: SparkSession, d: str) -> DataFrame:
    return validate.insdc_report(_run_reads(spark, d)).select("file_id", "n_reads", "error", "read_index")


@query
def sam_first_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select(F.lit(0).cast("bigint").alias("file_id"), F.col("record_no").alias("read_no"), F.col("qname").alias("name"), "bases", "quals")
    return validate.insdc_report(rows, is_sam=True).select("file_id", "n_reads", "n_bases", "error", "read_index")


@query
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    reads = _reads(spark, d).withColumn("quals", F.col("raw_quals"))
    out = validate.validate(reads, table(spark, d, "manifest_files"))
    return out.select("file_id", "valid", "error", "read_index", "n_reads", F.round("pairing_pct", 6).alias("pairing_pct"), "n_labels")


@query
def validation_of_quality(spark: SparkSession, d: str) -> DataFrame:
    """With the rule that half of the reads must have a mean quality of 30, over all reads of a file however many."""
    out = validate.validate(_reads(spark, d).withColumn("quals", F.col("raw_quals")), table(spark, d, "manifest_files"), check_quality=True, limits=None)
    return out.select("file_id", "valid", "error", "n_reads", "n_high_quality")


@query
def sam_validation(spark: SparkSession, d: str) -> DataFrame:
    """Records by the reference they name as files of a submission, one of which has none."""
    refs = table(spark, d, "sam_records").select(F.coalesce("rname", F.lit("*")).alias("rname")).distinct().unionByName(spark.createDataFrame([("no records",)], "rname string"))
    files = refs.select("rname", F.expr("conv(substr(md5(rname), 1, 12), 16, 10)").cast("bigint").alias("file_id"))
    rows = _records(spark, d).withColumn("rname", F.coalesce("rname", F.lit("*"))).join(files, "rname").select("file_id", F.col("record_no").alias("read_no"), F.col("qname").alias("name"), "bases", "quals")
    out = validate.validate(rows, files.select("file_id", F.lit("run").alias("run_accession"), F.lit(False).alias("quick")), is_sam=True)
    return out.join(files, "file_id").select("rname", "valid", "error", "read_index", "n_reads")


@query
def reference_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of the sequences that the headers name, against computed ones; every second line has its sequence (made of its own name)."""
    sq = reference.sq_lines(table(spark, d, "sam_headers"))
    have = sq.where("line_no % 2 = 0").select("sn", F.translate(F.md5("sn"), "0123456789abcdef", "ACGTACGTACGTACGN").alias("bases"))
    return reference.check_md5(sq, have).select("sn", "m5", "computed", "verdict")


@query
def manifest_encodings(spark: SparkSession, d: str) -> DataFrame:
    return manifest.raw_files(table(spark, d, "manifest_files")).select("file_id", "file_type", "scoring", "ascii_offset", "compression")


# ---------------------------------------------------------------- SAM


@query
def sam_flags(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("flags")
    return _records(spark, d).select("record_id", sam.segment_index(f).alias("segment"), sam.is_not_primary(f).alias("not_primary"), sam.has(f, sam.QC_FAIL).alias("failed"), sam.has(f, sam.REVERSE).alias("reverse"))


@query
def sam_filter_counters(spark: SparkSession, d: str) -> DataFrame:
    return convert.record_counters(_records(spark, d))


@query
def first_reverse_read(spark: SparkSession, d: str) -> DataFrame:
    return convert.first_reverse_read(_records(spark, d))


@query
def sam_to_fastq(spark: SparkSession, d: str) -> DataFrame:
    return convert.sam_to_fastq(_records(spark, d)).select(F.col("record_no").alias("record_id"), "segment_index", "name", "bases", "quals")


@query
def sam_to_fastq_counts(spark: SparkSession, d: str) -> DataFrame:
    return convert.sam_to_fastq(_records(spark, d), prefix="OUT").groupBy("segment_index").agg(F.count("*").alias("n_reads"), F.sum(F.length("bases")).alias("n_bases"), F.count_distinct("name").alias("n_names"))


@query
def fastq_to_sam(spark: SparkSession, d: str) -> DataFrame:
    rows = convert.fastq_to_sam(_run_reads(spark, d), _RUN, strict=False)
    return rows.select("run_accession", "qname", "flags", "barcode", "error", "bases")


@query
def generated_names(spark: SparkSession, d: str) -> DataFrame:
    return _reads(spark, d).where("name like '% %'").select("read_id", names.is_generated_name(F.col("name")).alias("generated"))


# ---------------------------------------------------------------- references


@query
def sq_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return reference.sq_lines(table(spark, d, "sam_headers")).select("line_no", "sn", "ln", "m5")


@query
def missing_checksums(spark: SparkSession, d: str) -> DataFrame:
    return reference.missing_checksums(reference.sq_lines(table(spark, d, "sam_headers")))


@query
def read_groups(spark: SparkSession, d: str) -> DataFrame:
    return reference.sample_of(table(spark, d, "sam_headers"))


@query
def reference_paths(spark: SparkSession, d: str) -> DataFrame:
    sq = reference.sq_lines(table(spark, d, "sam_headers")).where("m5 is not null")
    return sq.select("sn", regions.format_path_column("cache/%2s/%3s/%s", F.col("m5")).alias("path"))


@query
def records_per_reference(spark: SparkSession, d: str) -> DataFrame:
    """Records by the sequence they name, with the sequence's length and checksum."""
    sq = reference.sq_lines(table(spark, d, "sam_headers")).select("sn", "ln", "m5")
    n = _records(spark, d).groupBy(F.col("rname").alias("sn")).agg(F.count("*").alias("n"))
    return n.join(sq, "sn", "left")


# ---------------------------------------------------------------- packing, synthesis


@query
def packed_bases(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of packed bases, and whether they unpack to themselves."""
    rows = _records(spark, d).withColumn("b", F.upper(F.translate("bases", "Uu", "Tt"))).where(F.col("b").rlike("^[ACGTN]+$"))
    packed = rows.select("record_id", "b", sampler.pack_bases(F.col("b")).alias("p"), sampler.squeeze_bases(F.col("b")).alias("s"))
    return packed.select("record_id", F.octet_length("p").alias("packed_bytes"), F.octet_length("s").alias("squeezed_bytes"), (sampler.unpack_bases(F.col("p"), F.length("b")) == F.col("b")).alias("same"))


@query
def packed_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).where(F.col("quals").rlike("^[!-~]+$") & (F.col("quals") != "*"))
    return rows.select("record_id", F.octet_length(sampler.pack_scores(F.col("quals"))).alias("packed_bytes"))


@query
def generated_reads(spark: SparkSession, d: str) -> DataFrame:
    return sampler.generate_reads(spark, 1000)


# ---------------------------------------------------------------- files: written to the shared folder and read again


def _whole_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads that a FASTQ file can hold."""
    rows = _run_reads(spark, d).where("name is not null and length(name) <= 256 and length(bases) = length(quals)")
    return rows.where(F.col("bases").rlike("^[ACGTNacgtn]+$") & F.col("quals").rlike("^[!-~]+$")).select("name", "bases", "quals")


@query
def fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fastq")
    fastq.write_fastq(_whole_reads(spark, d), path)
    return fastq.read_fastq(spark, path, splitBytes=100_000).select("name", "bases", F.col("raw_quals").alias("quals"))


@query
def fastq_gzip_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fastq-gz")
    fastq.write_fastq(_whole_reads(spark, d), path, compression="gzip")
    return fastq.read_fastq(spark, path, compression="extension").select("name", "bases", F.col("raw_quals").alias("quals"))


@query
def fastq_lenient_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bases and qualities over two lines each."""
    path = scratch(spark, "fastq-lenient")
    rows = _whole_reads(spark, d).where(~names.is_casava(F.col("name")))
    two = lambda c: F.concat(F.substring(c, 1, 20), F.when(F.length(c) > 20, F.concat(F.lit("\n"), F.substring(F.col(c), F.lit(21), F.length(c)))).otherwise(""))
    rows.select(F.concat(F.lit("@"), "name", F.lit("\n"), two("bases"), F.lit("\n+\n"), two("quals")).alias("value")).write.text(path)
    return fastq.read_fastq(spark, path, mode="lenient", splitBytes=100_000).select("name", "bases", F.col("raw_quals").alias("quals"))


@query
def sam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All columns and tags of SAM records."""
    path = scratch(spark, "sam")
    number, text = ("flags", "pos", "pnext", "tlen"), ("qname", "rname", "mapq", "cigar", "rnext", "bases", "quals")
    rows = table(spark, d, "sam_records").groupBy("record_id").agg(*(F.first(c).alias(c) for c in (*number, *text, "tags"))).where("qname is not null and trim(qname) != '' and not startswith(qname, '@')")
    filled = {c: F.coalesce(c, F.lit(0)) for c in number} | {c: F.coalesce(c, F.lit("*")) for c in text}
    entries = F.filter(F.map_entries(F.coalesce("tags", F.expr("cast(map() as map<string,string>)"))), lambda e: e["value"].isNotNull())
    line = sam_files.sam_line(filled, F.transform(entries, lambda e: F.concat(e["key"], F.lit(":Z:"), e["value"])))
    sam_files.write_sam(rows.select(line.alias("line")), path, sam_files.header_lines("s", False))
    back = sam_files.read_sam(spark, path, splitBytes=50_000)
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return back.select(*number, *text, tags.alias("tags"))


@query
def sam_header_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Header lines as text and parsed again."""
    path = scratch(spark, "sam-header")
    rows = table(spark, d, "sam_headers").where("record in ('HD', 'SQ', 'RG')")
    tags = F.transform(F.filter(F.map_entries("tags"), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    rows.select(F.concat_ws("\t", F.concat(F.lit("@"), "record"), tags).alias("value")).write.text(path)
    back = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return sam_files.read_sam_header(spark, path).select("record", back.alias("tags"))


@query
def bam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Unaligned records of FASTQ reads."""
    path = scratch(spark, "bam")
    rows = convert.fastq_to_sam(_run_reads(spark, d), _RUN, strict=False).where("error is null and length(qname) <= 254")
    bam.write_bam(rows.where(F.col("quals").rlike("^[!-~]+$") & (F.col("quals") != "*")), path, "sample")
    return bam.read_bam(spark, path).select("qname", "flags", "bases", "quals", F.try_element_at("tags", F.lit("BC")).alias("barcode"))


@query
def sam_to_fastq_files(spark: SparkSession, d: str) -> DataFrame:
    """The outputs 0, 1 and 2 of a conversion, read from their files."""
    path = scratch(spark, "split")
    fastq.write_fastq_split(convert.sam_to_fastq(_records(spark, d)).where("name is not null and bases != '' and length(bases) = length(quals)"), path)
    out = spark.createDataFrame([], "segment_index int, name string, bases string, quals string")
    for i in (0, 1, 2):
        if files.exists(part := f"{path}/segment_index={i}"):  # outputs without reads aren't made
            out = out.unionByName(fastq.read_fastq(spark, part).select(F.lit(i).alias("segment_index"), "name", "bases", F.col("raw_quals").alias("quals")))
    return out
