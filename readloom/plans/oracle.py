"""SQL of the core's queries, for tables of the same names."""

from __future__ import annotations

import math

from readloom.functions import names

ORACLE: dict[str, str] = {}

CAS, SEVEN, SUF, SUF4 = names.CASAVA.replace("\t", "\\t"), names.SEVEN_FIELDS, names.PAIR_SUFFIX, names.PAIR_SUFFIX_VALIDATOR


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cas(group: int, n: str = "name") -> str:
    return f"case when regexp_matches({n}, {lit(CAS)}) then regexp_extract({n}, {lit(CAS)}, {group}) end"


def suffix(group: int, pattern: str = SUF, n: str = "name") -> str:
    return f"case when not regexp_matches({n}, {lit(SEVEN)}) and regexp_matches({n}, {lit(pattern)}) then regexp_extract({n}, {lit(pattern)}, {group}) end"


KEY, NUMBER = f"coalesce({cas(1)}, {suffix(1)})", f"try_cast(coalesce({cas(3)}, {suffix(2)}) as integer)"
BLANKS = "' ' || chr(9)"
READS = f"""r0 as (select distinct read_id, file_id, file_no, read_no, name, bases, raw_quals from seq_reads),
r1 as (select * replace (regexp_replace(trim(name, {BLANKS}), '^@', '') as name) from r0),
r as (select * replace (case when trim(name) <> '' then name end as name) from r1)"""
RUN_READS = READS + """,
rr as (select r.*, raw_quals as quals, run_accession from r join manifest_files using (file_id))"""
KEYED = RUN_READS + f""",
k as (select run_accession, coalesce({KEY}, name) as read_key, coalesce({NUMBER}, file_no) as number, file_no, read_no, name, bases, quals, read_id from rr where name is not null)"""


def assembled(source: str = KEYED) -> str:
    return source + """,
f as (select *, row_number() over (partition by run_accession, read_key order by number, file_no, read_no) as a, row_number() over (partition by run_accession, read_key order by number desc, file_no, read_no) as z from k),
p as (select run_accession, read_key, count(*) as n_reads, max(case when a = 1 then number end) as number_1, max(case when a = 1 then name end) as name_1, max(case when a = 1 then bases end) as bases_1, max(case when a = 1 then quals end) as quals_1,
  max(case when z = 1 then number end) as number_2, max(case when z = 1 then name end) as name_2, max(case when z = 1 then bases end) as bases_2, max(case when z = 1 then quals end) as quals_2 from f group by all),
q as (select *, number_2 > number_1 as is_pair from p)"""


TEXTS = READS + f""",
t as (select * replace (trim(raw_quals, {BLANKS}) as raw_quals) from r where trim(raw_quals, {BLANKS}) not in ('', '*'))"""
SAM = """s as (select distinct record_id, qname, flags, rname, pos, mapq, cigar, bases, quals from sam_records)"""


def chars(source: str, text: str, keys: str) -> str:
    return f"select {keys}, unnest(string_split({text}, '')) as symbol from {source} where {text} <> ''"


def mean(q: str) -> str:
    return f"(list_sum(list_transform(string_split({q}, ''), lambda c: ascii(c))) - 33 * length({q})) / length({q})::double"


ORACLE["read_name_parts"] = f"""with {READS}
select read_id, case when regexp_matches(name, {lit(CAS)}) then 'CASAVA18' else 'FASTQ' end as style, {cas(1)} as base_name, {cas(3)} as read_index, {KEY} as read_key, {NUMBER} as pair_number,
  coalesce({cas(1)}, regexp_replace(name, '/[^/]*$', '')) as single_name, coalesce({KEY}, name) as stripped from r where name is not null"""
ORACLE["casava_barcode"] = f"""with {READS}
select read_id, nullif(substr({cas(6)}, 2), '') as barcode, ({cas(4)}) = 'Y' as filtered from r where regexp_matches(name, {lit(CAS)})"""
VALIDATOR = f"""st as (select file_id, arg_min(regexp_matches(name, {lit(CAS)}), read_no) as casava from r where name is not null group by file_id),
v as (select r.*, casava, case when casava then {cas(1)} else coalesce({suffix(1, SUF4)}, name) end as key, case when casava then {cas(3)} else coalesce({suffix(2, SUF4)}, file_id::varchar) end as label from r join st using (file_id) where name is not null)"""
ORACLE["validator_keys"] = f"with {READS}, {VALIDATOR} select read_id, case when casava then 'CASAVA18' else 'FASTQ' end as style, key, label from v"
LOW = "list_min(list_transform(string_split(raw_quals, ''), lambda c: ascii(c)))"
ORACLE["quality_detect"] = f"""with {TEXTS}, l as (select file_id, min({LOW}) as lowest from t group by file_id)
select file_id, lowest, case when lowest < 59 then 'Standard' when lowest < 64 then 'Solexa' else 'Illumina' end as encoding from l"""
SCORED = TEXTS + """,
u as (select t.* from t join manifest_files m using (file_id) where quality_score = '{}' and not regexp_matches(raw_quals, '\\s'))"""
_CODES = "".join(map(chr, range(33, 127)))
_ILLUMINA = "".join(chr(33 + max(0, c - 64)) for c in range(33, 127))
# Phred of a log-odds score s is 10 * log10(10 ** (s / 10) + 1), rounded; negative scores become 0
_SOLEXA = "".join(chr(33 + (math.floor(10 * math.log10(10 ** ((c - 64) / 10) + 1) + 0.5) if c >= 64 else 0)) for c in range(33, 127))
ORACLE["quality_illumina_to_sanger"] = f"with {SCORED.format('PHRED_64')} select read_id, translate(raw_quals, {lit(_CODES)}, {lit(_ILLUMINA)}) as quals from u"
ORACLE["quality_solexa_to_phred"] = f"with {SCORED.format('LOGODDS')} select read_id, translate(raw_quals, {lit(_CODES)}, {lit(_SOLEXA)}) as quals from u"
ORACLE["phred_logodds"] = f"""with {SAM}, c as ({chars('s', 'quals', 'quals as whole')}), x as (select distinct ascii(symbol) - 33 as score from c where whole <> '*')
select score, case when score = 0 then -5 else greatest(-5, floor(10 * log10(pow(10.0::double, score / 10.0::double) - 1) + 0.5)) end::integer as logodds, floor(10 * log10(pow(10.0::double, score / 10.0::double) + 1) + 0.5)::integer as as_logodds_to_phred from x"""
ORACLE["quality_decode"] = f"""with {SCORED.format('PHRED_64')}, w as (select read_id, raw_quals, list_transform(string_split(raw_quals, ''), lambda c: ascii(c) - 64) as v from u),
y as (select *, list_min(v) >= 0 and list_max(v) <= 93 as good from w)
select read_id, case when good then len(v) end::integer as n, case when good then list_sum(v) end::integer as total, case when good then array_to_string(list_transform(v, lambda x: chr((x + 33)::integer)), '') end as sanger from y"""
ORACLE["read_mean_quality"] = f"with {SAM} select record_id, round({mean('quals')}, 6) as mean_quality, {mean('quals')} >= 30 as high from s where quals not in ('', '*')"
ORACLE["file_quality_stats"] = f"with {TEXTS} select file_id, count(*) as read_count, count(*) filter ({mean('raw_quals')} >= 30) as high_quality_read_count from t group by file_id"
ORACLE["uracil_to_t"] = f"with {READS} select read_id, replace(replace(bases, 'U', 'T'), 'u', 't') as bases from r where bases is not null"
ORACLE["reverse_complement"] = f"with {SAM} select record_id, translate(reverse(bases), 'ACGTacgt', 'TGCAtgca') as bases, reverse(quals) as quals from s where flags & 16 <> 0 and bases <> '*'"
ORACLE["md5_sequence"] = f"""with {SAM} select record_id, md5(upper(bases)) as md5, (length(bases) - length(translate(bases, 'AUTCGautcg', '')))::integer as autcg, regexp_matches(upper(bases), '^[ACGTURYSWKMBDHVN.-]+$') as iupac,
  regexp_matches(substr(bases, 1, 50), '^[ACGTURYSWKMBDHVN.-]*$') as valid_reference from s where bases <> '*'"""
SEGMENT = "case when flags & 1 = 0 then 0 when flags & 64 <> 0 then 1 else 2 end"
ORACLE["fastq_records"] = f"""with {SAM} select record_id, '@' || qname || case when {SEGMENT} > 0 then '/' || ({SEGMENT}) else '' end || chr(10) || bases || chr(10) || '+' || chr(10) || case when coalesce(quals, '*') = '*' then repeat('!', length(bases)) else quals end as fastq,
  (octet_length(encode(qname)) + octet_length(encode(bases)) + coalesce(octet_length(encode(quals)), 0))::integer as size_bytes from s where bases <> '*' and qname is not null"""
ORACLE["region_slice"] = f"with {SAM} select record_id, substr(bases, 21, 40) as slice, md5(substr(bases, 21, 40)) as md5 from s where bases <> '*'"
ORACLE["base_histogram"] = f"with {READS}, c as ({chars('r', 'bases', 'file_id')}) select file_id, symbol, count(*) as n from c group by all"
ORACLE["quality_histogram"] = f"with {TEXTS}, c as ({chars('t', 'raw_quals', 'file_id')}) select symbol, count(*) as n from c group by all"
ORACLE["histogram_diff"] = f"""with {READS}, c as (select 'bases' as kind, * from ({chars('r', 'bases', 'file_no')}) union all select 'quals', * from ({chars('r', 'raw_quals', 'file_no')})),
h as (select file_no, kind, symbol, count(*) as n from c group by all)
select coalesce(a.kind, b.kind) as kind, coalesce(a.symbol, b.symbol) as symbol, a.n as n_a, b.n as n_b from (select * from h where file_no = 1) a full join (select * from h where file_no = 2) b on a.kind = b.kind and a.symbol = b.symbol where a.n is distinct from b.n"""
FILE_QUALS = f"{TEXTS}, c as ({chars('t', 'raw_quals', 'file_id')}), h as (select file_id, ascii(symbol) as code, count(*) as n from c group by all)"
# Intervals of quality characters and their typical bounds
_INTERVALS = "('S', 33, 126, 33, 73), ('X', 59, 126, 59, 104), ('I', 64, 126, 64, 104), ('J', 66, 126, 67, 104), ('L', 33, 126, 33, 74)"
ORACLE["qual_interval_weight"] = f"""with {FILE_QUALS}, i(interval, low, high, t_low, t_high) as (values {_INTERVALS}), b as (select file_id, min(code) as a, max(code) as z from h group by file_id)
select h.file_id, i.interval, round(sum(case when code between t_low and t_high then n else 0 end)::double / sum(n)::double, 9) as weight from h join b using (file_id) join i on b.a >= i.low and b.z <= i.high group by all"""
ORACLE["scoring_distance"] = f"""with {FILE_QUALS}, e as (select model, s, case when model = 'PHRED' then least(1.0::double, pow(10.0::double, -s / 10.0::double)) else 1 / (1 + pow(10.0::double, s / 10.0::double)) end as p from (values ('PHRED'), ('LOGODDS')) k(model), range(-6, 43) r(s)),
i as (select s as score, case when s > 0 then s when s < 0 then s - 1 else -1 end as a, case when s > 0 then s + 1 when s < 0 then s else 1 end as b from range(-5, 41) r(s)),
m0 as (select x.model, i.score, greatest(0.0::double, x.p - y.p) as p from i join e x on x.s = i.a join e y on y.s = i.b and y.model = x.model), m as (select model, score, p / sum(p) over (partition by model) as p from m0), g as (select file_id, code - 33 as score, n from h where code - 33 between -5 and 40), tot as (select file_id, sum(n)::double as total from g group by file_id)
select tot.file_id, m.model, round(sqrt(sum(pow(m.p - coalesce(g.n, 0) / tot.total, 2)) / 46), 9) as distance from tot join m on true left join g on g.file_id = tot.file_id and g.score = m.score group by all"""
ORACLE["pair_assembly"] = f"with {assembled()} select run_accession, read_key, name_1 as forward_name, case when is_pair then name_2 end as reverse_name, bases_1 as forward_bases, n_reads from q"
ORACLE["pair_inner"] = f"with {assembled()} select run_accession, read_key, number_1, number_2 from q where is_pair"
ORACLE["orphans"] = f"with {assembled()} select run_accession, read_key, number_1 as number, name_1 as name from q where not is_pair"
ORACLE["pair_counts"] = f"""with {assembled()} select run_accession, count(*) filter (is_pair) as n_pairs, count(*) filter (not is_pair) as n_orphans, count(*) + count(*) filter (is_pair) as n_reads,
  sum(coalesce(length(bases_1), 0) + case when is_pair then coalesce(length(bases_2), 0) else 0 end)::bigint as n_bases from q group by all"""
ORACLE["spot_duplicates"] = f"with {KEYED} select run_accession, read_key, number, count(*) as n from k group by all having count(*) > 1"
ORACLE["unexpected_pair_numbers"] = f"with {KEYED} select run_accession, count(distinct number) as n_numbers from k group by all having count(distinct number) > 2"
STRICT = KEYED.replace(f"coalesce({KEY}, name) as read_key, coalesce({NUMBER}, file_no) as number", f"{KEY} as read_key, {NUMBER} as number").replace("where name is not null)", f"where {KEY} is not null)")
ORACLE["normalize_paired_names"] = f"""with {assembled(STRICT)}, n as (select *, row_number() over (order by run_accession, read_key) as counter, regexp_matches(name_1, {lit(CAS)}) as casava from q),
o as (select run_accession, read_key, counter, case when is_pair then 1 else 0 end as slot, case when casava then name_1 when is_pair then read_key || '/1' else read_key || '/' || number_1 end as name, bases_1 as bases from n
  union all select run_accession, read_key, counter, 2, case when casava then name_2 else read_key || '/2' end, bases_2 from n where is_pair)
select run_accession, read_key, counter, slot, 'OUT.' || counter || ' ' || name as output_name, translate(bases, 'Uu', 'Tt') as bases from o"""
ORACLE["normalize_single"] = f"with {READS} select read_id, 'OUT.' || read_no || ' ' || name as output_name, translate(bases, 'Uu', 'Tt') as bases from r where name is not null"
ORACLE["normalize_counts"] = f"with {READS} select count(*) as n_reads, sum(length(bases))::bigint as n_bases from r"
ORACLE["read_limit"] = f"with {READS} select read_id, file_id, read_no from r where read_no <= 100"
ORACLE["interleaved_until_shorter"] = f"""with {RUN_READS}, z as (select run_accession, file_no, max(read_no) as n from rr group by all), e as (select *, row_number() over (partition by run_accession order by n, file_no) as k from z)
select rr.run_accession, rr.file_no, rr.read_no, rr.read_id from rr join e on rr.run_accession = e.run_accession and e.k = 1 where rr.read_no < e.n + 1 or (rr.read_no = e.n + 1 and rr.file_no < e.file_no)"""
ORACLE["union_files"] = f"with {READS} select file_no, count(*) as n from r where file_no in (1, 2) group by file_no"
ORACLE["derived_pair_counts"] = """with l as (select distinct l_orderkey as key, l_linenumber as no, 32 as size from lineitem where l_linenumber <= 2), p as (select key, count(*) as n, sum(size) as size from l group by key)
select count(*) filter (n = 2) as n_pairs, count(*) filter (n = 1) as n_orphans, sum(n)::bigint as n_reads, sum(size)::bigint as n_bases from p"""
ORACLE["duplicate_names"] = f"""with {READS}, x as (select file_id, name, count(*) as n, list_sort(list(read_no))[1:100] as p from r where name is not null group by all having count(*) > 1)
select file_id, name, n, array_to_string(p, ',') as places from x"""
ORACLE["possible_duplicates"] = f"with {READS} select file_id, count(name) as n_added, count(name) - count(distinct name) as n_possible_duplicates from r group by file_id"
VRUN = f"{READS}, {VALIDATOR}, w as (select v.*, run_accession from v join manifest_files using (file_id))"
PAIRING = f"""{VRUN}, mn as (select run_accession, min(file_id) as main from w group by all), sz as (select file_id, count(*) as n from w group by all),
pr as (select distinct w.run_accession, main, file_id from w join mn using (run_accession) where file_id <> main),
un as (select pr.run_accession, pr.main, pr.file_id, count(distinct w.key) as d from pr join w on w.run_accession = pr.run_accession and w.file_id in (pr.main, pr.file_id) group by all),
pp as (select un.*, 100.0::double * (a.n + b.n - d) / greatest(a.n, b.n) as pct from un join sz a on a.file_id = main join sz b on b.file_id = un.file_id)"""
ORACLE["pairing_percentage"] = f"with {PAIRING} select run_accession, main as file_1, file_id as file_2, round(pct, 6) as pairing_pct from pp"
ORACLE["label_count"] = f"""with {VRUN}, g as (select run_accession, count(distinct file_id) as n_files, count(distinct label) as n_labels, array_to_string(list_sort(list(distinct label))[1:10], ',') as labels from w group by all)
select *, n_labels > n_files as too_many from g"""


def rule(b: str = "bases", q: str = "quals", n: str = "name") -> str:
    blank = lambda c: f"trim(coalesce({c}, ''), ' ' || chr(9) || chr(13) || chr(10)) = ''"
    return f"""case when {blank(b)} then 'Submitted files must not contain any empty reads' when {blank(q)} then 'Submitted files must not contain any empty quality score lines'
 when length({b}) <> length({q}) then 'Mismatch between length of read bases and qualities' when length(trim({n})) > 256 then 'Read name length exceeds 256 characters'
 when not regexp_matches(upper({b}), '^[ACGTURYSWKMBDHVN.-]+$') then 'Reads must contain only valid IUPAC codes' end"""


ORACLE["insdc_violations"] = f"with {RUN_READS}, x as (select file_id, read_no, {rule()} as rule from rr) select file_id, rule, count(*) as n, min(read_no) as first_read from x where rule is not null group by all"
AUTCG = "length(bases) - length(translate(bases, 'AUTCGautcg', ''))"
FILES = f"""{RUN_READS}, x as (select *, {rule()} as e from rr),
y as (select file_id, count(*) as n_reads, sum(length(coalesce(bases, '')))::bigint as n_bases, coalesce(sum({AUTCG}), 0)::bigint as n_autcg, min(read_no) filter (e is not null) as first_at, arg_min(e, read_no) filter (e is not null) as e from x group by all),
z as (select *, coalesce(e, case when n_bases - n_autcg > n_bases // 2 then 'Reads must contain only valid IUPAC codes, with no more than 50% of bases being non-AUTCG' end) as error from y)"""
ORACLE["autcg_rule"] = f"with {FILES} select file_id, n_bases, n_autcg, n_bases - n_autcg > n_bases // 2 as too_many_others from z"
ORACLE["first_errors"] = f"with {FILES} select file_id, n_reads, error, first_at as read_index from z"
ORACLE["sam_first_errors"] = f"""with {SAM}, x0 as (select record_id, qname as name, case when bases = '*' then '' else bases end as bases, case when quals = '*' then '' else quals end as quals from s), x as (select *, {rule()} as e from x0)
select 0::bigint as file_id, count(*) as n_reads, sum(length(coalesce(bases, '')))::bigint as n_bases, arg_min(e, record_id) filter (e is not null) as error, min(record_id) filter (e is not null) as read_index from x"""
ORACLE["validation_report"] = f"""with {FILES}, st as (select file_id, arg_min(coalesce(regexp_matches(name, {lit(CAS)}), false), read_no) as casava from r group by file_id),
fe as (select rr.file_id, read_no, case when casava and not coalesce(regexp_matches(name, {lit(CAS)}), false) then 'Read name does not match CASAVA18' when not casava and trim(coalesce(name, '')) = '' then 'Read name is blank'
  when not regexp_matches(quals, '^[!-~]*$') then 'Qualities hold characters that can''t be printed' end as e from rr join st using (file_id)),
ff as (select file_id, min(read_no) as first_at, arg_min(e, read_no) as e from fe where e is not null group by all),
w as (select r.file_id, run_accession, case when casava then {cas(1)} else coalesce({suffix(1, SUF4)}, name) end as key, case when casava then {cas(3)} else coalesce({suffix(2, SUF4)}, file_id::varchar) end as label from r join st using (file_id) join manifest_files m using (file_id)),
dn as (select file_id, count(*) as n from (select file_id, name from r where name is not null group by all having count(*) > 1) group by all),
mn as (select run_accession, min(file_id) as main from w group by all), sz as (select file_id, count(key) as n from w group by all), pr as (select distinct w.run_accession, main, file_id from w join mn using (run_accession) where file_id <> main),
un as (select pr.run_accession, pr.main, pr.file_id, count(distinct w.key) as d from pr join w on w.run_accession = pr.run_accession and w.file_id in (pr.main, pr.file_id) group by all),
pp as (select un.run_accession, min(100.0::double * (a.n + b.n - d) / greatest(a.n, b.n)) as pct from un join sz a on a.file_id = main join sz b on b.file_id = un.file_id group by all),
lb as (select run_accession, count(distinct label) as n_labels, count(distinct label) > count(distinct file_id) as too_many from w group by all),
fin as (select m.file_id, case when z.n_reads is null then 'Submitted files must contain a minimum of 1 sequence read' when z.error is not null then z.error when ff.e is not null then ff.e when dn.n > 0 then 'Multiple occurrences of a read name'
  when pct < 20 then 'Detected paired fastq submission with less than 20% of paired reads' when too_many then 'More pair labels than files' end as error,
  coalesce(z.first_at, case when z.error is null then ff.first_at end) as read_index, coalesce(z.n_reads, 0) as n_reads, round(pct, 6) as pairing_pct, coalesce(n_labels, 0) as n_labels
  from manifest_files m left join z using (file_id) left join ff using (file_id) left join dn using (file_id) left join pp using (run_accession) left join lb using (run_accession))
select file_id, error is null as valid, error, read_index, n_reads, pairing_pct, n_labels from fin"""
_VALIDATED = ORACLE["validation_report"]
_HIGH = f"y0 as (select file_id, count(*) filter ({mean('raw_quals')} >= 30) as n_high_quality from r where length(raw_quals) > 0 group by file_id),\nfin as ("
ORACLE["validation_of_quality"] = _VALIDATED.replace("fin as (", _HIGH).replace("when ff.e is not null then ff.e", "when coalesce(n_high_quality, 0) * 2 < z.n_reads then 'When submitted file contains base quality scores then >= 50% of reads must have average quality >= 30' when ff.e is not null then ff.e").replace(
    "coalesce(n_labels, 0) as n_labels", "coalesce(n_labels, 0) as n_labels, coalesce(n_high_quality, 0) as n_high_quality"
).replace("left join ff using (file_id)", "left join y0 using (file_id) left join ff using (file_id)").replace("select file_id, error is null as valid, error, read_index, n_reads, pairing_pct, n_labels from fin", "select file_id, error is null as valid, error, n_reads, n_high_quality from fin")
ORACLE["sam_validation"] = f"""with {SAM}, x0 as (select coalesce(rname, '*') as rname, record_id, qname as name, case when bases = '*' then '' else bases end as bases, case when quals = '*' then '' else quals end as quals from s), x as (select *, {rule()} as e from x0),
y as (select rname, count(*) as n_reads, min(record_id) filter (e is not null) as first_at, arg_min(e, record_id) filter (e is not null) as e, sum(length(coalesce(bases, ''))) as n_bases, coalesce(sum({AUTCG}), 0) as n_autcg from x group by rname),
z as (select rname, n_reads, first_at, coalesce(e, case when n_bases - n_autcg > n_bases // 2 then 'Reads must contain only valid IUPAC codes, with no more than 50% of bases being non-AUTCG' end) as error from y union all select 'no records', 0, null, 'Submitted files must contain a minimum of 1 sequence read')
select rname, error is null as valid, error, first_at as read_index, n_reads from z"""
ORACLE["manifest_encodings"] = """select file_id, lower(file_type) as file_type, case when lower(file_type) <> 'fastq' then null when quality_score like 'PHRED%' then 'phred' when quality_score = 'LOGODDS' then 'log_odds' end as scoring,
  case when lower(file_type) <> 'fastq' then null when quality_score = 'PHRED_33' then 'FROM33' when quality_score = 'PHRED_64' then 'FROM64' end as ascii_offset, compression from manifest_files"""
ORACLE["sam_flags"] = f"with {SAM} select record_id, {SEGMENT} as segment, flags & 2304 <> 0 as not_primary, flags & 512 <> 0 as failed, flags & 16 <> 0 as reverse from s"
ORACLE["sam_filter_counters"] = f"""with {SAM} select count(*) as total, count(*) filter (flags & 2304 <> 0) as skipped_secondary, count(*) filter (flags & 2304 = 0 and flags & 512 <> 0) as skipped_qc, count(*) filter (flags & 2816 = 0) as n_reads,
  sum(case when flags & 2816 = 0 and bases <> '*' then length(bases) else 0 end)::bigint as n_bases from s"""
ORACLE["first_reverse_read"] = f"with {SAM} select record_id as record_no, flags, qname, bases, quals from s where flags & 2816 = 0 and flags & 16 <> 0 order by record_id limit 1"
SAM_READS = f"""{SAM}, a as (select record_id, qname, flags, {SEGMENT} as seg, case when coalesce(bases, '*') = '*' then '' else bases end as b, coalesce(quals, '*') as q from s where flags & 2816 = 0),
e as (select record_id, qname, seg, case when flags & 16 <> 0 then translate(reverse(b), 'ACGTacgt', 'TGCAtgca') else b end as bases, case when q = '*' then repeat('!', length(b)) when flags & 16 <> 0 then reverse(q) else q end as quals from a),
n as (select *, row_number() over (partition by qname order by record_id) as k, count(*) over (partition by qname) as n from e where seg > 0),
u as (select *, (k - 1) // 2 as pair_no, case when k = n and n % 2 = 1 then 1 else 2 end as size from n),
o as (select record_id, case when size = 2 then row_number() over (partition by qname, pair_no order by seg, record_id) else 0 end as segment_index, qname, bases, quals from u union all select record_id, 0, qname, bases, quals from e where seg = 0)"""
ORACLE["sam_to_fastq"] = f"with {SAM_READS} select record_id, segment_index::integer as segment_index, case when segment_index > 0 then qname || '/' || segment_index else qname end as name, bases, quals from o"
ORACLE["fastq_to_sam"] = f"""with {assembled()}, x as (select run_accession, read_key as qname, case when is_pair then 77 else 4 end as flags, name_1 as name, bases_1 as bases, quals_1 as quals from q union all select run_accession, read_key, 141, name_2, bases_2, quals_2 from q where is_pair)
select run_accession, qname, (flags | case when ({cas(4)}) = 'Y' then 512 else 0 end)::integer as flags, nullif(substr({cas(6)}, 2), '') as barcode,
  case when not regexp_matches(coalesce(bases, ''), '^[.acmgrsvtwyhkdbnACMGRSVTWYHKDBNuU]+$') then 'SAM_RECORD_ERROR' when length(bases) <> length(coalesce(quals, '')) then 'BASES_QUALITIES_LENGTH_MISMATCH' end as error, translate(bases, 'Uu', 'Tt') as bases from x"""
ORACLE["generated_names"] = f"""with {READS}, w as (select read_id, string_split(name, ' ')[2] as w from r where name like '% %')
select read_id, try_cast(case when length(w) > 2 and regexp_matches(w, '/.$') then w[:-3] else w end as integer) is not null and regexp_matches(case when length(w) > 2 and regexp_matches(w, '/.$') then w[:-3] else w end, '^[-+]?[0-9]+$') as generated from w"""
_TAG = "nullif(trim(tags['{}']), '')"
SQ = f"""h as (select line_no, {_TAG.format('SN')} as sn, try_cast({_TAG.format('LN')} as bigint) as ln, lower({_TAG.format('M5')}) as m5 from sam_headers where record = 'SQ'),
sq as (select * from h where sn is not null qualify row_number() over (partition by sn order by line_no) = 1)"""
ORACLE["sq_dictionary"] = f"with {SQ} select line_no, sn, ln, m5 from sq"
ORACLE["missing_checksums"] = f"with {SQ} select line_no, sn from sq where m5 is null"
ORACLE["read_groups"] = f"select line_no, {_TAG.format('ID')} as id, {_TAG.format('SM')} as sm from sam_headers where record = 'RG'"
ORACLE["reference_paths"] = f"with {SQ} select sn, 'cache/' || m5[1:2] || '/' || m5[3:5] || '/' || m5[6:] as path from sq where m5 is not null"
ORACLE["reference_checksums"] = f"""with {SQ}, c as (select *, case when line_no % 2 = 0 then md5(translate(md5(sn), '0123456789abcdef', 'ACGTACGTACGTACGN')) end as computed from sq)
select sn, coalesce(m5, computed) as m5, computed, case when computed is null then 'no_sequence' when m5 is null then 'filled' when m5 = computed then 'equal' else 'differs' end as verdict from c"""
ORACLE["records_per_reference"] = f"with {SQ}, {SAM}, n as (select rname as sn, count(*) as n from s group by all) select n.sn, n.n, ln, m5 from n left join sq using (sn)"
PACKED = SAM + ", b as (select record_id, upper(translate(bases, 'Uu', 'Tt')) as b from s)"
ORACLE["packed_bases"] = f"with {PACKED} select record_id, ((3 * length(b) + 7) // 8)::integer as packed_bytes, ((length(b) + 1) // 2)::integer as squeezed_bytes, true as same from b where regexp_matches(b, '^[ACGTN]+$')"
ORACLE["packed_scores"] = f"with {SAM} select record_id, ((6 * length(quals) + 7) // 8)::integer as packed_bytes from s where regexp_matches(quals, '^[!-~]+$') and quals <> '*'"

# ---------------------------------------------------------------- files

WHOLE = "name is not null and length(name) <= 256 and length(bases) = length(raw_quals) and regexp_matches(bases, '^[ACGTNacgtn]+$') and regexp_matches(raw_quals, '^[!-~]+$')"
ORACLE["fastq_round_trip"] = ORACLE["fastq_gzip_round_trip"] = f"with {RUN_READS} select name, bases, quals from rr where {WHOLE}"
ORACLE["fastq_lenient_round_trip"] = f"with {RUN_READS} select name, bases, quals from rr where {WHOLE} and not regexp_matches(name, {lit(CAS)})"
_TAGS = "array_to_string(list_sort(list_transform(list_filter(map_entries(tags), lambda e: e.value is not null), lambda e: e.key || '=' || e.value)), ';')"
ORACLE["sam_round_trip"] = f"""select {", ".join(f"coalesce({c}, 0)::integer as {c}" for c in ("flags", "pos", "pnext", "tlen"))}, {", ".join(f"coalesce({c}, '*') as {c}" for c in ("qname", "rname", "mapq", "cigar", "rnext", "bases", "quals"))},
  coalesce({_TAGS}, '') as tags from (select any_value(columns(* exclude (record_id, loaded_at, tags))), first(tags) as tags from sam_records group by record_id) where qname is not null and trim(qname) <> '' and qname not like '@%'"""
ORACLE["sam_header_round_trip"] = f"select record, coalesce({_TAGS}, '') as tags from sam_headers where record in ('HD', 'SQ', 'RG')"
ORACLE["bam_round_trip"] = ORACLE["fastq_to_sam"].replace("select run_accession, qname, (flags", "select * from (select qname, quals, (flags", 1).replace("translate(bases, 'Uu', 'Tt') as bases from x", "replace(upper(translate(bases, 'Uu', 'Tt')), '.', 'N') as bases from x) where error is null and length(qname) <= 254 and regexp_matches(quals, '^[!-~]+$') and quals <> '*'").replace(
    "select * from (", "select qname, flags, bases, quals, barcode from ("
)
ORACLE["sam_to_fastq_files"] = f"with z as ({ORACLE['sam_to_fastq']}) select segment_index, name, bases, quals from z where name is not null and bases <> '' and length(bases) = length(quals)"
ORACLE["sam_to_fastq_counts"] = f"with z as ({ORACLE['sam_to_fastq']}) select segment_index, count(*) as n_reads, sum(length(bases))::bigint as n_bases, count(*) as n_names from z group by segment_index"

# ---------------------------------------------------------------- problems 3 and 4

_WS = "' ' || chr(9) || chr(13) || chr(10)"
_ODDS = ", ".join(f"({c}, {max(0, math.floor(10 * math.log10(10 ** ((c - 64) / 10) + 1) + 0.5))})" for c in range(33, 127))
_WORDS = r"^([A-Za-z][A-Za-z()_%\-]*(?:\s+[A-Za-z(][A-Za-z()_%\-]*)*\s*[:=]?\s+)[-+.\d]"
_LIST = r"^(?:[A-Za-z][A-Za-z()_%\-]*(?:\s+[A-Za-z(][A-Za-z()_%\-]*)*\s*[:=]?\s+)?([-+.\d][-+0-9.eE%,;|/\s]*)$"
_SCORED = rf"""
with c0 as (select distinct read_id, file_id, trim(bases, {_WS}) as b, trim(raw_quals, {_WS}) as q from seq_reads where trim(raw_quals, {_WS}) not in ('', '*')),
c1 as (select *, regexp_extract(q, '{_LIST}', 1) as body, lower(regexp_replace(regexp_extract(q, '{_WORDS}', 1), '[^A-Za-z]', '', 'g')) as word from c0),
c2 as (select *, list_filter(regexp_split_to_array(trim(body, {_WS}), '[,;|/\s]+'), lambda x: x <> '') as items from c1),
c as (select *, body <> '' and len(list_filter(items, lambda x: not regexp_matches(x, '^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?%?$'))) = 0 and (word <> '' or regexp_matches(q, '\s') or length(q) is distinct from length(b)) and (len(items) > 1 or word <> '' or length(b) = 1) as is_list from c2),
seen as (select file_id, bool_or(not is_list and regexp_matches(q, '[!-:]')) as low, bool_or(not is_list and regexp_matches(q, '[;-?]')) as mid, bool_or(is_list and len(list_filter(items, lambda x: x like '-%')) > 0) as negative from c group by file_id),
m as (select file_id, quality_score as s, lower(remark) as t from manifest_files),
said as (select *, regexp_matches(t, 'odds|solexa') as odds, regexp_matches(t, '(phred|offset|ascii|sanger|fastq qualities).*33|33 based|sanger|standard fastq qualities') as r33,
  regexp_matches(t, '(phred|ascii|offset|shifted).*64') as r64, regexp_matches(t, 'phred') as phred from m),
files as (select seen.file_id,
  case when odds then 'ODDS' when r33 then '33' when r64 then '64' when s = 'LOGODDS' then 'ODDS' when s = 'PHRED_33' then '33' when s = 'PHRED_64' then '64' when low then '33' when mid then 'ODDS' else '64' end as encoding,
  case when odds then 'LOGODDS' when r33 or r64 or phred then 'PHRED' when s = 'LOGODDS' then 'LOGODDS' when s like 'PHRED%' then 'PHRED' when negative then 'LOGODDS' else 'PHRED' end as scale
  from seen left join said using (file_id)),
rows_ as (select c.*, encoding, scale, word like '%err%' or word = 'p' or word like 'prob%' or q like '%\%%' escape '\' or (not regexp_matches(word, 'phred|odds|solexa') and regexp_matches(body, '\d\.|\.\d|\d[eE]')) as is_p from c join files using (file_id) where is_list or encoding <> '33'),
odds(code, phred) as (values {_ODDS}),
texts as (select read_id, encoding, unnest(string_split(q, '')) as ch from rows_ where not is_list),
t as (select read_id, sum(case when encoding = '64' then ascii(ch) - 64 else phred end) as phred_total from texts join odds on code = ascii(ch) group by read_id),
nums as (select read_id, is_p, scale, unnest(items) as x from rows_ where is_list),
vals as (select *, replace(x, '%', '')::double / case when x like '%\%%' escape '\' then 100 else 1 end as v from nums),
l as (select read_id, sum(case when is_p then case when v > 0 then floor(-10 * log10(v) + 0.5) else 0 end when scale = 'LOGODDS' then floor(10 * log10(pow(10.0::double, v / 10) + 1) + 0.5) else floor(v + 0.5) end) as phred_total from vals group by read_id),
every as (select * from t union all select * from l)
"""
ORACLE["p3_found"] = _SCORED + "select read_id, phred_total::bigint as phred_total from every"
ORACLE["p3_units"] = _SCORED + r"""select case when is_list and q like '%\%%' escape '\' then 'PERCENT' when is_list and is_p then 'PROBABILITY' when is_list then scale || '_LIST' when encoding = 'ODDS' then 'LOGODDS_64' else 'PHRED_64' end as unit, count(*) as n_reads,
  sum(case when is_list then len(items) else length(q) end)::bigint as n_values, sum(phred_total)::bigint as phred_total from rows_ join every using (read_id) group by all"""
_BLANK = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_PARSED = f"""
with d as (select distinct raw_id, lower(trim(layout)) as kind, raw_text as t from raw_reads),
b as (select *, case when kind = 'fastq' and len(regexp_split_to_array(t, '\r?\n')) = 4 then t else regexp_replace(t, '\r?\n$', '') end as body from d),
csv as (select raw_id, kind, body, regexp_matches(body, '^(?:[^,"\n]*|"(?:[^"]|"")*")([,\n](?:[^,"\n]*|"(?:[^"]|"")*"))*$') as quoted, regexp_extract(body, '^([^,"\n]*|"(?:[^"]|"")*"),([^,"\n]*|"(?:[^"]|"")*"),([^,"\n]*|"(?:[^"]|"")*")$', ['a', 'b', 'c']) as f,
  regexp_matches(body, '^([^,"\n]*|"(?:[^"]|"")*"),([^,"\n]*|"(?:[^"]|"")*"),([^,"\n]*|"(?:[^"]|"")*")$') as fits from b where kind = 'csv'),
un as (select raw_id, kind, quoted, fits, case when f.a like '"%' then replace(f.a[2:-2], '""', '"') else f.a end as name, case when f.b like '"%' then replace(f.b[2:-2], '""', '"') else f.b end as bases, case when f.c like '"%' then replace(f.c[2:-2], '""', '"') else f.c end as quals, null::varchar[] as nums from csv),
fq as (select raw_id, regexp_split_to_array(body, '\r?\n') as l from b where kind = 'fastq'),
sm as (select raw_id, body, string_split(body, chr(9)) as l from b where kind = 'sam'),
every as (select * from un
  union all select raw_id, 'fastq', true, len(l) = 4 and l[1] like '@%' and l[3] like '+%', l[1][2:], l[2], l[4], null from fq
  union all select raw_id, 'sam', true, len(l) >= 11 and not contains(body, chr(10)) and len(list_filter(l[12:], lambda x: not regexp_matches(x, '^[A-Za-z][A-Za-z0-9]:[A-Za-z]:.*$'))) = 0, l[1], case when l[10] = '*' then '' else l[10] end, case when l[11] = '*' then '' else l[11] end, [l[2], l[4], l[8], l[9]] from sm
  union all select raw_id, kind, true, false, null, null, null, null from b where kind is null or kind not in ('csv', 'fastq', 'sam')),
j as (select raw_id, name, bases, quals, case when not coalesce(quoted, true) then 'quoting' when not coalesce(fits, false) then 'columns' when {_BLANK.format('name')} = '' or length({_BLANK.format('name')}) > 256 then 'name'
  when {_BLANK.format('bases')} = '' or not regexp_matches(bases, '^[ACGTURYSWKMBDHVNacgturyswkmbdhvn.-]+$') then 'bases' when {_BLANK.format('quals')} = '' or not regexp_matches(quals, '^[!-~]+$') then 'quals'
  when len(list_filter(nums, lambda x: not regexp_matches(x, '^[-+]?[0-9]+$'))) > 0 then 'number' when length(bases) <> length(quals) then 'length' end as reason from every)"""
ORACLE["p4_found"] = _PARSED + "select raw_id, reason from j where reason is not null"
ORACLE["p4_loaded"] = _PARSED + f"select raw_id, {_BLANK.format('name')} as name, bases, quals from j where reason is null"
