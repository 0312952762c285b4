"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import distinct, heavy, leaks, mixing, neardup, reading, seen
from readloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    """Register ``f`` under its own name."""
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.p1_found(table(spark, d, "sam_records"))


@query
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.p1_groups(table(spark, d, "sam_records"))


@query
def p2_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return distinct.distinct_counts(table(spark, d, "seq_reads"), table(spark, d, "manifest_files"))


@query
def p2_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The estimates against exact counts, by at most one column."""
    return distinct.accuracy(table(spark, d, "seq_reads"), table(spark, d, "manifest_files"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.p5_found(table(spark, d, "read_arrivals"))


@query
def p5_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_report(table(spark, d, "read_arrivals"))


@query
def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """As p5_found, in four consecutive parts, each answered from the stored filters of those before."""
    return seen.incremental(table(spark, d, "read_arrivals"))


@query
def p5_filter_sizes(spark: SparkSession, d: str) -> DataFrame:
    return seen.filter_sizes(table(spark, d, "read_arrivals"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.p6_found(table(spark, d, "seq_reads"))


@query
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return heavy.frequent(table(spark, d, "seq_reads"))


_ALIKE = """
with recursive s as (select record_id as id, any_value(replace(upper(trim(bases)), 'U', 'T')) as t from sam_records where record_id is not null group by record_id having length(any_value(trim(bases))) >= 16),
k as (select id, length(t) as n, unnest(range(1, length(t) - 14)) as p, t from s), g as (select id, n, p, substr(t, p, 16) as w from k),
hit as (select distinct a.id as a, b.id as b, a.n, a.p from g a join g b on a.w = b.w and a.id <> b.id),
part as (select a, b, n, least(16, coalesce(lead(p) over (partition by a, b order by p) - p, 16)) as covered from hit),
most as (select a, b from part group by a, b having sum(covered) >= 0.8 * any_value(n) - 1e-9),
pair as (select x.a, x.b from most x join most y on x.a = y.b and x.b = y.a where x.a < x.b)
"""
ORACLE["p1_found"] = _ALIKE + "select a as record_a, b as record_b from pair"
ORACLE["p1_groups"] = _ALIKE.rstrip() + """,
edge as (select a, b from pair union all select b, a from pair),
reach as (select id, id as root from s union select edge.b, reach.root from reach join edge on edge.a = reach.id where reach.root < edge.b),
rep as (select id, t, min(id) over (partition by t) as rep from s),
deg as (select x.rep, count(distinct y.rep) as n from edge join rep x on x.id = edge.a join rep y on y.id = edge.b where x.rep <> y.rep group by x.rep)
select rep.id as record_id, r.root as group_id, coalesce(deg.n, 0) as n_links from rep join (select id, min(root) as root from reach group by id) r using (id) left join deg using (rep)
"""
_IDENTIFIERS = r"""
with m as (select file_id, run_accession, upper(trim(center)) as center, platform from manifest_files),
i as (select sequenced_at::date::varchar as day, s.file_id::varchar as file_id, run_accession, center, platform, regexp_replace(trim(name, ' ' || chr(9) || chr(13) || chr(10)), '^@', '') as n,
  replace(upper(trim(bases, ' ' || chr(9) || chr(13) || chr(10))), 'U', 'T') as b from seq_reads s left join m on m.file_id = s.file_id)
"""
ORACLE["p2_accuracy"] = _IDENTIFIERS + " union all ".join(
    f"select '{c}' as grouping, {c or 'null::varchar'} as value, count(distinct n) filter (n not in ('', '*')) as exact_names, count(distinct b) filter (b not in ('', '*')) as exact_bases, true as names_within, true as bases_within from i group by all"
    for c in ("", "day", "center", "platform", "run_accession", "file_id")
)
_ARRIVAL_KEYS = r"""
with t as (select arrival_no, trim(name, chr(32) || chr(9) || chr(13) || chr(10) || chr(160)) as n from read_arrivals),
k as (select arrival_no, case when n like '@%' then substr(n, 2) else n end as key from t)
"""
ORACLE["p5_found"] = _ARRIVAL_KEYS + """
select arrival_no from (select arrival_no, min(arrival_no) over (partition by key) as first from k where length(trim(key)) > 0)
where arrival_no > first
"""
ORACLE["p5_incremental"] = ORACLE["p5_found"]
_VALUES = """
with v as (select distinct read_id, replace(upper(trim(bases, chr(32) || chr(9) || chr(13) || chr(10))), 'U', 'T') as bases from seq_reads),
t as (select count(distinct read_id) as n from v)
"""
ORACLE["p6_found"] = _VALUES + """
select bases from v where bases not in ('', '*') group by bases having count(distinct read_id) >= 0.005 * (select n from t)
"""


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.p7_found(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every matching run with its place and length."""
    return leaks.phrase_matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p7_by_suite(spark: SparkSession, d: str) -> DataFrame:
    """One index, asked for each suite by itself."""
    return leaks.by_suite(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p7_proximity(spark: SparkSession, d: str) -> DataFrame:
    return leaks.proximity_matches(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.p9_found(table(spark, d, "documents"), table(spark, d, "level_labels"))


@query
def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of every document."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


@query
def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The selected documents with their copies."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))

_CLEAN = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{180e}]', '', 'g'),
 '<!--(?s:.*?)-->|</?[A-Za-z!?][^<>]*>', ' ', 'g'), '&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);', ' ', 'g'), '([\pL\pN])[-\x{ad}\x{2010}\x{2011}][ \t\x{a0}]*(?:\r\n|[\n\r\x{2028}\x{85}])[ \t\x{a0}]*([\pL\pN])', '\1\2', 'g')
"""


def _words(column: str) -> str:
    clean = _CLEAN.replace("{}", column, 1)
    return f"list_filter(regexp_split_to_array(lower(replace({clean}, chr(173), '')), '[^\\pL\\pN]+'), lambda w: w <> '')"


_TEXTS = f"""
with d as (select doc_id, {_words('text')} as w from documents where doc_id is not null and length(text) > 0),
i as (select item_id, suite, {_words('passage')} as w from eval_items where item_id is not null and length(passage) > 0)"""
_GRAMS = _TEXTS + """,
iw as (select distinct item_id, suite, k, array_to_string(w[k:k + 12], ' ') as g from (select item_id, suite, w, unnest(range(1, len(w) - 11)) as k from i where len(w) >= 13)),
dw as (select doc_id, k, array_to_string(w[k:k + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d where len(w) >= 13))
"""
ORACLE["p7_found"] = _GRAMS + "select distinct doc_id, item_id from dw join iw using (g)"
ORACLE["p7_by_suite"] = _GRAMS + "select distinct suite, doc_id, item_id from dw join iw using (g) where suite is not null"
ORACLE["p7_matches"] = _GRAMS.rstrip() + """,
m as (select distinct doc_id, item_id, dw.k as dk, iw.k as ik from dw join iw using (g)),
r as (select *, dk - row_number() over (partition by doc_id, item_id, dk - ik order by dk) as island from m)
select doc_id, item_id, (min(dk) - 1)::integer as place, (min(ik) - 1)::integer as item_place, count(*) + 12 as length from r group by doc_id, item_id, dk - ik, island
"""
ORACLE["p7_proximity"] = _TEXTS + """,
t as (select item_id, len(w) as span, len(list_distinct(w)) as n, unnest(list_distinct(w)) as term from i where len(w) >= 13),
o as (select doc_id, unnest(w) as term, unnest(range(len(w))) as place from d),
held as (select doc_id, item_id, any_value(n) as n, any_value(span) as span from (select distinct doc_id, term from o) join t using (term) group by doc_id, item_id having count(*) >= 0.8 * any_value(n) - 1e-9),
pl as (select h.doc_id, h.item_id, h.n, h.span, o.term, o.place from held h join t using (item_id) join o on o.doc_id = h.doc_id and o.term = t.term),
s as (select a.doc_id, a.item_id, a.place, any_value(a.n) as n, count(distinct b.term) as c from (select distinct doc_id, item_id, n, span, place from pl) a join pl b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.place between a.place and a.place + a.span - 1 group by all)
select doc_id, item_id, max(c / n::double) as share from s group by doc_id, item_id having max(c / n::double) >= 0.8
"""
