"""Quality scores recorded in different units, brought to Phred (problem 3).

The unit of a value may stand in the text itself (words before a list of numbers, a
per-cent sign), in the manifest's ``quality_score`` or in a free-text remark.  All
spellings pass through one alias dictionary:

1. the distinct spellings of all sources are collected (distributed, with map-side combine),
2. a character n-gram inverted index over the vocabulary proposes candidates,
3. a weighted edit distance verifies them, and
4. the resulting dictionary is joined to all rows.

Defined cases: null, blank and ``*`` qualities are no cases; a spelling that matches nothing
has no unit; ties go to the alphabetically first term; rows delivered again count once; empty
tables give an empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import materialise, stripped

# Vocabulary of unit words and what each says.
VOCABULARY = {
    "phred": "PHRED", "sanger": "PHRED33", "standard": "PHRED33", "illumina": "PHRED",
    "logodds": "LOGODDS", "odds": "LOGODDS", "solexa": "LOGODDS",
    "probability": "PROB", "probabilities": "PROB", "error": "PROB", "err": "PROB", "p": "PROB",
    "perror": "PROB", "prob": "PROB",
    "percent": "PERCENT", "percentage": "PERCENT", "pct": "PERCENT",
    "quality": "QUALITY", "qualities": "QUALITY", "qual": "QUALITY", "quals": "QUALITY",
    "score": "QUALITY", "scores": "QUALITY", "q": "QUALITY", "phredscore": "PHRED", "phredscores": "PHRED",
}
UNITS = ("LOGODDS_64", "LOGODDS_LIST", "PERCENT", "PHRED_64", "PHRED_LIST", "PROBABILITY")
#: A spelling matches a term when the weighted distance is at most this share of the longer length.
MAX_DISTANCE = 0.25
#: Letters often mistaken for one another cost half an edit.
CONFUSABLE = {frozenset(p) for p in ("il", "l1", "o0", "s5", "ei", "ao", "sz", "ck", "fp", "yi", "b8")}
#: Alphabet of the text encodings, and the number pattern of written-out lists.
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?%?"
_WORDS = r"^([A-Za-z][A-Za-z()_%\-]*(?:\s+[A-Za-z(][A-Za-z()_%\-]*)*\s*[:=]?\s+)(?=[-+.\d])"


def weighted_distance(a: str, b: str) -> float:
    """Edit distance; confusable letters and doubled letters cost 0.5, neighbours may swap for 1."""
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else 0.5 if frozenset((x, y)) in CONFUSABLE else 1.0
            drop = 0.5 if i > 1 and a[i - 2] == x else 1.0
            add = 0.5 if j > 1 and b[j - 2] == y else 1.0
            best = min(rows[i - 1][j - 1] + swap, rows[i - 1][j] + drop, row[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[i - 2][j - 2] + 1.0)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _grams(column: Column, n: int = 2) -> Column:
    padded = F.concat(F.lit("^"), column, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, n)))


def alias_dictionary(spellings: DataFrame, vocabulary: dict[str, str] | None = None, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Map the distinct values of the first column to ``(spelling, term, concept, distance)``.

    Spellings are lower-cased letters only.  The n-gram index holds the vocabulary alone, so its
    size is that of the vocabulary, not of the data; the spellings stay distributed.
    """
    vocabulary = VOCABULARY if vocabulary is None else vocabulary
    spark = spellings.sparkSession
    terms = spark.createDataFrame(sorted(vocabulary.items()), "term string, concept string")
    index = terms.select("term", "concept", F.explode(_grams(F.col("term"))).alias("gram"))
    words = spellings.toDF("spelling").where(F.length("spelling") > 0).distinct()
    shared = (
        words.select("spelling", F.explode(_grams(F.col("spelling"))).alias("gram"))
        .join(F.broadcast(index), "gram")  # the fixed vocabulary
        .groupBy("spelling", "term", "concept").agg(F.count("*").alias("n"))
        # an edit destroys at most two bigrams, a swap three
        .where(F.col("n") >= F.greatest(F.length("spelling"), F.length("term")) + 1 - 3 * F.ceil(F.greatest(F.length("spelling"), F.length("term")) * 2 * max_distance))
    )

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")

    scored = shared.withColumn("distance", distance("spelling", "term"))
    fits = scored.where(F.col("distance") <= max_distance * F.greatest(F.length("spelling"), F.length("term")) * F.when(F.length("spelling") < 4, 0.0).otherwise(1.0))
    best = fits.groupBy("spelling").agg(F.min(F.struct("distance", "term", "concept")).alias("b"))
    return best.select("spelling", "b.term", "b.concept", "b.distance")


def odds_to_phred(score: float) -> int:
    """Phred of a log-odds score, halves up."""
    return math.floor(10 * math.log10(10 ** (score / 10) + 1) + 0.5)


_SPLIT = re.compile(r"[,;|/\s]+", re.A)
_LISTED = re.compile(r"[-+0-9.eE%,;|/\s]+", re.A)
_ITEM = re.compile(_NUMBER, re.A)
_HEAD = re.compile(_WORDS[1:], re.A)
_DECIMAL = re.compile(r"\d\.|\.\d|\d[eE][-+]?\d", re.A)
#: Bytes a list may end with.
_END = np.isin(np.arange(256), np.frombuffer(b"0123456789.%", np.uint8))


def split_list(q: str, n_bases: int | None) -> tuple[str, list[str]] | None:
    """Words and numbers of a written-out list of scores; nothing for a text of quality characters.

    A text as long as the bases that could be both is text, unless it holds blanks; one number is a list after words, or for one base.
    """
    head = _HEAD.match(q)
    words, body = (head.group(1), q[head.end() :]) if head else ("", q)
    if not _LISTED.fullmatch(body):
        return None
    items = _SPLIT.sub(" ", body).strip(" ").split(" ")
    if not all(map(_ITEM.fullmatch, items)):
        return None
    if not words and not re.search(r"\s", q, re.A) and len(q) == n_bases:
        return None
    return (words.lower(), items) if words or len(items) > 1 or n_bases == 1 else None


def _totals(items: list[str], of: float) -> tuple[int, int, int, int]:
    """Sums of a list's values as Phred, taken as Phred scores, as log-odds, and as probabilities in parts of ``of``; how many are above 0."""
    phred = odds = prob = positive = 0
    for x, n in Counter(items).items():
        v = float(x.rstrip("%"))
        if not math.isfinite(v):
            continue
        phred += n * math.floor(v + 0.5)
        odds += n * math.floor(10 * math.log10(10 ** (min(v, 3000.0) / 10) + 1) + 0.5)
        if v > 0:
            prob += n * math.floor(-10 * math.log10(v / of) + 0.5)
            positive += n
    return phred, odds, prob, positive


_PARSED = "read_id bigint, file_id bigint, is_list boolean, n_values bigint, low boolean, mid boolean, negative boolean, percent boolean, decimal boolean, spelling string, as_64 bigint, as_odds bigint, as_prob bigint, positive bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(read_id, file_id, n_bases, q)``: what each text holds, under every reading of it."""
    odds = np.array([max(0, odds_to_phred(c - 64)) for c in range(256)])
    schema = pa.schema([("read_id", pa.int64()), ("file_id", pa.int64()), ("is_list", pa.bool_()), ("n_values", pa.int64()), *((c, pa.bool_()) for c in ("low", "mid", "negative", "percent", "decimal")), ("spelling", pa.string()), *((c, pa.int64()) for c in ("as_64", "as_odds", "as_prob", "positive"))])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(3).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)  # no text is empty
        lowest = np.minimum.reduceat(data, starts)
        in_mid = np.logical_or.reduceat((data >= 59) & (data <= 63), starts)
        as_64, as_odds, as_prob = np.add.reduceat(data.astype(np.int64), starts) - 64 * sizes, np.add.reduceat(odds[data], starts), np.zeros(n, np.int64)
        positive = np.zeros(n, np.int64)
        lists, negative, percent, decimal = (np.zeros(n, bool) for _ in range(4))
        spelling: list[str | None] = [None] * n
        bases = batch.column(2).to_pylist()
        sizes = sizes.copy()
        for i in np.flatnonzero(np.maximum.reduceat(data, starts) > 127).tolist():
            codes = [ord(c) for c in batch.column(3)[i].as_py()]
            sizes[i], as_64[i] = len(codes), sum(codes) - 64 * len(codes)
            as_odds[i] = sum(odds[c] if c < 256 else 0 for c in codes)
        for i in np.flatnonzero(_END[data[offsets[1:] - offsets[0] - 1]]).tolist():
            q = batch.column(3)[i].as_py()
            if found := split_list(q, bases[i]):
                words, items = found
                lists[i], sizes[i], percent[i] = True, len(items), "%" in q
                negative[i], decimal[i] = any(x.startswith("-") for x in items), bool(_DECIMAL.search(q))
                as_64[i], as_odds[i], as_prob[i], positive[i] = _totals(items, 100.0 if percent[i] else 1.0)
                spelling[i] = re.sub("[^a-z]", "", words) or None
        columns = [batch.column(0), batch.column(1), lists, sizes, ~lists & (lowest < 59), ~lists & in_mid, negative, percent, decimal, spelling, as_64, as_odds, as_prob, positive]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def parse_quality(reads: DataFrame) -> DataFrame:
    """``(read_id, file_id, is_list, n_values, low, mid, negative, percent, decimal, spelling, as_64, as_odds, as_prob, positive)`` of every read with qualities.

    ``as_*``: the sum of the values as Phred, if the text is in Phred at offset 64 or a list of Phred scores, if it is in log-odds, or if it
    is a list of probabilities (of per cent where it says so, ``positive`` of which are above 0); ``low`` and ``mid``: characters below ``;`` and from there to ``?`` in a text.
    """
    q = stripped(F.col("raw_quals"))
    kept = reads.select(F.col("read_id").cast("bigint"), F.col("file_id").cast("bigint"), F.length(stripped(F.col("bases"))).alias("n_bases"), q.alias("q"))
    return kept.where((F.length("q") > 0) & (F.col("q") != "*")).mapInArrow(_parse, _PARSED)


def manifest_facts(manifest: DataFrame) -> DataFrame:
    """What ``remark`` and ``quality_score`` say of each file: scale and offset of either."""
    said = manifest.select("file_id", F.posexplode(F.concat(F.array(F.struct(F.lit("score").alias("place"), F.lower("quality_score").alias("clause"))), F.transform(F.split(F.coalesce(F.lower("remark"), F.lit("")), r"[;\n]"), lambda c: F.struct(F.lit("remark").alias("place"), c.alias("clause"))))).alias("k", "s"))
    said = said.select("file_id", "k", "s.place", "s.clause").where(F.length("clause") > 0)
    # "log odds" and "log-odds" are one word; numbers stand alone
    token = F.regexp_extract_all(F.regexp_replace("clause", r"\blog[\s\-_]+odds", "logodds"), F.lit(r"([a-z]+|\d+(?:\.\d+)?)"), F.lit(1))
    tokens = said.select("file_id", "k", "place", F.explode(token).alias("token"))
    aliases = alias_dictionary(tokens.where(F.col("token").rlike("^[a-z]{3,}$")).select("token"))
    known = tokens.join(aliases.select(F.col("spelling").alias("token"), "concept"), "token", "left")
    has = lambda c: F.coalesce(F.max(F.col("concept") == c), F.lit(False))
    number = lambda n: F.coalesce(F.max(F.col("token") == n), F.lit(False))
    clauses = known.groupBy("file_id", "k", "place").agg(has("PHRED").alias("phred"), has("PHRED33").alias("p33"), has("LOGODDS").alias("odds"), has("QUALITY").alias("quality"), number("33").alias("n33"), number("64").alias("n64"))
    speaks = clauses.where(F.col("phred") | F.col("odds") | F.col("quality") | (F.col("p33") & (F.col("n33") | F.col("quality"))))
    scale = F.when(F.col("odds"), "LOGODDS").when(F.col("phred") | F.col("p33"), "PHRED")
    offset = F.when(F.col("odds"), 64).when(F.col("p33") | F.col("n33"), 33).when(F.col("n64"), 64)
    per = speaks.select("file_id", "place", scale.alias("scale"), offset.alias("offset"))
    wide = per.groupBy("file_id").agg(*(F.max(F.when(F.col("place") == p, F.col(c))).alias(f"{p}_{c}") for p in ("remark", "score") for c in ("scale", "offset")))
    return wide


def to_phred(reads: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(read_id, file_id, unit, phred_total, n_values)`` of every read whose qualities aren't offset-33 text.

    ``unit``: PHRED_64, LOGODDS_64 (text), PHRED_LIST, LOGODDS_LIST, PROBABILITY, PERCENT.
    ``phred_total`` is null where the values can't be read (a probability of 0 has no Phred value
    and counts as nothing).
    """
    # read once; a few numbers a read are written
    parsed = materialise(parse_quality(reads.select("read_id", "file_id", "bases", "raw_quals")), "p3-parsed")
    seen = parsed.groupBy("file_id").agg(F.max("low").alias("low"), F.max("mid").alias("mid"), F.max("negative").alias("negative"))
    facts = seen.join(manifest_facts(manifest), "file_id", "left")
    detected = F.when(F.col("low"), "33").when(F.col("mid"), "ODDS").otherwise("64")
    told = lambda p: (
        F.when(F.col(f"{p}_scale") == "LOGODDS", "ODDS")
        .when(F.col(f"{p}_offset") == 33, "33")
        .when((F.col(f"{p}_offset") == 64) & (F.col(f"{p}_scale") == "PHRED"), "64")
        .when(F.col(f"{p}_offset") == 64, F.when(F.col("low") | F.col("mid"), "ODDS").otherwise("64"))
    )
    scale = lambda p: F.coalesce(F.col(f"{p}_scale"), F.when(F.col(f"{p}_offset") == 33, "PHRED"))
    files = facts.select(
        F.col("file_id").alias("f"), F.coalesce(told("remark"), told("score"), detected).alias("encoding"),
        F.coalesce(scale("remark"), scale("score"), F.when(F.col("negative"), "LOGODDS").otherwise("PHRED")).alias("scale"),
    )
    rows = parsed.join(files, F.col("file_id").eqNullSafe(F.col("f")), "left").drop("f").where(F.col("is_list") | (F.col("encoding") != "33"))
    # the alias dictionary of the lists' own words; rows without words spread over salts that match nothing
    aliases = alias_dictionary(parsed.where("spelling is not null").select("spelling")).select("spelling", "concept")
    key = F.coalesce("spelling", F.concat(F.lit("#"), F.pmod("read_id", F.lit(997)).cast("string")))
    rows = rows.withColumn("spelling", key).join(aliases, "spelling", "left")
    percent = F.col("is_list") & ((F.col("concept") == "PERCENT") | F.col("percent"))
    scored = F.coalesce(F.col("concept").isin("PHRED", "PHRED33", "LOGODDS"), F.lit(False))
    prob = F.col("is_list") & ((F.col("concept") == "PROB") | (~scored & F.col("decimal")))
    unit = F.when(F.coalesce(percent, F.lit(False)), "PERCENT").when(F.coalesce(prob, F.lit(False)), "PROBABILITY").when(F.col("is_list"), F.concat("scale", F.lit("_LIST"))).when(F.col("encoding") == "ODDS", "LOGODDS_64").otherwise("PHRED_64")
    rows = rows.withColumn("unit", unit)
    # per cent that only words tell: each value is worth 20 more
    from_percent = F.col("as_prob") + F.when(F.col("percent"), 0).otherwise(20 * F.col("positive"))
    total = F.when(F.col("unit") == "PERCENT", from_percent).when(F.col("unit") == "PROBABILITY", F.col("as_prob")).when(F.col("unit").startswith("LOGODDS"), F.col("as_odds")).otherwise(F.col("as_64"))
    return rows.select("read_id", "file_id", "unit", total.alias("phred_total"), "n_values")


def once(rows: DataFrame) -> DataFrame:
    """A row for each read; of deliveries that differ the least counts."""
    code = F.create_map(*(F.lit(x) for k, u in enumerate(UNITS) for x in (u, k)))
    packed = rows.select("read_id", F.element_at(code, F.col("unit")).alias("u"), "phred_total", "n_values")
    return packed.groupBy("read_id").agg(F.min(F.struct("u", "phred_total", "n_values")).alias("r")).select("read_id", F.element_at(F.array(*map(F.lit, UNITS)), F.col("r.u") + 1).alias("unit"), "r.phred_total", "r.n_values")


def p3_found(reads: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(read_id, phred_total)`` of each read whose qualities aren't offset-33 text; repeats count once."""
    return to_phred(reads, manifest).groupBy("read_id").agg(F.min("phred_total").alias("phred_total"))
