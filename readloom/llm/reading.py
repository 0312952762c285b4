"""Reading level of each document from word acquisition grades (problem 9).

Training, on at most ``MAX_LABELLED`` labelled documents (those with the smallest hashes of their ids):

* labels of one document are averaged, each annotator weighted by agreement on documents labelled twice;
* a word's grade is read off its distribution over the levels, every level scaled to the same number
  of words: the level by which a share ``ACQUIRED`` of its occurrences has been met;
* the border between two neighbouring levels is a quantile of a document's known-word grades and a cut,
  both chosen on documents whose words were graded without them (two folds).

Prediction covers every document: its main text (lines that end as sentences do, and paragraphs up to
their last full stop; menus, crumbs, notices and footers do not) must be English prose, told by the share
of known words, and long enough to judge.  Its level is one more than the number of borders it passes.

Defined cases: null and empty texts, pages without prose, other languages and error pages have
the level null; labels that are null or of unknown documents are ignored; without usable labels all
levels are null; a repeated ``doc_id`` gives one row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.text import cleaned

#: Bounds of the training sample: labelled documents, and words graded (those in most documents).
MAX_LABELLED, MAX_VOCABULARY = 4000, 100_000
ACQUIRED, LEVELS = 0.2, 5
#: A page is judged on at least so many known words; a graded word occurs in so many labelled documents.
MIN_WORDS, MIN_DOCS = 10, 3
#: Least share of known words, as a share of the labelled documents' median.
KNOWN_SHARE = 0.7
#: A line that does not end as a sentence counts up to its last full stop, from two sentences or so many words on: notices
#: with a button behind them are one shorter sentence.
PARAGRAPH_WORDS = 20
QUANTILES = (0.25, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)

_PROSE_LINE = re.compile(r"[.!?][\"'”’»)\]]*$")
_STOP = re.compile("[.!?](?=[\\s\"'”’)â\ufffd]|$)")  # damaged quotes begin with the last two
_UP_TO_STOP = re.compile(f".*{_STOP.pattern}", re.S)
_WORD = re.compile(r"[^\W\d_]+")


def _prose(line: str) -> str | None:
    """What of a line is prose: all, or up to the last full stop of a paragraph."""
    if _PROSE_LINE.search(line):
        return line if line.count(" ") >= 2 else None
    m = _UP_TO_STOP.match(line)
    return m.group() if m and (m.group().count(" ") >= PARAGRAPH_WORDS - 1 or m.group().count(" ") >= 2 and len(_STOP.findall(m.group())) >= 2) else None


def main_words(text: str | None) -> list[str]:
    """The lower-cased words of a page's prose."""
    if not text:
        return []
    lines = [x for x in (y.strip() for y in cleaned(text).split("\n")) if x]
    prose = [x for x in map(_prose, lines) if x]
    if not prose:
        prose = [m.group() for m in map(_UP_TO_STOP.match, lines) if m and m.group().count(" ") >= 2]
    return _WORD.findall("\n".join(prose).lower())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, words, counts = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n: dict[str, int] = defaultdict(int)
            for w in main_words(text):
                n[w] += 1
            docs += [doc] * len(n)
            words += n.keys()
            counts += n.values()
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "word", "n"])


def word_grades(by_word: dict[str, np.ndarray]) -> dict[str, float]:
    """Grade of each word from its counts by level (0-based)."""
    if not by_word:
        return {}
    counts = np.array(list(by_word.values()), float)
    total = counts.sum(0)
    shares = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    shares /= shares.sum(1, keepdims=True)
    met = np.cumsum(shares, 1)
    level = np.argmax(met >= ACQUIRED - 1e-12, 1)
    row = np.arange(len(met))
    before = np.where(level > 0, met[row, level - 1], 0.0)
    grade = level + 0.5 + (ACQUIRED - before) / shares[row, level]
    return dict(zip(by_word, grade.tolist()))


def _features(tables: list[dict[str, float]], fold_of=None):
    """Rows of quantiles of known-word grades; table 0, or the one ``fold_of`` names for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            words, known, flat, sizes = [], [], [], []
            for doc, text in zip(docs, batch.column(1).to_pylist()):
                w = main_words(text)
                get = tables[fold_of(doc) if fold_of else 0].get
                g = [x for x in map(get, w) if x is not None]
                flat += g
                words.append(len(w)), known.append(len(g))
            grades, sizes = np.array(flat, float), np.array(known, np.int64)
            owner = np.repeat(np.arange(len(docs)), sizes)
            grades = grades[np.lexsort((grades, owner))]
            starts = np.cumsum(sizes) - sizes
            some = sizes > 0
            q = np.zeros((len(QUANTILES), len(docs)))
            for i, p in enumerate(QUANTILES):
                q[i, some] = grades[starts[some] + np.floor(p * (sizes[some] - 1) + 0.5).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.int32()), pa.array(known, pa.int32()), *(pa.array(x) for x in q)], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_words", "n_known", *(f"q{round(100 * p)}" for p in QUANTILES)]
_SCHEMA = "doc_id bigint, n_words int, n_known int, " + ", ".join(f"{n} double" for n in _NAMES[3:])


def annotator_weights(labels: list[tuple]) -> dict:
    """Weight of each annotator: smoothed share of agreement with others on the same document."""
    by_doc, same, seen = defaultdict(list), defaultdict(float), defaultdict(float)
    for doc, level, who in labels:
        by_doc[doc].append((level, who))
    for rows in by_doc.values():
        for i, (level, who) in enumerate(rows):
            for j, (other, _) in enumerate(rows):
                if i != j:
                    seen[who] += 1
                    same[who] += level == other
    return {who: (same[who] + 2) / (seen[who] + 3) for _, _, who in labels}


def borders(features: np.ndarray, levels: np.ndarray) -> list[tuple[int, float]]:
    """For each border between levels the quantile column and cut that part the labelled documents best."""
    out = []
    for level in range(1, LEVELS):
        low, high = features[levels <= level], features[levels > level]
        if not len(low) or not len(high):
            out.append((0, -np.inf if len(high) else np.inf))
            continue
        near_low, near_high = features[levels == level], features[levels == level + 1]
        near_low, near_high = (near_low if len(near_low) else low), (near_high if len(near_high) else high)
        best = None
        for c in range(features.shape[1]):
            a, b = np.quantile(near_low[:, c], 0.97), np.quantile(near_high[:, c], 0.03)
            cut = (a + b) / 2
            wrong = (low[:, c] >= cut).mean() + (high[:, c] < cut).mean()
            key = (round(wrong, 2), -(b - a))
            if best is None or key < best[0]:
                best = (key, c, cut)
        out.append((best[1], float(best[2])))
    return out


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], list[tuple[int, float]], float] | None:
    """(word grades, borders, least share of known words), or None without usable labels."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, LEVELS))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most max_labelled ids
    texts = texts.persist()
    rows = [(r.doc_id, r.reading_level, r.annotator) for r in usable.join(F.broadcast(chosen), "doc_id").select("doc_id", "reading_level", "annotator").distinct().orderBy(F.xxhash64("doc_id")).limit(20 * max_labelled).collect()]
    weights = annotator_weights(rows)
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for doc, level, who in rows:
        sums[doc][0] += weights[who] * level
        sums[doc][1] += weights[who]
    level_of = {d: int(min(LEVELS, max(1, np.floor(s / w + 0.5)))) for d, (s, w) in sums.items()}
    if not level_of:
        return None
    spark = documents.sparkSession
    known = spark.createDataFrame([(d, v) for d, v in level_of.items()], "doc_id bigint, level int")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    counts = texts.mapInArrow(_word_counts, "doc_id bigint, word string, n bigint").join(F.broadcast(known), "doc_id")
    per = counts.groupBy("word", fold.alias("fold"), "level").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    top = per.groupBy("word").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("fold", "level", "n")).alias("cells")).where(F.col("docs") >= MIN_DOCS).orderBy(F.desc("docs"), "word").limit(MAX_VOCABULARY)
    by: list[dict[str, np.ndarray]] = [{}, {}, {}]  # all, without fold 0, without fold 1
    for r in top.collect():
        m = np.zeros((2, LEVELS))
        for c in r.cells:
            m[c.fold, c.level - 1] += c.n
        for table, v in zip(by, (m.sum(0), m[1], m[0])):
            if v.sum():
                table[r.word] = v
    grades = [word_grades(t) for t in by]
    ids = {r.doc_id: r.fold for r in texts.select("doc_id", fold.alias("fold")).collect()}  # at most max_labelled rows
    folds = texts.mapInArrow(_features(grades, lambda d, ids=ids: 1 + ids[d]), _SCHEMA).collect()
    texts.unpersist()
    folds = [r for r in folds if r.n_known >= MIN_WORDS]
    if not folds:
        return None
    x, y = np.array([r[3:] for r in folds], float), np.array([level_of[r.doc_id] for r in folds])
    share = KNOWN_SHARE * float(np.median([r.n_known / r.n_words for r in folds]))
    return grades[0], borders(x, y), share


def reading_levels(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, reading_level, n_words, known_share)`` of every document."""
    model = train(documents, labels, max_labelled)
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    grades, cuts, share = model or ({}, [], 2.0)
    feats = docs.mapInArrow(_features([grades]), _SCHEMA)
    known = F.when(F.col("n_words") > 0, F.col("n_known") / F.col("n_words")).otherwise(0.0)
    level = F.lit(1)
    for c, cut in cuts:
        level = level + F.when(F.col(_NAMES[3 + c]) >= F.lit(cut), 1).otherwise(0)
    judged = (known >= share) & (F.col("n_known") >= MIN_WORDS)
    out = feats.select("doc_id", F.when(judged, level).alias("reading_level"), "n_words", known.alias("known_share"))
    return out.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("reading_level", "n_words", "known_share")))


def p9_found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id)`` of English prose of level 4 or 5."""
    return reading_levels(documents, labels).where("reading_level >= 4").select("doc_id")
