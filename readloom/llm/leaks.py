"""Evaluation passages inside training texts: a distributed positional inverted index (problem 7).

``build_index`` reads the corpus once and knows nothing of any passage: every word of every text becomes a posting.  The index is a
table of segments, each over some consecutive texts of one partition (``SEGMENT_WORDS`` words or ``SEGMENT_DOCS`` texts): its terms,
and their postings (text, place) in order.  A frequent term's postings are so split over all segments, no task ever holds
more than a segment, and writing the index needs no shuffle.  It can be stored and asked any number of times.

A query set is looked up in blocks of ``block`` items, so that neither the driver nor a worker holds more test terms than a block has:

1. The block's terms are counted in the index (only its terms and numbers are read).
2. Every window of ``run`` consecutive words of a passage is anchored at its rarest term; windows with a term that no text
   holds are dropped.
3. Within each segment the postings of an anchor, moved by its place in the passage, are candidate diagonals; the other terms' postings,
   moved alike, are intersected with them from the rarest on.  A missed term rules out all windows that hold it, so
   most candidates end after two lists.  What is left are runs of at least ``run`` words.

Proximity uses the same index: each passage is keyed by its rarest terms (``prefixes``), texts that hold one of them and enough of
the others are measured on their places.

Words are runs of letters or digits, lower-cased.  Tags and character references separate
words; zero-width characters and soft hyphens are nothing; a hyphen between a word's parts at a line
end is dropped with the line end.

Defined cases: null and empty texts and passages match nothing; a passage of fewer than ``run`` words
matches nothing; null ids give no rows; repeated rows give one pair; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.text import words_of
from readloom.session import materialise

RUN, BLOCK, SHARE = 13, 20_000, 0.8
#: A segment ends with the text that reaches either.
SEGMENT_WORDS, SEGMENT_DOCS = 1 << 19, 1 << 13
_INDEX = "segment bigint, docs binary, terms string, ends binary, texts binary, places binary"
#: A posting as one number: the text's ordinal in its segment and the place of the word.
_SHIFT = 34


def _segment(number: int, docs: list[int], lengths: list[int], words: list[str]) -> tuple:
    coded = pa.array(words, pa.string()).dictionary_encode()
    codes, sizes = coded.indices.to_numpy(), np.array(lengths, np.int64)
    order = np.argsort(codes, kind="stable")  # by term, then text and place
    text = np.repeat(np.arange(len(docs), dtype=np.uint16), sizes)
    place = np.arange(len(words), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    return number, np.array(docs, np.int64).tobytes(), "\n".join(coded.dictionary.to_pylist()), ends.astype(np.uint32).tobytes(), text[order].tobytes(), place[order].astype(np.uint32).tobytes()


def _segments(max_words: int, max_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        docs, lengths, words = [], [], []

        def made() -> pa.RecordBatch:
            columns = zip(_segment(number, docs, lengths, words), (pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["segment", "docs", "terms", "ends", "texts", "places"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words_of(text.as_py())
                if not found:
                    continue
                docs.append(doc), lengths.append(len(found))
                words += found
                if len(words) >= max_words or len(docs) >= max_docs:
                    yield made()
                    number, docs, lengths, words = number + 1, [], [], []
        if docs:
            yield made()

    return run


def build_index(documents: DataFrame, segment_words: int = SEGMENT_WORDS, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The index of ``(doc_id, text)``, not yet written."""
    texts = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    return texts.mapInArrow(_segments(segment_words, min(segment_docs, 1 << 16)), _INDEX)


def write_index(documents: DataFrame, path: str, mode: str = "error") -> None:
    """Store the index of a corpus; ``append`` adds a new corpus to it."""
    build_index(documents).write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(path)


class Segment:
    """A segment's postings of the wanted terms, as ascending numbers."""

    def __init__(self, row: dict, wanted) -> None:
        self.docs = np.frombuffer(row["docs"], np.int64)
        ends = np.frombuffer(row["ends"], np.uint32)
        self.at = {t: (int(ends[k - 1]) if k else 0, int(ends[k])) for k, t in enumerate(row["terms"].split("\n")) if t in wanted}
        self.texts, self.places = np.frombuffer(row["texts"], np.uint16), np.frombuffer(row["places"], np.uint32)
        self._lists: dict[str, np.ndarray] = {}
        self._held: dict[str, np.ndarray] = {}

    def postings(self, term: str) -> np.ndarray:
        if term not in self._lists:
            low, high = self.at.get(term, (0, 0))
            self._lists[term] = (self.texts[low:high].astype(np.int64) << _SHIFT) + self.places[low:high]
        return self._lists[term]

    def held(self, term: str) -> np.ndarray:
        """Mask of the texts that hold a term."""
        if term not in self._held:
            low, high = self.at.get(term, (0, 0))
            mask = np.zeros(len(self.docs), bool)
            mask[self.texts[low:high]] = True
            self._held[term] = mask
        return self._held[term]


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of x are among ascending numbers."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _count_terms(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for row in _rows_of(batches):
            sizes = np.diff(np.frombuffer(row["ends"], np.uint32).astype(np.int64), prepend=0)
            for k, t in enumerate(row["terms"].split("\n")):
                if t in wanted:
                    n[t] += int(sizes[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return run


def term_counts(index: DataFrame, terms: frozenset[str]) -> dict[str, int]:
    """How often each of a block's terms occurs."""
    counted = index.select("terms", "ends").mapInArrow(_count_terms(terms), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counted.collect()}  # at most the terms of the block


Anchor = tuple[int, int, int, int]


def anchors(items: dict[int, list[str]], counts: dict[str, int], run: int) -> dict[str, list[Anchor]]:
    """``(item, place, first, last)`` by term: the windows that begin at the places from first to last have their rarest term there."""
    by: dict[str, list[Anchor]] = {}
    for item, words in items.items():
        rarity = [counts.get(w, 0) for w in words]
        open_: list[int] | None = None
        for i in range(len(words) - run + 2):
            at = None
            if i <= len(words) - run:
                n, at = min((rarity[j], -j) for j in range(i, i + run))
                at = -at if n else None
            if open_ and open_[0] == at:
                open_[2] = i
                continue
            if open_:
                by.setdefault(words[open_[0]], []).append((item, *open_))
            open_ = [at, i, i] if at is not None else None
    return by


def _runs(segment: Segment, words: list[str], counts: dict[str, int], anchor: Anchor, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals of an anchor with the first and the last of their matched windows."""
    _, place, first, last = anchor
    diagonal = segment.postings(words[place]) - place
    low, high = np.full(len(diagonal), first), np.full(len(diagonal), last)
    others = sorted((j for j in range(first, last + run) if j != place), key=lambda j: (counts.get(words[j], 0), j))
    for j in others:
        if not len(diagonal):
            break
        missed = ~_among(diagonal + j, segment.postings(words[j]))
        if j < place:
            low[missed] = np.maximum(low[missed], j + 1)
        else:
            high[missed] = np.minimum(high[missed], j - run)
        alive = low <= high
        diagonal, low, high = diagonal[alive], low[alive], high[alive]
    return diagonal, low, high


def _search(items: dict[int, list[str]], counts: dict[str, int], by_anchor: dict[str, list[Anchor]], run: int):
    wanted = frozenset(w for ws in items.values() for w in ws)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            segment = Segment(row, wanted)
            windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for term in by_anchor.keys() & segment.at.keys():
                for anchor in by_anchor[term]:
                    for d, low, high in zip(*(x.tolist() for x in _runs(segment, items[anchor[0]], counts, anchor, run))):
                        windows.setdefault((anchor[0], d), []).append((low, high))
            out = []
            for (item, d), spans in sorted(windows.items()):
                text = (d + (1 << _SHIFT - 1)) >> _SHIFT
                offset, doc = d - (text << _SHIFT), int(segment.docs[text])
                spans.sort()
                first, last = spans[0]
                for low, high in [*spans[1:], (1 << 62, 0)]:
                    if low <= last + 1:
                        last = max(last, high)
                        continue
                    out.append((doc, item, offset + first, first, last - first + run))
                    first, last = low, high
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names=["doc_id", "item_id", "place", "item_place", "length"])

    return runs


_MATCHES = "doc_id bigint, item_id bigint, place int, item_place int, length bigint"


def _blocks(eval_items: DataFrame, run: int, block: int) -> Iterator[dict[int, list[str]]]:
    """The words of the passages, a block at a time."""
    items = eval_items.where("item_id is not null and length(passage) > 0").select("item_id", "passage")
    n = max(1, -(-items.count() // block))
    for b in range(n):
        part = {r.item_id: words_of(r.passage) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()}
        if part := {i: w for i, w in part.items() if len(w) >= run}:
            yield part


def find_phrases(index: DataFrame, eval_items: DataFrame, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, place, item_place, length)``: runs of at least ``run`` words of a passage in an indexed text."""
    every = None
    for items in _blocks(eval_items, run, block):
        terms = frozenset(w for ws in items.values() for w in ws)
        counts = term_counts(index, terms)
        by_anchor = anchors(items, counts, run)
        found = index.mapInArrow(_search(items, counts, by_anchor, run), _MATCHES).distinct()
        every = found if every is None else every.unionByName(found)
    return every if every is not None else index.sparkSession.createDataFrame([], _MATCHES)


def phrase_matches(documents: DataFrame, eval_items: DataFrame, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """As ``find_phrases``, with an index made for it."""
    return find_phrases(materialise(build_index(documents), "p7-index"), eval_items, run, block)


def _least(n: int, share: float) -> int:
    """The least number of n terms, one at least, that reaches the share."""
    return next((k for k in range(1, n + 1) if k / n >= share), n + 1)


def most_terms(places: list[np.ndarray], span: int) -> int:
    """The most terms met within any ``span`` consecutive places; ``places``: of each term, ascending."""
    at = np.concatenate(places)
    before = np.concatenate([np.append(np.int64(-span), p[:-1]) for p in places])
    # an occurrence is the first of its term in the stretches that begin after the one before it and reach it
    begin = np.maximum(before + 1, at - span + 1)
    change = np.repeat([1, -1], len(at))
    order = np.lexsort((change, np.concatenate([begin, at + 1])))
    return int(np.cumsum(change[order]).max())


Passage = tuple[frozenset[str], int, int]


def prefixes(passages: dict[int, Passage], counts: dict[str, int]) -> dict[int, list[str]]:
    """Each passage's rarest terms, one more than may be missing: a text with enough terms holds one of these.

    Terms that no text holds are the rarest, and key nothing.
    """
    return {i: [w for w in sorted(terms, key=lambda w: (counts.get(w, 0), w))[: len(terms) - need + 1] if counts.get(w, 0)] for i, (terms, _, need) in passages.items()}


def _nearest(passages: dict[int, Passage], keys: dict[int, list[str]]):
    """Shares of candidate passages in each text; ``passages``: distinct terms, length, terms needed."""
    wanted = frozenset(w for terms, _, _ in passages.values() for w in terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            segment, out = Segment(row, wanted), []
            for item, (terms, span, need) in passages.items():
                present = [w for w in terms if w in segment.at]
                first = [w for w in keys[item] if w in segment.at]
                if len(present) < need or not first:
                    continue
                near = np.flatnonzero(np.logical_or.reduce([segment.held(w) for w in first]))
                near = near[np.sum([segment.held(w)[near] for w in present], axis=0) >= need]
                for text in near.tolist():
                    low, high = text << _SHIFT, (text + 1) << _SHIFT
                    places = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] - low for x in map(segment.postings, present)]
                    if (n := most_terms([p for p in places if len(p)], span)) >= need:
                        out.append((int(segment.docs[text]), item, n / len(terms)))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, kinds)], names=["doc_id", "item_id", "share"])

    return run


_SHARES = "doc_id bigint, item_id bigint, share double"


def find_near(index: DataFrame, eval_items: DataFrame, share: float = SHARE, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, share)``: indexed texts that hold at least ``share`` of a passage's distinct terms within a
    stretch as long as the passage, in any order.

    The share is the largest over all such stretches, wherever they begin.  No pair is lost: a text is looked at for
    every passage of which it holds one of the rarest terms (see ``prefixes``).  Passages of fewer than ``run`` words
    are left out as in the search for phrases.
    """
    every = None
    for items in _blocks(eval_items, run, block):
        counts = term_counts(index, frozenset(w for ws in items.values() for w in ws))
        passages = {i: (frozenset(w), len(w), _least(len(set(w)), share)) for i, w in items.items()}
        found = index.mapInArrow(_nearest(passages, prefixes(passages, counts)), _SHARES).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
        every = found if every is None else every.unionByName(found)
    return every if every is not None else index.sparkSession.createDataFrame([], _SHARES)


def proximity_matches(documents: DataFrame, eval_items: DataFrame, share: float = SHARE, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """As ``find_near``, with an index made for it."""
    return find_near(materialise(build_index(documents), "p7-index"), eval_items, share, run, block)


def p7_found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: which test items leaked into which documents."""
    return phrase_matches(documents, eval_items).select("doc_id", "item_id").distinct()


def by_suite(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``(suite, doc_id, item_id)``: one index, asked for the items of each suite by themselves."""
    index = materialise(build_index(documents), "p7-index")
    suites = [r.suite for r in eval_items.where("suite is not null").select("suite").distinct().orderBy("suite").collect()]  # a row per suite
    every = None
    for s in suites:
        found = find_phrases(index, eval_items.where(F.col("suite") == s)).select(F.lit(s).alias("suite"), "doc_id", "item_id").distinct()
        every = found if every is None else every.unionByName(found)
    return every if every is not None else index.sparkSession.createDataFrame([], "suite string, doc_id bigint, item_id bigint")
