"""Near-duplicate sequences by multiple-global-order prefix filtering (problem 1).

Two sequences are alike when at least ``threshold`` of the letters of each lie in stretches of
``k`` or more letters that also occur in the other.  Of every k letters one token is taken: that with the least hash among the ``window``
substrings of ``k - window + 1`` letters (a minimiser).  It depends on those k letters only, so a stretch of k or more letters that two
texts share gives both the same tokens.

No link is lost, by this bound: an alike sequence of length L has ``threshold * L`` letters in shared stretches; each lies within k
letters whose token is shared, so a shared token accounts for at most ``k + window - 1`` letters around each of its places.  Tokens held
by more than ``hot`` texts ("hot": adapters, low complexity) propose nothing; the letters they may account for are taken off
the need.  With n sharable tokens of which at least o must be shared, any global token order puts
a shared token among the first n - o + 1 of either text.  Three orders are used (rarity, and two
hashes); the tokens of a text that are in none of its prefixes are not indexed.  A pair becomes a
candidate only if it shares a prefix token under *every* order and, among the indexed tokens, as many as
either needs, less those that either of the two left out; then it is verified letter for letter.  Texts that hot tokens alone may cover to
the threshold are compared among themselves over their hot tokens by the same filter, so the cut loses nothing.

Exact copies are one class: the work is done once per text.  Pairs of copies are written out for
classes up to ``expand`` members; of a larger class each member is paired with its representative
(the smallest id), and other texts with the representative only.

Defined cases: null, blank and ``*`` sequences and those shorter than k are alike to nothing but
their exact copies of k letters or more; letter case and U/T don't count; ids that repeat count
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import materialise, stripped

K, THRESHOLD, HOT, EXPAND = 16, 0.8, 256, 32
#: Substrings of which one is a token: a wider window gives fewer tokens, but shorter ones, which more unlike texts share.
WINDOW = 3


def sequences(records: DataFrame, k: int = K) -> DataFrame:
    """``(id, text)``: normalised sequences of at least k letters, one row per id."""
    text = F.translate(F.upper(stripped(F.col("bases"))), "U", "T")
    rows = records.select(F.col("record_id").alias("id"), text.alias("text"))
    return rows.where((F.length("text") >= k) & F.col("id").isNotNull()).groupBy("id").agg(F.first("text").alias("text"))


def kmer_codes(joined: np.ndarray, k: int) -> np.ndarray:
    """64-bit codes of all k-letter windows of a byte array."""
    if len(joined) < k:
        return np.zeros(0, np.int64)
    mul, n = np.uint64(0x9E3779B97F4A7C15), len(joined) - k + 1
    code, letters = np.zeros(n, np.uint64), joined.astype(np.uint64)
    for j in range(k):
        code = code * mul + letters[j : j + n]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return (code ^ (code >> np.uint64(32))).view(np.int64)


#: Texts whose tokens are made at a time, which bounds a worker's memory.
SLICE = 1000


#: Kinds of posting rows: of a token not known to be hot, of one known to be, and the mark that a token is.
PLAIN, KNOWN, MARK = 0, 1, 2
#: How a row's ``at`` tells its kind: ``_KNOWN`` is added, a mark has -1.
_KNOWN = 1 << 62
#: Tokens whose numbers a partition remembers; the rarer half is forgotten beyond, which makes it find hot ones later.
REMEMBERED = 1 << 18


def minimisers(codes: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, place)`` of the tokens taken: in each text, of every ``window`` consecutive codes the least (the first of equals).

    ``first``: where each text begins in ``codes``; ``n``: its number of windows.
    """
    owner = np.repeat(np.arange(len(n)), n)
    begin = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = first[owner] + begin
    least, chosen = codes[at], begin.copy()
    for j in range(1, window):
        other = codes[at + j]
        less = other < least
        least, chosen = np.where(less, other, least), np.where(less, begin + j, chosen)
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]) if len(chosen) else np.zeros(0, bool)
    return owner[new], chosen[new]


def _explode(k: int, window: int, hot: int):
    """Postings ``(token, id, at)`` of texts; ``at`` holds kind, place and size.

    A token that passes ``hot`` rows within a partition is known to be hot from then on: its further rows need not meet at
    the token, only one mark per partition does.  So a token held by a third of all texts sends no more than about
    ``hot`` rows per partition to one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}  # tokens met several times in a slice
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t.encode("latin-1", "replace") for t in batch.column(1).to_pylist()]  # a byte per letter
            sizes = np.array([len(t) for t in texts], np.int64)
            codes = kmer_codes(np.frombuffer(b"".join(texts), np.uint8), k - window + 1)
            starts = np.cumsum(sizes) - sizes
            owner, place = minimisers(codes, starts, sizes - k + 1, window)
            token = codes[starts[owner] + place]
            known = np.fromiter((t for t, c in seen.items() if c > hot), np.int64)
            tokens, counts = np.unique(token, return_counts=True)
            fresh = []
            for t, c in zip(tokens[counts > 3].tolist(), counts[counts > 3].tolist()):
                before = seen.get(t, 0)
                seen[t] = before + c
                if before <= hot < before + c:
                    fresh.append(t)
            if len(seen) > REMEMBERED:
                seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: REMEMBERED // 2])
            at = (place << 32) | sizes[owner]
            if len(known):
                at |= np.where(np.isin(token, known), _KNOWN, 0)
            marks = np.array(fresh, np.int64)
            cat = lambda x, y: pa.array(np.concatenate([x, np.full(len(marks), y, x.dtype)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([token, marks])), cat(ids[owner], 0), cat(at, -1)], names=["token", "id", "at"])

    return run


def _shared(hot: int):
    """Rows sorted by token, marks first: drops tokens met once; adds ``df``, which is ``hot + 1`` for all hot tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int8)]
        flood = None  # a hot token whose rows still come

        def out(token, ident, at, df):
            at = at & (_KNOWN - 1)
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(ident), pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(df.astype(np.int64))], names=["token", "id", "place", "size", "df"])

        def settle(token, ident, at, kind):
            """Runs that are whole."""
            if not len(token):
                return None
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(first, len(token)))
            count = np.add.reduceat((kind != MARK).astype(np.int64), first)
            count = np.where(np.maximum.reduceat(kind, first) != PLAIN, hot + 1, np.minimum(count, hot + 1))
            df = np.repeat(count, length)
            keep = (df > 1) & (kind != MARK)
            return out(token[keep], ident[keep], at[keep], df[keep])

        for batch in batches:
            fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kinds = np.where(fresh[2] < 0, MARK, np.where(fresh[2] >= _KNOWN, KNOWN, PLAIN)).astype(np.int8)
            rows = [np.concatenate([h, c]) for h, c in zip(held, [*fresh, kinds])]
            if flood is not None:
                n = int(np.searchsorted(rows[0], flood, "right"))
                keep = rows[3][:n] != MARK
                yield out(*(r[:n][keep] for r in rows[:3]), np.full(int(keep.sum()), hot + 1))
                rows = [r[n:] for r in rows]
                flood = flood if not len(rows[0]) else None
            if not len(rows[0]):
                held = rows
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if (whole := settle(*(r[:cut] for r in rows))) is not None:
                yield whole
            held = [r[cut:] for r in rows]
            if len(held[0]) > hot + 1 or held[3][0] != PLAIN:
                flood = int(held[0][0])
                keep = held[3] != MARK
                yield out(*(r[keep] for r in held[:3]), np.full(int(keep.sum()), hot + 1))
                held = [r[:0] for r in held]
        if (whole := settle(*held)) is not None:
            yield whole

    return run


def _mix(tokens: np.ndarray, seed: int) -> np.ndarray:
    x = tokens.view(np.uint64) * np.uint64(seed)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


#: The two comparisons: over rare tokens, and over all tokens of the texts that hot tokens may cover to the threshold.
RARE, COVERED = 0, 1


def _prefixes(k: int, window: int, threshold: float, hot: int):
    """Per text and comparison: which of its tokens lie in a prefix, as bits; how many a partner must share (``o``); how many lie in none (``left``)."""

    def kept(token: np.ndarray, df: np.ndarray, need: float) -> tuple | None:
        token, first, times = np.unique(token, return_index=True, return_counts=True)
        reach = np.cumsum(np.sort(times)[::-1] * (k + window - 1))
        if not len(token) or reach[-1] < need:
            return None
        o = int(np.searchsorted(reach, need)) + 1
        length, bits = len(token) - o + 1, np.zeros(len(token), np.int32)
        for b, order in enumerate((np.lexsort((token, df[first])), np.argsort(_mix(token, 0xD6E8FEB86659FD93)), np.argsort(_mix(token, 0xA0761D6478BD642F)))):
            bits[order[:length]] |= 1 << b
        some = bits > 0
        return token[some], bits[some], o, int((~some).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            out: list[tuple] = []
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            tokens, places, dfs = (c.to_numpy() for c in batch.column(2).flatten().flatten())
            for ident, size, lo, hi in zip(ids, sizes, ends, ends[1:]):
                token, df = tokens[lo:hi], dfs[lo:hi]
                need, is_hot, covered = threshold * size - 1e-9, df > hot, 0
                if is_hot.any():
                    at = np.sort(places[lo:hi][is_hot].astype(np.int64))
                    low, high = np.maximum(at - window + 1, 0), np.minimum(at + k, size)
                    covered = int((np.minimum(high, np.append(low[1:], size)) - low).sum())
                # of two covered texts that share no rare token hot ones tell; else any rare token may
                found = [(RARE, kept(token[~is_hot], df[~is_hot], need - covered if covered < need else 0.5))]
                if covered >= need:
                    found.append((COVERED, kept(token, df, need)))
                for comparison, x in found:
                    if x is not None:
                        n = len(x[0])
                        out.append((np.full(n, ident), np.full(n, comparison, np.int8), x[0], x[1].astype(np.int8), np.full(n, x[2], np.int32), np.full(n, x[3], np.int32)))
            cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int8, np.int64, np.int8, np.int32, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "comparison", "token", "bits", "o", "left"])

    return run


@lru_cache(maxsize=1 << 12)
def _substrings(text: str, k: int) -> tuple[list[str], frozenset[str]]:
    """All substrings of k letters, by place and as a set; a text of many pairs is taken apart once."""
    found = [text[i : i + k] for i in range(len(text) - k + 1)]
    return found, frozenset(found)


def coverage(a: str, b: str, k: int = K) -> float:
    """Share of the letters of ``a`` in stretches of k or more that occur in ``b``."""
    held = _substrings(b, k)[1]
    covered = last = 0
    for i, x in enumerate(_substrings(a, k)[0]):
        if x in held:
            covered += min(k, i + k - last)
            last = i + k
    return covered / len(a)


def alike_texts(texts: DataFrame, k: int = K, threshold: float = THRESHOLD, hot: int = HOT, window: int = WINDOW) -> DataFrame:
    """``(a, b)``, a < b: alike pairs among ``(id, text)`` with distinct texts."""
    postings = texts.select("id", "text").mapInArrow(_explode(k, window, hot), "token bigint, id bigint, at bigint")
    # rows meet at their token, but those of tokens known to be hot anywhere; marks come first
    met = postings.repartition(F.when(F.col("at") >= _KNOWN, F.xxhash64("id", "at")).otherwise(F.col("token"))).sortWithinPartitions("token", "at")
    counted = met.mapInArrow(_shared(hot), "token bigint, id bigint, place int, size int, df bigint")
    shared = counted.groupBy("id", "size").agg(F.collect_list(F.struct("token", "place", "df")).alias("items"))
    shared = materialise(shared, "p1-tokens")
    index = shared.mapInArrow(_prefixes(k, window, threshold, hot), "id bigint, comparison tinyint, token bigint, bits tinyint, o int, left int")
    a, b = (index.select("token", "comparison", *(F.col(c).alias(f"{c}_{x}" if c != "id" else x) for c in ("id", "bits", "o", "left"))) for x in "ab")
    # of the tokens shared, only those that neither of the two left out are met
    need = F.greatest("o_a", "o_b") - F.col("left_a") - F.col("left_b")
    met = a.join(b, ["token", "comparison"]).where("a < b").groupBy("a", "b", "comparison").agg(F.bit_or(F.col("bits_a").bitwiseAND(F.col("bits_b"))).alias("bits"), F.count("*").alias("n"), F.max(need).alias("need"))
    pairs = met.where("bits = 7 and n >= need").select("a", "b").distinct()

    @F.pandas_udf("boolean")
    def verified(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([coverage(p, q, k) >= threshold and coverage(q, p, k) >= threshold for p, q in zip(x, y)], dtype=bool)

    text = texts.select("id", "text")
    joined = pairs.join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b")
    return joined.where(verified("text_a", "text_b")).select("a", "b")


def links(records: DataFrame, k: int = K, threshold: float = THRESHOLD, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``(id, rep, n)`` of every sequence, and alike ``(a, b)`` of representatives."""
    rows = materialise(sequences(records, k), "p1-texts")
    classes = rows.groupBy("text").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = materialise(classes, "p1-classes")
    pairs = alike_texts(reps.select(F.col("rep").alias("id"), "text"), k, threshold, hot)
    members = rows.join(reps, "text").select("id", "rep", "n")
    return members, pairs


def p1_found(records: DataFrame, k: int = K, threshold: float = THRESHOLD, hot: int = HOT, expand: int = EXPAND) -> DataFrame:
    """``(record_a, record_b)``: alike pairs; see the module for groups of exact copies."""
    members, pairs = links(records, k, threshold, hot)
    pairs = materialise(pairs, "p1-pairs")
    copies = members.where("n > 1")
    # the ids that stand for a class in pairs with others: all members of a small class, else the representative
    stand = copies.where((F.col("n") <= expand) | (F.col("id") == F.col("rep"))).select("rep", "id")
    swap = lambda p, side: p.join(stand.select(F.col("rep").alias(side), F.col("id").alias("other")), side, "left").withColumn(side, F.coalesce("other", side)).drop("other")
    between = swap(swap(pairs, "a"), "b")
    small = copies.where(F.col("n") <= expand).select("rep", "id")
    within = small.toDF("rep", "a").join(small.toDF("rep", "b"), "rep").where("a < b").select("a", "b")
    star = copies.where((F.col("n") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    every = between.unionByName(within).unionByName(star)
    return every.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b")).distinct()


def p1_groups(records: DataFrame, k: int = K, threshold: float = THRESHOLD, hot: int = HOT, max_rounds: int = 40) -> DataFrame:
    """``(record_id, group_id, n_links)``: connected groups of alike sequences, of every sequence one row.

    Alternating large-star and small-star rounds on the links of representatives; each round is
    written to the shared folder.  ``n_links`` counts the alike other texts.
    """
    members, pairs = links(records, k, threshold, hot)
    pairs = materialise(pairs, "p1-pairs")
    edges, seen = pairs, None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.least("a", "m").alias("p"), F.col("m"), F.col("a").alias("x"), "b")
        small = small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.where("x > m").select(F.col("m").alias("a"), F.col("x").alias("b"))).where("a < b").distinct()
        edges = materialise(small, "p1-star")
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == seen:
            break
        seen = total
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    degree = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = edges.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("root"))
    return members.join(roots, "rep", "left").join(degree, "rep", "left").select(F.col("id").alias("record_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
