"""Mixing sources to target weights by iterative proportional fitting (problem 8).

1. Every document gets its size in tokens of a public tokenizer, its source, language and topic.
2. Token masses are added up by (source, language, topic); that table is small by construction:
   sources are those of the targets, languages are two-letter codes, topics the ``TOPICS`` largest.
3. The total size is the largest at which every source's share is met within its repeats.
4. Raking scales the cells' weights (expected copies of a document) to the language and topic shares of
   the corpus and to the source targets in turn, never above a source's repeats; the source step is
   last, so that source shares hold exactly.
5. A document is taken floor(w) times, and once more with probability w - floor(w): its hash, divided
   by that probability, must lie under its source's threshold.  The threshold is where the
   source's tokens meet its target, found by two rounds of counts over all documents, so that
   shares don't depend on the luck of the draw and the same rows give the same selection.

Defined cases: source spellings differing in case and surrounding blanks are one; documents with a
null or untargeted source, an error status, or a null or blank text have no copies; a null or odd
language is ``und``; a repeated ``doc_id`` is one document; a source without documents stays at 0
and the others keep their proportions; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts before merges, published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOPICS, ROUNDS, BINS = 32, 60, 4096


def _token_counts(path: str, pattern: str):
    """Token counts of texts; the tokenizer is loaded once per Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        import tiktoken

        cache = sys.modules.setdefault("_readloom_tokenizers", type(sys)("_readloom_tokenizers")).__dict__
        if path not in cache:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cache[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = cache[path].encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)`` of the usable documents of targeted sources."""
    source = F.lower(F.trim("source"))
    lang = F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2})(?:[-_].*)?$", 1)
    topic = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-zA-Z]+)", 1)
    rows = documents.select(
        "doc_id", source.alias("source"), F.when(lang != "", lang).otherwise("und").alias("lang"), F.when(topic != "", F.lower(topic)).otherwise("none").alias("topic"), "text", "http_status"
    ).where("doc_id is not null and source is not null and (http_status is null or http_status < 400)").where(F.length(F.trim("text")) > 0).drop("http_status")
    wanted = targets.select(F.lower(F.trim("source")).alias("source")).distinct()
    kept = rows.join(wanted, "source", "left_semi").select("doc_id", "source", "lang", "topic", "text")
    counted = kept.mapInArrow(_token_counts(tokenizer, pattern), "doc_id bigint, source string, lang string, topic string, tokens bigint")
    return counted.where("tokens > 0").groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("source", "lang", "topic", "tokens")))


def rake(mass: np.ndarray, source: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, caps: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights per cell: margins of (codes, shares) met as far as the caps allow, sources exactly.

    ``mass``: tokens per cell; ``targets``: tokens per source; ``caps``: repeats per source.
    """
    w = (targets / np.maximum(np.bincount(source, mass, len(targets)), 1e-12))[source]
    cap = caps[source].astype(float)
    for _ in range(rounds):
        for codes, shares in margins:
            now = np.bincount(codes, w * mass, len(shares))
            factor = np.divide(shares * (w * mass).sum(), now, out=np.ones_like(shares), where=now > 0)
            w = np.minimum(w * factor[codes], cap)
        for _ in range(rounds):  # what the cap cuts goes to the source's other cells
            now = np.bincount(source, w * mass, len(targets))
            gap = targets / np.maximum(now, 1e-12)
            if np.all(np.abs(gap[now > 0] - 1) < 1e-9):
                break
            free = w < cap
            room = np.bincount(source[free], (w * mass)[free], len(targets))
            up = np.where(room > 0, (targets - (now - room)) / np.maximum(room, 1e-12), 1.0)
            w = np.minimum(np.where(free | (gap[source] < 1), w * np.where(gap < 1, gap, up)[source], w), cap)
    return w


def plan(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, dict]:
    """``(doc_id, source, lang, topic, tokens, w)`` with the expected copies, and the sources' targets.

    ``docs`` is read three times: give it a written table.
    """
    spark = docs.sparkSession
    goal = targets.where("source is not null and target_share > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()  # the targets' rows
    top = docs.groupBy("topic").agg(F.sum("tokens").alias("n")).orderBy(F.desc("n"), "topic").limit(TOPICS)
    names = [r.topic for r in top.collect()]
    docs = docs.withColumn("topic", F.when(F.col("topic").isin(names), F.col("topic")).otherwise("other"))
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("mass")).orderBy("source", "lang", "topic").collect()  # sources x 677 x (TOPICS + 1) at most
    held = {r.source for r in cells}
    goal = [r for r in goal if r.source in held and r.cap and r.cap > 0]
    index = {r.source: i for i, r in enumerate(goal)}
    cells = [r for r in cells if r.source in index]
    if not cells:
        return docs.limit(0).withColumn("w", F.lit(0.0)), {}
    mass = np.array([r.mass for r in cells])
    source = np.array([index[r.source] for r in cells])
    share = np.array([r.share for r in goal])
    share = share / share.sum()
    caps = np.array([r.cap for r in goal], float)
    total = float(np.min(caps * np.bincount(source, mass, len(goal)) / share))
    margins = []
    for column in ("lang", "topic"):
        values = sorted({r[column] for r in cells})
        codes = np.array([values.index(r[column]) for r in cells])
        margins.append((codes, np.bincount(codes, mass) / mass.sum()))
    w = rake(mass, source, margins, share * total, caps)
    weights = spark.createDataFrame([(r.source, r.lang, r.topic, float(x)) for r, x in zip(cells, w)], "source string, lang string, topic string, w double")
    info = {r.source: {"share": float(s), "tokens": float(s * total), "cap": int(r.cap)} for r, s in zip(goal, share)}
    return docs.join(F.broadcast(weights), ["source", "lang", "topic"]), info  # as many rows as there are cells


def select_copies(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17) -> tuple[DataFrame, dict]:
    """``(doc_id, source, lang, topic, tokens, copies)`` with copies > 0, and the sources' targets."""
    docs = materialise(sized(documents, targets, tokenizer), "p8-sizes")
    planned, info = plan(docs, targets)
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = planned.withColumn("whole", F.floor(F.col("w") + 1e-9).cast("int"))
    part = F.greatest(F.col("w") - F.col("whole"), F.lit(0.0))
    rows = rows.withColumn("rank", F.when(part > 1e-9, u / part))
    rows = materialise(rows, "p8-plan")
    fixed = {r.source: r.n for r in rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("whole")).cast("double").alias("n")).collect()}
    # ranks reach the threshold, near 1, in order; two rounds of bins find it to 1 / BINS**2
    low = {s: 0.0 for s in info}
    left = {s: max(0.0, v["tokens"] - (fixed.get(s) or 0.0)) for s, v in info.items()}
    width = 2.0
    for _ in range(2):
        if not info:
            break
        start = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for s, v in low.items() for x in (s, v))), F.col("source")), F.lit(0.0))
        slot = F.floor((F.col("rank") - start) / (width / BINS)).cast("int")
        bins = rows.where(F.col("rank").isNotNull() & (F.col("rank") >= start) & (F.col("rank") < start + width)).groupBy("source", slot.alias("slot")).agg(F.sum("tokens").cast("double").alias("n")).collect()  # sources x BINS at most
        for s in info:
            per = sorted((r.slot, r.n) for r in bins if r.source == s)
            at, rest = BINS, left[s]
            for k, n in per:
                if n > rest:
                    at = k
                    break
                rest -= n
            low[s], left[s] = low[s] + at * width / BINS, rest
        width /= BINS
    if not info:
        return rows.select("doc_id", "source", "lang", "topic", "tokens", F.lit(0).alias("copies")).limit(0), info
    threshold = F.element_at(F.create_map(*(F.lit(x) for s, v in low.items() for x in (s, v))), F.col("source"))
    copies = F.col("whole") + F.when(F.col("rank") < threshold, 1).otherwise(0)
    return rows.select("doc_id", "source", "lang", "topic", "tokens", copies.cast("int").alias("copies")).where("copies > 0"), info


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """The selection with, on each row, its source's target and reached share of the selected tokens."""
    chosen, info = select_copies(documents, targets, tokenizer, seed)
    chosen = materialise(chosen, "p8-chosen")
    per = {r.source: r.n for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).cast("double").alias("n")).collect()}
    total = sum(per.values()) or 1.0
    rows = [(s, v["share"], per.get(s, 0.0) / total) for s, v in info.items()]
    shares = chosen.sparkSession.createDataFrame(rows, "source string, target_share double, reached_share double")
    return chosen.join(F.broadcast(shares), "source").select("doc_id", "source", "lang", "topic", "tokens", "copies", "target_share", "reached_share")  # a row per target


def report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """``(source, target_share, reached_share, n_documents, n_copies, tokens, most_copies, max_repeats)`` of every target."""
    chosen, _ = select_copies(documents, targets, tokenizer, seed)
    per = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    goal = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
    out = goal.join(per, "source", "left").withColumn("all_tokens", all_tokens)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), zero("n_documents"), zero("n_copies"), zero("tokens"), zero("most_copies"), "max_repeats")
