"""Most frequent values in bounded memory: a heavy-light split (problem 6).

Each partition keeps ``buckets`` exact counters for hot values and a compact array of ``cells``
for all the rest.  A value that meets another one in its bucket votes against it; when the votes
against reach ``evict`` times those for, the resident is evicted into the cell array and the
challenger moves in.  Partitions merge by recombining buckets: votes of the same value add up,
the strongest value stays and the others fall into the cells, which are added.

A value's estimate (bucket plus cell) is never below its true count, so that with support s every
value held by a share s of the rows has its bucket or its cell at s * rows; at most 1/s buckets and
1/s cells reach that.  These few hashes and cells are the only thing that reaches the driver; a
second pass counts exactly the values that fall into them.

Defined cases: values are compared without surrounding blanks, upper-cased and with U as T; null,
blank and ``*`` values are no candidates but count in the total; rows with the same ``read_id`` count
once and null ids not at all; ties are all kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import materialise, stripped

BUCKETS, CELLS, EVICT, SUPPORT = 4096, 1 << 16, 8, 0.005


def normalised(column: str = "bases"):
    """The value compared; null where there is none."""
    text = F.translate(F.upper(stripped(F.col(column))), "U", "T")
    return F.when((F.length(text) > 0) & (text != "*"), text)


class HeavyLight:
    """The sketch of one partition; keys are 64-bit hashes."""

    def __init__(self, buckets: int = BUCKETS, cells: int = CELLS, evict: int = EVICT):
        self.evict, self.mask, self.cell_mask = evict, buckets - 1, cells - 1
        self.key = np.zeros(buckets, np.int64)
        self.votes = np.zeros(buckets, np.int64)
        self.against = np.zeros(buckets, np.int64)
        self.cells = np.zeros(cells, np.int64)
        self.rows = 0

    def drop(self, keys: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.cells, keys & self.cell_mask, counts)

    def add(self, hashes: np.ndarray) -> None:
        self.rows += len(hashes)
        keys, counts = np.unique(hashes, return_counts=True)
        bucket = (keys >> 20) & self.mask
        order = np.lexsort((counts, keys == self.key[bucket], bucket))  # last in each bucket: the resident, else the strongest
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        resident = (keys == self.key[bucket]) & (self.votes[bucket] > 0)
        self.votes[bucket[resident]] += counts[resident]
        others = ~resident
        np.add.at(self.against, bucket[others], counts[others])
        # the strongest newcomer of a bucket, for which the resident may have to go
        strong = np.zeros(len(keys), bool)
        position = np.where(others)[0]
        if len(position):
            b = bucket[position]
            strong[position[np.append(b[1:] != b[:-1], True)]] = True
        moves = strong & (self.against[bucket] >= self.evict * self.votes[bucket])
        at = bucket[moves]
        self.drop(self.key[at], self.votes[at])
        self.key[at], self.votes[at], self.against[at] = keys[moves], counts[moves], 0
        stay = others & ~moves
        self.drop(keys[stay], counts[stay])


def _sketch(buckets: int, cells: int, evict: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = HeavyLight(buckets, cells, evict)
        for batch in batches:
            s.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        b, c = np.where(s.votes > 0)[0], np.where(s.cells > 0)[0]
        slot = np.concatenate([b, c])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.ones(len(b), bool), np.zeros(len(c), bool)])), pa.array(slot.astype(np.int32)),
            pa.array(np.concatenate([s.key[b], np.zeros(len(c), np.int64)])), pa.array(np.concatenate([s.votes[b], s.cells[c]])),
        ], names=["heavy", "slot", "key", "n"])

    return run


def sketch(hashes: DataFrame, buckets: int = BUCKETS, cells: int = CELLS, evict: int = EVICT) -> DataFrame:
    """Merged sketch of a one-column frame of hashes: ``(heavy, slot, key, n)``, mergeable again by ``merge``."""
    return merge(hashes.mapInArrow(_sketch(buckets, cells, evict), "heavy boolean, slot int, key bigint, n bigint"), cells)


def merge(parts: DataFrame, cells: int = CELLS) -> DataFrame:
    """Recombine the buckets of partial sketches; losers fall into the cells."""
    votes = parts.where("heavy").groupBy("slot", "key").agg(F.sum("n").alias("n"))
    best = votes.groupBy("slot").agg(F.max(F.struct("n", "key")).alias("best"))
    kept = best.select(F.lit(True).alias("heavy"), "slot", F.col("best.key").alias("key"), F.col("best.n").alias("n"))
    lost = votes.join(best, "slot").where(F.col("key") != F.col("best.key"))
    lost = lost.select(F.col("key").bitwiseAND(cells - 1).cast("int").alias("slot"), "n")
    light = parts.where("not heavy").select("slot", "n").unionByName(lost).groupBy("slot").agg(F.sum("n").alias("n"))
    return kept.unionByName(light.select(F.lit(False).alias("heavy"), "slot", F.lit(0).cast("bigint").alias("key"), "n"))


def frequent(reads: DataFrame, support: float = SUPPORT, buckets: int = BUCKETS, cells: int = CELLS, evict: int = EVICT) -> DataFrame:
    """``(bases, n, estimate)``: values held by at least ``support`` of all distinct read_id, with exact count and sketch estimate."""
    spark = reads.sparkSession
    value = reads.where("read_id is not null").select("read_id", normalised().alias("value"))
    hashed = value.select("read_id", F.when(F.col("value").isNotNull(), F.xxhash64("value")).alias("h"))
    once = hashed.groupBy("read_id").agg(F.first("h").alias("h"))
    # the number of distinct ids comes with the sketch, as a row of its own
    count = once.select("h").mapInArrow(_sketch_and_total(buckets, cells, evict), "heavy boolean, slot int, key bigint, n bigint")
    parts = materialise(count, "p6-parts")
    total = parts.where("slot = -1").agg(F.sum("n")).first()[0] or 0
    least = support * total
    merged = materialise(merge(parts.where("slot >= 0"), cells), "p6-sketch")
    light = merged.where("not heavy").select(F.col("slot").alias("cell"), F.col("n").alias("light"))
    heavy = merged.where("heavy").select("key", "n", F.col("key").bitwiseAND(cells - 1).cast("int").alias("cell"))
    full = heavy.join(light, "cell", "left").select("key", (F.col("n") + F.coalesce("light", F.lit(0))).alias("estimate"), F.lit(-1).alias("cell"))
    hot = full.unionByName(light.select(F.lit(0).cast("bigint").alias("key"), F.col("light").alias("estimate"), "cell")).where(F.col("estimate") >= F.lit(least)).where("estimate > 0").collect()  # at most 4/support rows: the estimates sum to at most twice the rows
    keys, spots = [r.key for r in hot if r.cell < 0], [r.cell for r in hot if r.cell >= 0]
    h = F.xxhash64("value")
    chosen = value.where(F.col("value").isNotNull() & (h.isin(keys) | h.bitwiseAND(cells - 1).isin(spots)))
    exact = chosen.select("read_id", "value").distinct().groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(least))
    by_key = {r.key: r.estimate for r in hot if r.cell < 0}
    by_cell = {r.cell: r.estimate for r in hot if r.cell >= 0}
    estimates = spark.createDataFrame([(k, None, e) for k, e in by_key.items()] + [(None, c, e) for c, e in by_cell.items()], "k bigint, c bigint, estimate bigint")
    exact = exact.withColumn("h", F.xxhash64("value"))
    a = F.broadcast(estimates.where("k is not null").select("k", F.col("estimate").alias("e_key")))  # at most 4/support rows
    b = F.broadcast(estimates.where("c is not null").select("c", F.col("estimate").alias("e_cell")))
    out = exact.join(a, exact.h == a.k, "left").join(b, exact.h.bitwiseAND(cells - 1) == b.c, "left")
    return out.select(F.col("value").alias("bases"), "n", F.coalesce("e_key", "e_cell").alias("estimate"))


def _sketch_and_total(buckets: int, cells: int, evict: int):
    inner = _sketch(buckets, cells, evict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0

        def counted():
            nonlocal rows
            for batch in batches:
                rows += batch.num_rows
                yield batch

        yield from inner(counted())
        yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], names=["heavy", "slot", "key", "n"])

    return run


def p6_found(reads: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(bases)``: the frequent values."""
    return frequent(reads, support).select("bases")
