"""Has this key been seen before?  Sorted, mergeable quotient filters (problem 5).

A key's 64-bit hash is cut into the range (its high bits; one filter each), the quotient and the remainder.  A filter
holds the sorted remainders of its range, packed to ``ceil(r / 8)`` bytes each, and two bits of run metadata: one per
quotient (does it have a run?) and one per remainder (does a run begin here?).  There are about as many quotients as
remainders, so a run is one or two remainders long.  A lookup ranks the quotient's bit, selects the run's begin and searches
the packed remainders of that run; the filter isn't decoded.

Within a range arrivals come in order, in batches that grow with what is held (a quarter of it, ``FIRST`` at least and
``CHUNK`` at most).  Each batch is looked up in the filters of all batches before it and becomes a filter itself; filters of like
size are merged as sorted lists, with one more quotient bit for each doubling, so that a key is rewritten
logarithmically often.  What is left at the end can be stored (``filters``), merged with the filters of other days or
partitions (``merged``) and asked about later arrivals (``stored``).

Before the shuffle each input partition answers what it can: of the arrivals of one key in a partition only the earliest is
still open, all others were seen before.  Only open ones go to their key's range (a key with a third of all rows sends a row per
partition and chunk); the answered ones are spread evenly.

An answer is wrong only where two keys share a hash: an arrival is called seen with a probability
of at most ``n / 2**bits`` for n earlier keys, and never the other way round.  ``error_report`` derives
this rate and measures it on the filters' answers for several widths of the hash.

Defined cases: the key is ``name`` without surrounding white space and then without one leading
``@``; null and blank keys are no cases; a repeated ``arrival_no`` is one arrival; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import materialise, stripped

BITS = 64
#: A range for so many arrivals; ranges are a power of two.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 1 << 22, 16, 1 << 14
#: Rows of the first batch of a range, and the most of any; rows taken up at a time before the shuffle.
FIRST, CHUNK = 256, 1 << 20
_FILTERS = "range int, bits int, n bigint, quotient_bits int, occupied binary, starts binary, remainders binary"
_BLOB = "occupied", "starts", "remainders"


def key_of(column: str = "name") -> Column:
    """The key; null where there is none."""
    trimmed = stripped(F.col(column))
    bare = F.when(trimmed.startswith("@"), F.substring(trimmed, F.lit(2), F.length(trimmed))).otherwise(trimmed)
    return F.when(F.length(stripped(bare)) > 0, bare)


class _Ranked:
    """A packed bit set with the number of set bits before each of its words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint32)]).astype(np.uint32)

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> "_Ranked":
        """The set of some of ``size`` places."""
        bits = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        bits[places] = True
        return cls(np.packbits(bits, bitorder="little").view("<u8"))

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        low = self.words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 6].astype(np.int64) + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the set bits of those numbers, from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        left, bits, at = k - self.before[word].astype(np.int64), self.words[word].copy(), word.astype(np.int64) * 64
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left, at = np.where(up, left - low, left), np.where(up, at + half, at)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return at


class QuotientFilter:
    """An immutable filter over ascending, distinct ``bits``-wide fingerprints (uint64)."""

    def __init__(self, fingerprints: np.ndarray, bits: int = BITS, quotient_bits: int | None = None):
        self.n, self.bits = len(fingerprints), bits
        self.q = min(bits, max(1, self.n - 1).bit_length() if quotient_bits is None else quotient_bits)
        self.r = bits - self.q
        quotients = (fingerprints >> np.uint64(self.r)).astype(np.int64) if self.r < 64 else np.zeros(self.n, np.int64)
        self.occupied = _Ranked.of(quotients, 1 << self.q)
        self.starts = _Ranked.of(np.flatnonzero(np.concatenate([[True], quotients[1:] != quotients[:-1]])) if self.n else quotients, self.n)
        self.width = (self.r + 7) // 8
        rest = fingerprints & np.uint64((1 << self.r) - 1)
        self.remainders = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width].copy()

    @property
    def nbytes(self) -> int:
        return sum(s.words.nbytes + s.before.nbytes for s in (self.occupied, self.starts)) + self.remainders.nbytes

    def _remainder(self, at: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, : self.width] = self.remainders[at]
        return wide.view("<u8").reshape(-1)

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        """Membership, by the run of each quotient."""
        found = np.zeros(len(fingerprints), bool)
        if not self.n or not len(fingerprints):
            return found
        quotient = (fingerprints >> np.uint64(self.r)).astype(np.int64) if self.r < 64 else np.zeros(len(fingerprints), np.int64)
        at = np.flatnonzero(self.occupied.has(quotient))
        run, want = self.occupied.rank(quotient[at]), fingerprints[at] & np.uint64((1 << self.r) - 1)
        runs = int(self.starts.before[-1])
        low, high = self.starts.select(run), np.full(len(run), self.n, np.int64)
        more = run + 1 < runs
        high[more] = self.starts.select(run[more] + 1)
        end = high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            less = self._remainder(mid) < want[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        inside = np.flatnonzero(low < end)
        same = self._remainder(low[inside]) == want[inside]
        found[at[inside[same]]] = True
        return found

    def fingerprints(self) -> np.ndarray:
        """The sorted fingerprints, rebuilt from runs and remainders (for merges)."""
        if not self.n:
            return np.zeros(0, np.uint64)
        begins = np.unpackbits(self.starts.words.view(np.uint8), bitorder="little", count=self.n)
        quotient = np.flatnonzero(np.unpackbits(self.occupied.words.view(np.uint8), bitorder="little"))[np.cumsum(begins, dtype=np.int64) - 1].astype(np.uint64)
        rest = self._remainder(np.arange(self.n))
        return (quotient << np.uint64(self.r)) | rest if self.r < 64 else rest

    def merge(self, other: "QuotientFilter") -> "QuotientFilter":
        if other.bits != self.bits:
            raise ValueError("filters of different widths")
        both = np.sort(np.concatenate([self.fingerprints(), other.fingerprints()]), kind="stable")
        return QuotientFilter(both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both, self.bits)

    def row(self) -> tuple:
        return self.bits, self.n, self.q, self.occupied.words.tobytes(), self.starts.words.tobytes(), self.remainders.tobytes()

    @classmethod
    def load(cls, bits: int, n: int, q: int, occupied: bytes, starts: bytes, remainders: bytes) -> "QuotientFilter":
        out = cls.__new__(cls)
        out.bits, out.n, out.q, out.r = bits, n, q, bits - q
        out.width = (out.r + 7) // 8
        out.occupied, out.starts = (_Ranked(np.frombuffer(b, "<u8")) for b in (occupied, starts))
        out.remainders = np.frombuffer(remainders, np.uint8).reshape(n, out.width)
        return out


class Held:
    """The filters of one range: of like size no two, so that a lookup asks few of them."""

    def __init__(self, bits: int):
        self.bits, self.levels, self.n = bits, [], 0

    def add(self, new: QuotientFilter) -> None:
        self.n += new.n
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-2].n <= 2 * self.levels[-1].n:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merge(b))

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        known = np.zeros(len(fingerprints), bool)
        for level in self.levels:
            rest = np.flatnonzero(~known)
            known[rest] = level.contains(fingerprints[rest])
        return known

    def one(self) -> QuotientFilter:
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merge(b))
        return self.levels[0] if self.levels else QuotientFilter(np.zeros(0, np.uint64), self.bits)


def first_of_each(fingerprints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Mask of the rows that hold the earliest place of their fingerprint."""
    by = np.lexsort((order, fingerprints))
    f = fingerprints[by]
    mask = np.zeros(len(f), bool)
    mask[by[np.concatenate([[True], f[1:] != f[:-1]])]] = True
    return mask if len(f) else np.zeros(0, bool)


def once(fingerprints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Mask that keeps one row of each arrival."""
    by = np.lexsort((fingerprints, order))
    o, f = order[by], fingerprints[by]
    mask = np.ones(len(f), bool)
    mask[by[1:]] = (o[1:] != o[:-1]) | (f[1:] != f[:-1])
    return mask


def _answer_locally(range_bits: int):
    """Rows of an input partition with their range and whether they are still open."""

    def answered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        place, h = t["arrival_no"].to_numpy(), t["h"].to_numpy()
        kept = once(h, place)
        place, h = place[kept], h[kept]
        open_ = first_of_each(h, place)
        mixed = place.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.where(open_, h.view(np.uint64), mixed) >> np.uint64(64 - range_bits)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(place), pa.array(h), pa.array(open_)], names=["range", "arrival_no", "h", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield answered(held)
                held, n = [], 0
        if n:
            yield answered(held)

    return run


def _filter(widths: tuple[int, ...], range_bits: int, keep: bool):
    """Rows sorted by range and arrival_no, stored filters first: yields those seen before, or with ``keep`` the filters at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Held] = {}
        current = last = None
        parts: list[tuple] = []
        waiting = 0

        def flush(out: list) -> None:
            nonlocal parts, waiting, last
            if not waiting:
                return
            place, h = (np.concatenate(x) for x in zip(*parts))
            parts, waiting = [], 0
            # rows come by arrival_no, so an arrival that comes again stands beside itself; one more look at the last batch's end
            kept = once(h, place) & (place != last if last is not None else True)
            last = place[-1]
            place, h = place[kept], h[kept]
            for bits in widths:
                f = (h.view(np.uint64) >> np.uint64(64 - bits)) & np.uint64((1 << (bits - range_bits)) - 1)
                first = first_of_each(f, place)
                known = ~first
                known[first] = held[bits].contains(f[first])
                out.append((place[known], bits))
                if (~known).any():
                    held[bits].add(QuotientFilter(np.sort(f[~known]), bits - range_bits))

        def rows(out: list) -> pa.RecordBatch:
            places = np.concatenate([p for p, _ in out]) if out else np.zeros(0, np.int64)
            of = np.concatenate([np.full(len(p), b, np.int32) for p, b in out]) if out else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(places), pa.array(of)], names=["arrival_no", "bits"])

        def stored() -> pa.RecordBatch:
            made = [(current, *held[b].one().row()) for b in widths if held[b].levels]
            return pa.RecordBatch.from_pylist([dict(zip(("range", "bits", "n", "quotient_bits", *_BLOB), m)) for m in made], pa.schema([("range", pa.int32()), ("bits", pa.int32()), ("n", pa.int64()), ("quotient_bits", pa.int32()), *((c, pa.binary()) for c in _BLOB)]))

        for batch in batches:
            out: list[tuple] = []
            where, place, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            state = batch.column(3).to_numpy(zero_copy_only=False)
            if not keep:
                out += [(place[state == 0], b) for b in widths]
            cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if where[lo] != current:
                    flush(out)
                    if keep and current is not None:
                        yield stored()
                    current, last = int(where[lo]), None
                    held = {b: Held(b - range_bits) for b in widths}
                for i in (lo + np.flatnonzero(state[lo:hi] == 2)).tolist():
                    q = QuotientFilter.load(*(batch.column(4).field(c)[i].as_py() for c in ("bits", "n", "quotient_bits", *_BLOB)))
                    held[q.bits + range_bits].add(q)
                mine = lo + np.flatnonzero(state[lo:hi] == 1)
                while len(mine):
                    room = min(CHUNK, max(FIRST, max(x.n for x in held.values()) // 4)) - waiting
                    parts.append((place[mine[:room]], h[mine[:room]]))
                    waiting += len(parts[-1][0])
                    if len(mine) >= room:
                        flush(out)
                    mine = mine[max(room, 0) :]
            if not keep:
                yield rows(out)
        out = []
        flush(out)
        if not keep:
            yield rows(out)
        elif current is not None:
            yield stored()

    return run


def ranges_for(n: int) -> int:
    """Ranges for n arrivals: a power of two."""
    return min(MAX_RANGES, max(MIN_RANGES, 1 << max(0, -(-n // RANGE_ROWS) - 1).bit_length()))


def _run(arrivals: DataFrame, widths: tuple[int, ...], ranges: int, stored: DataFrame | None, keep: bool) -> DataFrame:
    range_bits = ranges.bit_length() - 1
    if min(widths) <= range_bits:
        raise ValueError("hashes need more bits than ranges have")
    key = key_of()
    rows = arrivals.where(key.isNotNull() & F.col("arrival_no").isNotNull()).select("arrival_no", F.xxhash64(key).alias("h"))
    blob = "struct<bits: int, n: bigint, quotient_bits: int, occupied: binary, starts: binary, remainders: binary>"
    local = rows.mapInArrow(_answer_locally(range_bits), "range int, arrival_no bigint, h bigint, open boolean")
    # state 0: answered, 1: open, 2: a stored filter, which comes before the arrivals of its range
    local = local.select("range", "arrival_no", "h", F.col("open").cast("int").alias("state"), F.lit(None).cast(blob).alias("filter"))
    if keep:
        local = local.where("state = 1")
    if stored is not None:
        # the width of a stored filter is that of its fingerprints, the range's bits aside
        old = stored.where(F.col("bits").isin([w - range_bits for w in widths])).select("range", F.lit(None).cast("bigint").alias("arrival_no"), F.lit(None).cast("bigint").alias("h"), F.lit(2).alias("state"), F.struct("bits", "n", "quotient_bits", *_BLOB).alias("filter"))
        local = local.unionByName(old)
    placed = local.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", F.desc(F.col("state") == 2), "arrival_no")
    filled = placed.select("range", F.coalesce("arrival_no", F.lit(0)).alias("arrival_no"), F.coalesce("h", F.lit(0)).alias("h"), "state", "filter")
    return filled.mapInArrow(_filter(widths, range_bits, keep), _FILTERS if keep else "arrival_no bigint, bits int")


def seen_before(arrivals: DataFrame, widths: tuple[int, ...] = (BITS,), stored: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """``(arrival_no, bits)`` of the arrivals whose key arrived before, in ``arrivals`` or among those whose filters are ``stored``; by hashes of each width.

    ``ranges`` must be that of the stored filters.
    """
    return _run(arrivals, widths, ranges or ranges_for(arrivals.count()), stored, False)


def filters(arrivals: DataFrame, ranges: int, widths: tuple[int, ...] = (BITS,), stored: DataFrame | None = None) -> DataFrame:
    """``(range, bits, n, quotient_bits, occupied, starts, remainders)``: the filters that hold all keys of the arrivals and of the ``stored`` filters."""
    return _run(arrivals, widths, ranges, stored, True)


def merged(stored: DataFrame) -> DataFrame:
    """One filter for each range and width, of filters made apart (of days, say, or of partitions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Held | None = None
        at = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["range"], row["bits"]) != at:
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(batch.schema.names, (at[0], *held.one().row())))], batch.schema)
                    at, held = (row["range"], row["bits"]), Held(row["bits"])
                held.add(QuotientFilter.load(*(row[c] for c in batch.schema.names[1:])))
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(batch.schema.names, (at[0], *held.one().row())))], batch.schema)

    return stored.select("range", "bits", "n", "quotient_bits", *_BLOB).repartition("range").sortWithinPartitions("range", "bits").mapInArrow(run, _FILTERS)


def p5_found(arrivals: DataFrame) -> DataFrame:
    """``(arrival_no)``: arrivals whose key arrived before."""
    return seen_before(arrivals).select("arrival_no").distinct()


def incremental(arrivals: DataFrame, parts: int = 4) -> DataFrame:
    """``(arrival_no)`` as of ``p5_found``, but with the arrivals taken up in consecutive parts, each answered from the stored filters of those before."""
    edge = arrivals.agg(F.min("arrival_no").alias("low"), F.max("arrival_no").alias("high"), F.count("*").alias("n")).first()
    if edge.low is None:
        return arrivals.select(F.col("arrival_no").cast("bigint")).limit(0)
    ranges, stored, every = ranges_for(edge.n), None, None
    step = -(-(edge.high - edge.low + 1) // parts)
    for k in range(parts):
        part = arrivals.where(F.col("arrival_no").between(edge.low + k * step, edge.low + (k + 1) * step - 1))
        found = seen_before(part, stored=stored, ranges=ranges).select("arrival_no")
        every = found if every is None else every.unionByName(found)
        if k + 1 < parts:
            new = materialise(filters(part, ranges), "p5-filters")
            stored = new if stored is None else materialise(merged(stored.unionByName(new)), "p5-filters")
    return every.distinct()


def error_report(arrivals: DataFrame, widths: tuple[int, ...] = (24, 32, 40, 48, 64)) -> DataFrame:
    """``(bits, n_arrivals, n_keys, derived_rate, wrong, measured_rate)``: wrong answers per arrival for each width.

    Derived: a new key is called seen with probability ``1 - (1 - 2**-bits)**earlier keys``; the rate is the sum over the
    keys divided by the arrivals.  Measured: what the filters of that width answered as seen, less the arrivals that truly were
    (keys told apart by a second, independent hash); a filter forgets nothing, so the difference is its wrong answers.
    """
    key = key_of()
    rows = arrivals.where(key.isNotNull() & F.col("arrival_no").isNotNull()).select("arrival_no", F.xxhash64(key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g"))
    firsts = rows.groupBy("h", "g").agg(F.count_distinct("arrival_no").alias("n"))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_arrivals"), F.count("*").alias("n_keys")).where("n_arrivals > 0")
    answers = seen_before(arrivals, widths).distinct().groupBy("bits").agg(F.count("*").alias("seen"))
    grid = total.select("*", F.explode(F.array(*(F.lit(w) for w in widths))).alias("bits")).join(answers, "bits", "left")
    d = F.col("n_keys").cast("double")
    p = F.pow(F.lit(2.0), -F.col("bits"))
    # sum over i < n of 1 - (1 - p)**i; for tiny p its first term, which loses nothing in double precision
    expected = F.when(p > 1e-9, d + F.expm1(d * F.log1p(-p)) / p).otherwise(d * (d - 1) / 2 * p)
    wrong = F.coalesce("seen", F.lit(0)) - (F.col("n_arrivals") - F.col("n_keys"))
    return grid.select("bits", "n_arrivals", "n_keys", (expected / F.col("n_arrivals")).alias("derived_rate"), wrong.alias("wrong"), (wrong / F.col("n_arrivals")).alias("measured_rate"))


def filter_sizes(arrivals: DataFrame) -> DataFrame:
    """``(n_keys, ranges, bytes, bits_a_key)`` of the filters that hold all keys."""
    made = filters(arrivals, ranges_for(arrivals.count()))
    size = sum((F.octet_length(c) for c in _BLOB), F.lit(0))
    total = made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.count("*").alias("ranges"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    return total.select("*", F.when(F.col("n_keys") > 0, 8.0 * F.col("bytes") / F.col("n_keys")).alias("bits_a_key"))
