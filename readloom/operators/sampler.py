"""Packing of bases and scores into bits, and synthetic reads.

Packed texts are BINARY, least significant bit first.  Null gives null; a symbol outside its dictionary is an error
(bases) or the last code (scores).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of bases (3 bits), scores by falling frequency (6 bits; all others get the last code), and bases as half bytes.
BASE_CODES = {"N": 0, "A": 1, "T": 3, "G": 5, "C": 7}
SCORE_ORDER = [71, 69, 70, 68, 35, 66, 67, 65, 63, 64, 61, 58, 53, 62, 60, 59, 45, 57, 55, 33, 56, 54, 52, 44, 51, 50, 48, 41, 43, 49, 42, 40, 46, 47, 39, 38, 37, 36, 34]
NIBBLES = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
BASE_BITS, SCORE_BITS = 3, 6


def pack(codes: np.ndarray, width: int) -> bytes:
    """Codes of ``width`` bits one after the other."""
    bits = ((codes[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8).reshape(-1)
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` codes; an error where there are fewer."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    if n * width > len(bits):
        raise EOFError("the packed text ends early")
    return (bits[: n * width].reshape(n, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1)


def _codes(text: str, table: np.ndarray, what: str) -> np.ndarray:
    codes = table[np.frombuffer(text.encode("latin-1"), np.uint8)]
    if (codes < 0).any():
        raise ValueError(f"{what} hold a symbol without a code")
    return codes


def _table(mapping: dict[str, int], other: int = -1) -> np.ndarray:
    out = np.full(256, other, np.int16)
    for k, v in mapping.items():
        out[ord(k)] = v
    return out


def pack_bases(bases: Column) -> Column:
    table = _table(BASE_CODES)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else pack(_codes(t, table, "bases"), BASE_BITS))

    return run(bases)


def unpack_bases(packed: Column, n: Column) -> Column:
    letters = {v: k for k, v in BASE_CODES.items()}

    @F.pandas_udf("string")
    def run(s: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or pd.isna(k) else "".join(letters[int(c)] for c in unpack(d, BASE_BITS, int(k))) for d, k in zip(s, size)], dtype=object)

    return run(packed, n)


def pack_scores(quals: Column) -> Column:
    """Lossy: rare symbols share the last code; characters that can't be printed are an error."""
    table = _table({chr(c): 38 for c in range(33, 127)} | {chr(c): i for i, c in enumerate(SCORE_ORDER)})

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else pack(_codes(t, table, "scores"), SCORE_BITS))

    return run(quals)


def squeeze_bases(bases: Column) -> Column:
    """Two bases a byte, the first in the upper half; texts of odd length end in a half byte of 15."""
    table = _table(NIBBLES)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            c = np.append(_codes(t, table, "bases"), [15] * (len(t) % 2)).astype(np.uint8).reshape(-1, 2)
            return ((c[:, 0] << 4) | c[:, 1]).astype(np.uint8).tobytes()

        return s.map(one)

    return run(bases)


def generate_reads(spark: SparkSession, n: int, size: int = 50, scoring: str = "PHRED", offset: int = 33, low: int = 2, high: int = 40, seed: int = 1) -> DataFrame:
    """``(read_no, name, bases, quals)``: uniform bases; scores of uniform error probabilities, drawn anew until within bounds.

    Drawing anew is inverted: the probability is uniform on the stretch whose scores lie within the bounds.
    Every value depends on its row and place only, so the same call gives the same reads on any cluster.
    """
    edge = (lambda s: 10 ** (-s / 10)) if scoring == "PHRED" else (lambda s: 1 / (1 + 10 ** (s / 10)))
    p_low, p_high = edge(high + 1), min(1.0, edge(low))
    uniform = lambda tag, i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col("id"), i), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    places = F.sequence(F.lit(1), F.lit(size))
    p = lambda i: F.lit(p_low) + uniform("q", i) * (p_high - p_low)
    score = lambda i: F.floor(-10 * F.log10(p(i)) if scoring == "PHRED" else -10 * F.log10(p(i) / (1 - p(i))))
    bases = F.array_join(F.transform(places, lambda i: F.substring(F.lit("ACGT"), (F.floor(uniform("b", i) * 4) + 1).cast("int"), F.lit(1))), "")
    quals = F.array_join(F.transform(places, lambda i: F.char((F.greatest(F.lit(low), F.least(F.lit(high), score(i))) + offset).cast("bigint"))), "")
    return spark.range(1, n + 1).select(F.col("id").alias("read_no"), F.format_string("FASTQ_GENERATOR:%09d/1", F.col("id")).alias("name"), bases.alias("bases"), quals.alias("quals"))
