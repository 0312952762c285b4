"""Quality encodings.  The canonical column is Phred + 33 text.

Null gives null.  Values that a function can't take are null unless ``strict`` raises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Encodings as (offset, lowest value, highest value).
ENCODINGS = {
    "SANGER": (33, 0, 93), "X": (33, 0, 93), "NONE": (33, 0, 93), "SOLEXA": (64, -5, 93),
    "ILLUMINA_1_3": (64, 0, 93), "X_2": (64, 0, 93), "ILLUMINA_1_5": (64, 3, 93),
}
#: Lowest characters of the detected encodings.
SOLEXA_FROM, ILLUMINA_FROM = 59, 64
HIGH_QUALITY = 30


def detect_encoding(lowest: Column) -> Column:
    """Standard, Solexa or Illumina from the lowest character code of a file."""
    return F.when(lowest < SOLEXA_FROM, "Standard").when(lowest < ILLUMINA_FROM, "Solexa").when(lowest.isNotNull(), "Illumina")


def lowest_code(quals: Column) -> Column:
    """Lowest character code of a text; null for an empty one."""
    return F.array_min(F.transform(F.filter(F.split(quals, ""), lambda c: c != ""), F.ascii))


def _table(to) -> tuple[str, str]:
    codes = range(33, 127)
    return "".join(map(chr, codes)), "".join(chr(33 + max(0, min(93, to(c)))) for c in codes)


def solexa_to_phred(c: int) -> int:
    """Phred value of a Solexa character code, as readers normalise it: below 64 nothing is left."""
    return 0 if c < 64 else math.floor(10 * math.log10(1 + 10 ** ((c - 64) / 10)) + 0.5)


def normalise(quals: Column, encoding: Column | str) -> Column:
    """Phred + 33 text from text of a detected encoding (Standard, Solexa, Illumina)."""
    encoding = F.lit(encoding) if isinstance(encoding, str) else encoding
    return (
        F.when(encoding == "Standard", quals)
        .when(encoding == "Illumina", F.translate(quals, *_table(lambda c: c - 64)))
        .when(encoding == "Solexa", F.translate(quals, *_table(solexa_to_phred)))
    )


def values(quals: Column, offset: int = 33) -> Column:
    """The scores of a text as an array."""
    return F.transform(F.filter(F.split(quals, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def text(scores: Column, offset: int = 33) -> Column:
    """The text of an array of scores."""
    return F.array_join(F.transform(scores, lambda v: F.char((v + offset).cast("bigint"))), "")


def decode(quals: Column, encoding: str, strict: bool = False) -> Column:
    """Scores of a text in a named encoding; null, or an error, where one lies outside its range."""
    offset, low, high = ENCODINGS[encoding]
    v = values(quals, offset)
    bad = F.exists(v, lambda x: (x < low) | (x > high))
    return F.when(~bad, v).otherwise(F.raise_error(F.lit("score out of range")).cast("array<int>") if strict else F.lit(None))


def encode(scores: Column, encoding: str, strict: bool = False) -> Column:
    """Text of scores in a named encoding; null, or an error, where one lies outside its range."""
    offset, low, high = ENCODINGS[encoding]
    bad = F.exists(scores, lambda x: (x < low) | (x > high))
    return F.when(~bad, text(scores, offset)).otherwise(F.raise_error(F.lit("score out of range")).cast("string") if strict else F.lit(None))


def phred_to_logodds(v: Column) -> Column:
    """Log-odds score of a Phred score, -5 at least."""
    x = F.pow(F.lit(10.0), v / 10) - 1
    return F.when(v == 0, -5).when(v > 0, F.greatest(F.lit(-5), F.floor(10 * F.log10(x) + 0.5).cast("int")))


def logodds_to_phred(v: Column) -> Column:
    """Phred score of a log-odds score."""
    return F.floor(10 * F.log10(F.pow(F.lit(10.0), v / 10) + 1) + 0.5).cast("int")


def mean_quality(quals: Column) -> Column:
    """Mean Phred value of Phred + 33 text; null for an empty one."""
    total = F.aggregate(F.split(quals, ""), F.lit(0), lambda a, c: a + F.ascii(c))
    return (total - 33 * F.length(quals)) / F.nullif(F.length(quals), F.lit(0))


def is_high_quality(quals: Column) -> Column:
    return F.coalesce(mean_quality(quals) >= HIGH_QUALITY, F.lit(False))
