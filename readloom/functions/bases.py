"""Bases and reference sequences.  Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of a base and their complements.
IUPAC = "ACGTURYSWKMBDHVN.-"
_COMPLEMENT = ("ACGTacgt", "TGCAtgca")


def replace_uracil(bases: Column) -> Column:
    """U becomes T, letter case kept."""
    return F.translate(bases, "Uu", "Tt")


def reverse_complement(bases: Column) -> Column:
    """Reversed, with A/T and C/G swapped; other letters stay."""
    return F.translate(F.reverse(bases), *_COMPLEMENT)


def count_autcg(bases: Column) -> Column:
    """Number of A, U, T, C and G in either case."""
    return F.length(bases) - F.length(F.translate(bases, "AUTCGautcg", ""))


def is_iupac(bases: Column) -> Column:
    """Whether all characters are IUPAC letters (either case), dots or dashes; false for an empty text."""
    return F.upper(bases).rlike(r"\A[ACGTURYSWKMBDHVN.\-]+\z")


def is_valid_reference(bases: Column, n: int | None = None) -> Column:
    """Whether the first n characters are upper-case IUPAC letters, dots or dashes."""
    return (bases if n is None else F.substring(bases, 1, n)).rlike(r"\A[ACGTURYSWKMBDHVN.\-]*\z")


def upper_bases(bases: Column) -> Column:
    return F.upper(bases)


def sequence_md5(bases: Column) -> Column:
    """MD5 as 32 lower-case hex digits."""
    return F.md5(bases)


def size_bytes(*columns: Column) -> Column:
    """Bytes of several texts together; nulls count nothing."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def fastq_text(name: Column, bases: Column, quals: Column, index: Column | None = None) -> Column:
    """The four lines of a read; missing or ``*`` qualities become ``!`` each; ``/index`` follows the name where index > 0."""
    filled = F.when(F.coalesce(quals, F.lit("*")) == "*", F.repeat(F.lit("!"), F.length(bases))).otherwise(quals)
    named = name if index is None else F.when(index > 0, F.concat(name, F.lit("/"), index.cast("string"))).otherwise(name)
    return F.concat(F.lit("@"), named, F.lit("\n"), bases, F.lit("\n+\n"), filled)
