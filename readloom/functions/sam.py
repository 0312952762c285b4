"""SAM flags and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of FLAG.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, LAST = 0x1, 0x4, 0x8, 0x10, 0x40, 0x80
SECONDARY, QC_FAIL, SUPPLEMENTARY = 0x100, 0x200, 0x800


def has(flags: Column, bits: int) -> Column:
    """Whether any of the bits is set."""
    return flags.bitwiseAND(bits) != 0


def segment_index(flags: Column) -> Column:
    """0 unpaired, 1 first of a pair, 2 otherwise."""
    return F.when(~has(flags, PAIRED), 0).when(has(flags, FIRST), 1).otherwise(2)


def is_not_primary(flags: Column) -> Column:
    return has(flags, SECONDARY | SUPPLEMENTARY)


def blank_star(value: Column) -> Column:
    """``*`` stands for nothing."""
    return F.when(value == "*", "").otherwise(value)


def unmapped_flags(paired: Column, slot: Column, filtered: Column) -> Column:
    """Flags of an unaligned record: 77 and 141 for the reads of a pair, 4 for others, and 0x200 where filtered."""
    base = F.when(paired, F.when(slot == 1, PAIRED | UNMAPPED | MATE_UNMAPPED | FIRST).otherwise(PAIRED | UNMAPPED | MATE_UNMAPPED | LAST)).otherwise(UNMAPPED)
    return base.bitwiseOR(F.when(filtered, QC_FAIL).otherwise(0))
