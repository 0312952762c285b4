"""Reference regions, 1-based and inclusive, and reference paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: separators of a reference path: colon or semicolon, but not after a scheme or before a port.
REF_PATH_SPLIT = r"(?i)(?<!(https?|ftp))(?!:([0-9]+))(:|;)"


def slice_clipped(bases: Column, start: Column, span: Column, region_start: Column | int = 1) -> Column:
    """``span`` bases from 1-based ``start`` of a region that begins at ``region_start``; cut at its end, empty beyond it."""
    at = start - region_start + 1
    return F.when(at > F.length(bases), "").otherwise(F.substring(bases, at.cast("int"), span.cast("int")))


def slice_strict(bases: Column, start: Column, span: Column, region_start: Column | int = 1) -> Column:
    """As ``slice_clipped``, but an error where the slice leaves the region."""
    at = start - region_start + 1
    inside = (at >= 1) & (at + span - 1 <= F.length(bases))
    return F.when(inside, F.substring(bases, at.cast("int"), span.cast("int"))).otherwise(F.raise_error(F.lit("outside of the region")).cast("string"))


def slice_zero_based(bases: Column, start: Column, stop: Column) -> Column:
    """Bases at the array places start to stop, both counted from 0 and inclusive; cut at the end."""
    return slice_clipped(bases, start + 1, stop - start + 1)


def base_at(bases: Column, position: Column, region_start: Column | int = 1) -> Column:
    return slice_strict(bases, position, F.lit(1), region_start)


def region_md5(bases: Column, start: Column, span: Column, region_start: Column | int = 1) -> Column:
    """MD5 of a clipped slice."""
    return F.md5(slice_clipped(bases, start, span, region_start))


def split_ref_path(paths: Column) -> Column:
    """Parts of a reference path."""
    return F.split(paths, REF_PATH_SPLIT)


def format_path(pattern: str, ident: str) -> str:
    """Fill ``%Ns`` with N characters each from the left of ``ident`` and ``%s`` with the rest."""
    filled, at = [], 0
    for literal, n in re.findall(r"(.*?)%(\d+)s|\Z", pattern, re.S):
        if n:
            filled += [literal, ident[: int(n)]]
            ident = ident[int(n) :]
    at = max((m.end() for m in re.finditer(r"%\d+s", pattern)), default=0)
    whole = "".join(filled) + pattern[at:]
    if "%s" not in whole:
        raise ValueError(f"no %s in the reference path {pattern!r}")
    return whole.replace("%s", ident)


def format_path_column(pattern: str, ident: Column) -> Column:
    """``format_path`` for a column of identifiers."""
    parts, at, taken = [], 0, 1
    for m in re.finditer(r"%(\d+)s", pattern):
        parts += [F.lit(pattern[at : m.start()]), F.substring(ident, taken, int(m.group(1)))]
        taken, at = taken + int(m.group(1)), m.end()
    tail = pattern[at:]
    if "%s" not in tail:
        raise ValueError(f"no %s in the reference path {pattern!r}")
    rest = F.substring(ident, F.lit(taken), F.length(ident))
    for i, piece in enumerate(tail.split("%s")):
        parts += ([rest] if i else []) + [F.lit(piece)]
    return F.concat(*parts)
