"""Rows that fail to parse, with the reason (problem 4).

Every row goes once through a minimum-cost parse that may insert or delete quotes and delimiters.  Rows that need no edit are told by
a pattern that matches just the parses of cost zero; their values are checked, and valid rows load.  For all others dynamic
programming finds the cheapest edits, which state the reason:

* csv: over the structural characters of the row (quotes, delimiters, line ends; runs of other characters count as one
  symbol, so cost doesn't grow with the length of a field).  Any quote among the edits means ``quoting``, else ``columns``.  A quote
  edit outweighs all delimiter edits of a row, so that quotes are edited only where nothing else gives a parse.
* fastq and sam: fields are aligned with the slots of a record.  Line ends, tabs and line markers are inserted or deleted
  (``columns``); between alignments of like cost the one wins whose fields suit the types of their slots.

Defined cases: null text and an unknown layout fail with ``columns``; an empty text has one empty
field and fails likewise; rows delivered again count once (of copies that differ, the least valid row loads and the first reason in the
order of the checks is given), rows without id not at all; an empty table gives no rows; columns besides those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import WHITE

# Letters a base may have, and the longest name.
BASE_PATTERN = "^[ACGTURYSWKMBDHVNacgturyswkmbdhvn.-]+$"
MAX_NAME = 256
#: The reasons in the order of the checks.
REASONS = ("quoting", "columns", "name", "bases", "quals", "number", "length")
_FIELD = r'([^,"\n]*+|"(?:[^"]++|"")*+")'
_CSV = re.compile(f"{_FIELD},{_FIELD},{_FIELD}", re.S)
_TAG = re.compile(r"[A-Za-z][A-Za-z0-9]:[A-Za-z]:.*")
_LINE_END = re.compile("\r?\n")
_BASES, _QUALS, _INTEGER = re.compile(BASE_PATTERN[1:-1]), re.compile("[!-~]+"), re.compile("[-+]?[0-9]+")
_CIGAR = re.compile(r"\*|(?:[0-9]+[MIDNSHP=X])+")
QUOTE_COST = 1_000_000
#: Cost of an edit of a line end, tab or marker; a field that doesn't suit its slot's type costs 1.
EDIT_COST = 1_000


def csv_edits(text: str, n_fields: int = 3) -> tuple[int, int, str]:
    """(quote edits, delimiter edits, operations) of the cheapest parse of a row into ``n_fields``.

    States: S start of a field, U unquoted, Q within quotes, A after a quote that may close.
    """
    symbols: list[tuple[str, int]] = []
    for i, ch in enumerate(text):
        kind = ch if ch in '",\n' else "x"
        if kind != "x" or not symbols or symbols[-1][0] != "x":
            symbols.append((kind, i))
    top = n_fields + 1  # more fields than wanted count alike until the end
    best: dict[tuple[str, int], tuple[int, tuple]] = {("S", 1): (0, ())}

    def put(to, state, fields, cost, path):
        if (key := (state, fields)) not in to or cost < to[key][0]:
            to[key] = (cost, path)

    for kind, at in symbols:
        new: dict[tuple[str, int], tuple[int, tuple]] = {}
        for (state, fields), (cost, path) in best.items():
            if kind == "x":
                if state in "SU":
                    put(new, "U", fields, cost, path)
                elif state == "Q":
                    put(new, "Q", fields, cost, path)
                else:  # text after a closing quote: the quote should not be there, or be doubled
                    put(new, "Q", fields, cost + QUOTE_COST, (path, ("insert quote", at)))
                if state == "S":
                    put(new, "Q", fields, cost + QUOTE_COST, (path, ("insert quote", at)))
                if state == "Q":  # the quote that opened closes here
                    put(new, "U", fields, cost + QUOTE_COST, (path, ("insert quote", at)))
            elif kind == '"':
                if state == "S":
                    put(new, "Q", fields, cost, path)
                elif state == "Q":
                    put(new, "A", fields, cost, path)
                elif state == "A":
                    put(new, "Q", fields, cost, path)
                put(new, state, fields, cost + QUOTE_COST, (path, ("delete quote", at)))
            elif kind == ",":
                if state == "Q":
                    put(new, "Q", fields, cost, path)
                    put(new, "S", min(top, fields + 1), cost + QUOTE_COST, (path, ("insert quote", at)))
                else:
                    put(new, "S", min(top, fields + 1), cost, path)
                    put(new, "S", fields, cost + 1, (path, ("delete delimiter", at)))
            elif state == "Q":  # a line end
                put(new, "Q", fields, cost, path)
            else:
                put(new, "S", fields, cost + 1, (path, ("delete line end", at)))
        best = new
    ends = []
    for (state, fields), (cost, path) in best.items():
        if state == "Q":
            cost, path = cost + QUOTE_COST, (path, ("insert quote", len(text)))
        if fields > n_fields:
            continue
        for _ in range(n_fields - fields):
            cost, path = cost + 1, (path, ("insert delimiter", len(text)))
        ends.append((cost, path))
    cost, path = min(ends, key=lambda e: e[0])
    ops = []
    while path:
        path, op = path
        ops.append(f"{op[0]}@{op[1]}")
    return cost // QUOTE_COST, cost % QUOTE_COST, ";".join(reversed(ops))


Slot = tuple[Callable[[str], bool], int, str]


def align(fields: list[str], slots: list[Slot], delimiter: str, tail: Slot | None = None) -> tuple[int, str]:
    """(edits, operations) of the cheapest alignment of fields with the slots of a record.

    A slot is (test, cost of a field that fails it, edit that mends it or nothing).  ``tail`` takes any number of further fields.
    """
    wide = len(slots)
    row: list[tuple[int, tuple]] = [(j * EDIT_COST, ()) for j in range(wide + 1)]
    for j in range(1, wide + 1):
        row[j] = (row[j][0], (row[j - 1][1], f"insert {delimiter}@0"))
    for i, field in enumerate(fields, 1):
        whole = field.count("\n") * EDIT_COST
        new = [(row[0][0] + EDIT_COST + whole, (row[0][1], f"delete {delimiter}@{i}"))]
        for j in range(1, wide + 1):
            test, cost, mend = slots[j - 1]
            good = test(field)
            best, path = row[j][0] + whole + EDIT_COST, (row[j][1], f"delete {delimiter}@{i}")
            choices = [
                (row[j - 1][0] + whole + (0 if good else cost), (row[j - 1][1], f"{mend}@{i}") if mend and not good else row[j - 1][1]),
                (new[j - 1][0] + EDIT_COST, (new[j - 1][1], f"insert {delimiter}@{i}")),
            ]
            if j == wide and tail is not None and tail[0](field):
                choices.append((row[j][0] + whole, row[j][1]))
            for c in choices:
                if c[0] < best:
                    best, path = c
            new.append((best, path))
        row = new
    cost, path = row[-1]
    ops = []
    while path:
        path, op = path
        ops.append(op)
    return cost // EDIT_COST, ";".join(reversed(ops))


_ANY = (lambda t: True, 0, "")


def _type(pattern: re.Pattern) -> Slot:
    return lambda t: bool(pattern.fullmatch(t)), 1, ""


_FASTQ: list[Slot] = [(lambda t: t.startswith("@"), EDIT_COST, "insert @"), _ANY, (lambda t: t.startswith("+"), EDIT_COST, "insert +"), _ANY]
_SAM: list[Slot] = [_ANY, _type(_INTEGER), _ANY, _type(_INTEGER), _type(re.compile(r"\*|[0-9]+")), _type(_CIGAR), _ANY, _type(_INTEGER), _type(_INTEGER), _type(re.compile(r"\*|" + BASE_PATTERN[1:-1])), _type(_QUALS)]
_TAIL: Slot = (lambda t: bool(_TAG.fullmatch(t)), 1, "")


def line_edits(lines: list[str]) -> tuple[int, str]:
    """(edits, operations) that align lines with a FASTQ record: insert or delete a line end or a marker."""
    return align(lines, _FASTQ, "line end")


def sam_edits(text: str) -> tuple[int, str]:
    """(edits, operations) that align the columns of a SAM line: insert or delete a tab; line ends within are deleted."""
    edits, ops = align(text.split("\t"), _SAM, "tab", _TAIL)
    within = [f"delete line end@{m.start()}" for m in re.finditer("\n", text)]
    return edits, ";".join([*([ops] if ops else []), *within])


Fields = tuple[str, str, str, tuple[str, ...]]


def _unquoted(field: str) -> str:
    return field[1:-1].replace('""', '"') if field[:1] == '"' else field


def _one_end_less(text: str) -> str:
    return text[: -2 if text.endswith("\r\n") else -1] if text.endswith("\n") else text


def fields_of(kind: str | None, text: str) -> Fields | None:
    """Name, bases, qualities and the numbers of a row that parses at no cost; else nothing."""
    if kind == "csv":
        m = _CSV.fullmatch(_one_end_less(text))
        return (*map(_unquoted, m.groups()), ()) if m else None
    if kind == "fastq":
        lines = _fastq_lines(text)
        return (lines[0][1:], lines[1], lines[3], ()) if len(lines) == 4 and lines[0][:1] == "@" and lines[2][:1] == "+" else None
    if kind == "sam":
        body = _one_end_less(text)
        columns = body.split("\t")
        if len(columns) < 11 or "\n" in body or not all(map(_TAG.fullmatch, columns[11:])):
            return None
        bases, quals = ("" if c == "*" else c for c in columns[9:11])
        return columns[0], bases, quals, (columns[1], columns[3], columns[7], columns[8])
    return None


def _fastq_lines(text: str) -> list[str]:
    """Lines of a record: three line ends part four lines, of which the last may be empty; one more ends the last line."""
    lines = _LINE_END.split(text)
    return lines[:-1] if len(lines) != 4 and lines[-1] == "" and len(lines) > 1 else lines


def edits_of(kind: str | None, text: str | None) -> tuple[int, int, str]:
    """(quote edits, delimiter edits, operations) of the cheapest parse."""
    if text is None:
        return 0, 1, "no text"
    if kind == "csv":
        return csv_edits(_one_end_less(text))
    if kind == "fastq":
        return 0, *line_edits(_fastq_lines(text))
    if kind == "sam":
        return 0, *sam_edits(_one_end_less(text))
    return 0, 1, "unknown layout"


def value_reason(name: str, bases: str, quals: str, numbers: tuple[str, ...]) -> str | None:
    """The first failing check of a row whose structure fits; nothing where all hold."""
    if not 0 < len(name.strip(WHITE)) <= MAX_NAME:
        return "name"
    if not _BASES.fullmatch(bases):
        return "bases"
    if not _QUALS.fullmatch(quals):
        return "quals"
    if numbers and not all(map(_INTEGER.fullmatch, numbers)):
        return "number"
    return "length" if len(bases) != len(quals) else None


_LOADED = "raw_id bigint, name string, bases string, quals string"
_FAILED = "raw_id bigint, code int, quote_edits bigint, delimiter_edits bigint, operations string"


def _parse(loads: bool):
    """Rows ``(raw_id, layout, text)``: the valid ones with their values, or the others with their edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ident, layout, text in zip(*(c.to_pylist() for c in batch.columns)):
                kind = layout.strip(" ").lower() if layout is not None else None
                parts = fields_of(kind, text) if text is not None else None
                if parts is None:
                    if not loads:
                        quotes, delimiters, operations = edits_of(kind, text)
                        out.append((ident, 0 if quotes else 1, quotes, delimiters, operations))
                    continue
                reason = value_reason(*parts)
                if reason is None:
                    if loads:
                        out.append((ident, parts[0].strip(WHITE), *parts[1:3]))
                elif not loads:
                    out.append((ident, REASONS.index(reason), 0, 0, ""))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string()) if loads else (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out) if out else ((),) * len(kinds)
            names = ["raw_id", "name", "bases", "quals"] if loads else ["raw_id", "code", "quote_edits", "delimiter_edits", "operations"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _rows(raw: DataFrame, loads: bool) -> DataFrame:
    return raw.where("raw_id is not null").select("raw_id", "layout", "raw_text").mapInArrow(_parse(loads), _LOADED if loads else _FAILED)


def _reason() -> Column:
    return F.element_at(F.array(*map(F.lit, REASONS)), F.col("code") + 1).alias("reason")


def loaded(raw: DataFrame) -> DataFrame:
    """``(raw_id, name, bases, quals)`` of the valid rows."""
    return _rows(raw, True).groupBy("raw_id").agg(F.min(F.struct("name", "bases", "quals")).alias("r")).select("raw_id", "r.*")


def failed(raw: DataFrame) -> DataFrame:
    """``(raw_id, reason, quote_edits, delimiter_edits, operations)`` of the rows that fail."""
    edits = ("quote_edits", "delimiter_edits", "operations")
    return _rows(raw, False).groupBy("raw_id").agg(F.min(F.struct("code", *edits)).alias("r")).select("raw_id", "r.*").select("raw_id", _reason(), *edits)


def error_parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows and the others, see ``loaded`` and ``failed``."""
    return loaded(raw), failed(raw)


def p4_found(raw: DataFrame) -> DataFrame:
    """``(raw_id, reason)`` of the rows that fail."""
    return _rows(raw, False).groupBy("raw_id").agg(F.min("code").alias("code")).select("raw_id", _reason())
