"""Read names: the Casava 1.8 form, pair keys and numbers, output names.

All functions take and give Columns.  A null name gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of read names.
#: base, white space, read number, filter flag, control number (even), end or barcode
CASAVA = r"^(.+)( +|\t+)([0-9]+):([YN]):([0-9]*[02468])($|:.*$)"
#: seven fields without a tail: such names carry no pair number
SEVEN_FIELDS = r"^([a-zA-Z0-9_-]+:[0-9]+:[a-zA-Z0-9_-]+:[0-9]+:[0-9]+:[0-9-]+:[0-9-]+)$"
#: key, separator, pair number; validators know the numbers 1 to 4 only
PAIR_SUFFIX = r"^(.*)(?:[.|:/_])([0-9]+)$"
PAIR_SUFFIX_VALIDATOR = r"^(.*)(?:[.|:/_])([1234])$"
MAX_NAME = 256


def is_casava(name: Column) -> Column:
    return name.rlike(CASAVA)


def _casava(name: Column, group: int) -> Column:
    return F.when(is_casava(name), F.regexp_extract(name, CASAVA, group))


def base_name(name: Column) -> Column:
    """Name before the Casava tail; null for other names."""
    return _casava(name, 1)


def read_index(name: Column) -> Column:
    """Read number of a Casava name as text; null for other names."""
    return _casava(name, 3)


def barcode(name: Column) -> Column:
    """Barcode of a Casava name; null where it has none."""
    return F.nullif(F.substring(_casava(name, 6), F.lit(2), F.length(name)), F.lit(""))


def is_filtered(name: Column) -> Column:
    """Whether a Casava name says Y; false for other names and null."""
    return F.coalesce(_casava(name, 4) == "Y", F.lit(False))


def read_style(name: Column) -> Column:
    """CASAVA18 or FASTQ."""
    return F.when(is_casava(name), "CASAVA18").otherwise("FASTQ")


def _suffixed(name: Column, pattern: str) -> Column:
    return ~name.rlike(SEVEN_FIELDS) & name.rlike(pattern)


def read_key(name: Column) -> Column:
    """Pair key: the Casava base name, else the name without separator and number; null where there is none."""
    return F.when(is_casava(name), base_name(name)).when(_suffixed(name, PAIR_SUFFIX), F.regexp_extract(name, PAIR_SUFFIX, 1))


def pair_number_text(name: Column) -> Column:
    return F.when(is_casava(name), read_index(name)).when(_suffixed(name, PAIR_SUFFIX), F.regexp_extract(name, PAIR_SUFFIX, 2))


def pair_number(name: Column) -> Column:
    """Pair number; null where the name has none or it is no 32-bit integer."""
    return pair_number_text(name).try_cast("int")


def key_or_name(name: Column) -> Column:
    """Pair key, else the whole name."""
    return F.coalesce(read_key(name), name)


def index_or_file(name: Column, file_no: Column) -> Column:
    """Pair number, else the file's ordinal."""
    return F.coalesce(pair_number(name), file_no.cast("int"))


def validator_key(name: Column, casava: Column) -> Column:
    """Key by which validators count pairs; ``casava``: whether the file is of Casava style."""
    plain = F.when(_suffixed(name, PAIR_SUFFIX_VALIDATOR), F.regexp_extract(name, PAIR_SUFFIX_VALIDATOR, 1)).otherwise(name)
    return F.when(casava, base_name(name)).otherwise(plain)


def validator_label(name: Column, casava: Column, file: Column) -> Column:
    """Pair label as validators see it; the file where the name has none."""
    plain = F.when(_suffixed(name, PAIR_SUFFIX_VALIDATOR), F.regexp_extract(name, PAIR_SUFFIX_VALIDATOR, 2)).otherwise(file)
    return F.when(casava, read_index(name)).otherwise(plain)


def single_base_name(name: Column) -> Column:
    """Casava base name, else the text before the last slash, else the name."""
    return F.coalesce(base_name(name), F.regexp_replace(name, "/[^/]*$", ""))


def numbered(name: Column, prefix: str | None, counter: Column) -> Column:
    """``prefix.counter name``, or the name alone without a prefix."""
    return name if prefix is None else F.concat(F.lit(prefix + "."), counter.cast("string"), F.lit(" "), name)


def paired_output_name(name: Column, key: Column, slot: Column, casava: Column) -> Column:
    """Name of a paired read: Casava names stay whole, others become ``key/slot`` (1 or 2 by ascending pair number)."""
    return F.when(casava, name).otherwise(F.concat(key, F.lit("/"), slot.cast("string")))


def orphan_output_name(name: Column, key: Column, number: Column) -> Column:
    """Name of an orphan: Casava names stay whole, others keep their own pair number."""
    return F.when(is_casava(name), name).otherwise(F.concat(key, F.lit("/"), number.cast("string")))


def strip_pair_suffix(name: Column) -> Column:
    return F.coalesce(read_key(name), name)


def is_generated_name(name: Column) -> Column:
    """Whether the second word of a name, without ``/x``, is an integer; null without a second word."""
    word = F.get(F.split(name, " "), F.lit(1))
    bare = F.when((F.length(word) > 2) & word.rlike("/.$"), F.substring(word, F.lit(1), F.length(word) - 2)).otherwise(word)
    return F.when(word.isNotNull(), bare.rlike("^[-+]?[0-9]+$") & bare.try_cast("int").isNotNull())


def error_text(message: Column, name: Column | None = None, index: Column | None = None) -> Column:
    """A validation message after the read's name and index, where they are known."""
    parts = []
    if name is not None:
        parts.append(F.when(name.isNotNull(), F.concat(F.lit("Read Name: "), name)))
    if index is not None:
        parts.append(F.when(index.isNotNull(), F.concat(F.lit("Read Index: "), index.cast("string"))))
    return F.concat_ws(", ", *parts, message)


def joined_text(*parts: Column) -> Column:
    """Parts joined by blanks, trimmed, runs of blanks made one."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), " +", " "))
