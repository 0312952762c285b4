"""Distinct counts over huge identifier sets by linear counting (problem 2).

Every identifier sets one hashed bit of a bitmap of ``m`` bits; with a share z of the bits empty, the
estimate is ``-m * ln(z)``.  m is a power of two and sized for each group by itself: for the target error at the number
of its rows, the largest count that can occur, by the standard error of linear counting, ``sqrt(m * (exp(t) - t - 1)) / n`` with
t = n / m.

A bit's place is given by the low bits of the hash, so that a larger bitmap folds to a smaller one by OR; any
two partial results merge by bitwise union, those of unlike sizes after folding (``merged``).  A bitmap is held as rows
of 64-bit words ``(gid, kind, lm, word, bits)`` with ``lm = log2(m)``: a group with a third of all rows is spread over its words, and each
union is a ``bit_or`` with map-side combine.

All combinations of day, centre, platform, run and file are given.  The rows are read once for the words of all groups
without run and file and of the groups (day, file), whose bitmaps are as large as their run's; the other groups with run or
file are unions of those, folded to their own size.  Groups with the file and what the manifest tells of it are counted once.
Sizes are known beforehand from the numbers of rows by file and by day; a group of both can't be larger than either.

Defined cases: null, blank and ``*`` identifiers are not counted (a group without any has the count
0); names lose surrounding blanks and one leading ``@``, bases are upper-cased with U as T; centres are
compared trimmed and upper-cased; a null day, centre or platform is a group of its own, shown as null
(``grouping`` tells it from "all"); rows delivered again set the same bits; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import materialise, stripped

TARGET_ERROR = 0.01
COLUMNS = ("day", "center", "platform", "run_accession", "file_id")
#: What the manifest tells of a file: beside ``file_id``, these make no other groups.
OF_FILE = ("center", "platform", "run_accession")
#: The reported combinations: all.
SETS = tuple(s for n in range(len(COLUMNS) + 1) for s in combinations(COLUMNS, n))
KINDS = {"day": "date", "file_id": "bigint"}
#: Exponents of two of the smallest and the largest bitmap.
LEAST_BITS, MOST_BITS = 6, 44
_PICKED = ((0, "estimate", "distinct_names"), (0, "standard_error", "names_error"), (1, "estimate", "distinct_bases"), (1, "standard_error", "bases_error"))
#: The number of a bitmap's last word.
_LAST = "(shiftleft(1L, cast(lm as int) - 6) - 1)"


def standard_error(n: float, m: float) -> float:
    """Relative standard error of linear counting."""
    t = n / m
    return math.sqrt(m * (math.exp(t) - t - 1)) / n if n else 0.0


def bitmap_bits(n: int, target: float = TARGET_ERROR) -> int:
    """The smallest power of two that keeps the standard error at n within the target, and the bitmap from filling up."""
    m = 1 << LEAST_BITS
    while n and (n / m > 700 or standard_error(n, m) > target or math.exp(-n / m) * m < 25):
        m *= 2
    return m


@lru_cache
def most_rows(target: float = TARGET_ERROR) -> list[tuple[int, int]]:
    """``(lm, n)``: up to how many rows each size of bitmap serves, for as many sizes as there are."""
    out = []
    for lm in range(LEAST_BITS, MOST_BITS):
        low, high = 0, 1 << (lm + 5)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if bitmap_bits(mid, target) <= 1 << lm else (low, mid - 1)
        out.append((lm, low))
    return out


@lru_cache
def log_size_sql(n: str, target: float = TARGET_ERROR) -> str:
    """SQL for log2 of the size of a bitmap for n rows."""
    return f"cast(case {' '.join(f'when {n} <= {most} then {lm}' for lm, most in most_rows(target))} else {MOST_BITS} end as int)"


def distinct_sets(sets) -> dict[tuple[str, ...], list]:
    """The sets by the columns that make their groups."""
    same: dict[tuple[str, ...], list] = {}
    for s in sets:
        same.setdefault(tuple(c for c in COLUMNS if c in s or "file_id" in s and c in OF_FILE), []).append(s)
    return same


def group_id(groups: tuple[str, ...]) -> str:
    """SQL for one number for a group and its columns; nulls count as a value."""
    return f"xxhash64({', '.join([repr(','.join(groups)), *(f'coalesce(cast({c} as string), char(0))' for c in groups)])})"


def size_of(groups: tuple[str, ...]) -> str:
    """SQL for log2 of a group's bitmap: for the rows of whichever of its columns has the fewest."""
    sizes = [f"lm_{c}" for c in groups]
    return f"least({', '.join(sizes)})" if len(sizes) > 1 else sizes[0] if sizes else "lm_all"


def sizes(rows: DataFrame, manifest: DataFrame, target: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(day, file_id)``; bitmap sizes by file and what the manifest tells of it; and by day."""
    files = manifest.groupBy("file_id").agg(*(F.min(c).alias(c) for c in ("run_accession", "center", "platform")))
    files = files.withColumn("center", F.upper(F.trim("center")))
    counted = materialise(rows.groupBy("day", "file_id").agg(F.count("*").alias("n")), "p2-sizes")
    of_file = counted.groupBy("file_id").agg(F.sum("n").alias("n")).join(files, "file_id", "left").withColumn("lm_file_id", F.expr(log_size_sql("n", target)))
    for c in OF_FILE:  # a row for each file
        of_file = of_file.withColumn("all", F.sum("n").over(Window.partitionBy(c))).withColumn(f"lm_{c}", F.expr(log_size_sql("all", target))).drop("all")
    by_day = counted.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.expr(log_size_sql("n", target)).alias("lm_day"))
    return counted.select("day", "file_id"), materialise(of_file.drop("n"), "p2-files"), by_day


def partials(rows: DataFrame, groups: list[tuple[str, str, bool]], values: dict[str, str]) -> DataFrame:
    """``(gid, base, kind, lm, word, bits)``: the bitmap words of groups given as SQL for (gid, lm) and base; ``values`` names the columns by kind."""
    hashes = ", ".join(f"struct(cast({k} as tinyint) as kind, case when {c} is not null then xxhash64({c}) end as h)" for k, c in enumerate(values.values()))
    of = ", ".join(f"struct({gid} as gid, {base} as base, cast({lm} as tinyint) as lm)" for gid, lm, base in groups)
    each = rows.select(F.expr(f"array({of})").alias("of"), F.expr(f"explode(array({hashes}))").alias("i")).where("i.h is not null").select("i.kind", "i.h", F.explode("of").alias("g")).select("g.gid", "g.base", "kind", "g.lm", "h")
    split = each.selectExpr("gid", "base", "kind", "lm", f"shiftrightunsigned(h, 6) & {_LAST} as word", "shiftleft(1L, cast(h & 63 as int)) as bits")
    return split.groupBy("gid", "base", "kind", "lm", "word").agg(F.bit_or("bits").alias("bits"))


def folded(parts: DataFrame, lm: Column) -> DataFrame:
    """Bitmaps folded by OR to 2**lm bits, unless they are no larger."""
    return parts.withColumn("lm", F.least("lm", lm.cast("tinyint"))).withColumn("word", F.expr(f"word & {_LAST}"))


def merged(parts: DataFrame) -> DataFrame:
    """Bitwise union of partial results, of whatever days or partitions; unlike sizes fold to the smallest of their group."""
    least = parts.groupBy("gid", "kind").agg(F.min("lm").alias("to"))
    return folded(parts.join(least, ["gid", "kind"]), F.col("to")).groupBy("gid", "kind", "lm", "word").agg(F.bit_or("bits").alias("bits"))


def estimates(parts: DataFrame) -> DataFrame:
    """``(gid, kind, lm, estimate, standard_error)`` of merged bitmaps."""
    ones = parts.groupBy("gid", "kind", "lm").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("ones"))
    m = F.pow(F.lit(2.0), F.col("lm"))
    n = -m * F.log(F.greatest(m - F.col("ones"), F.lit(0.5)) / m)
    t = n / m
    error = F.when(n > 0, F.sqrt(m * F.greatest(F.expm1(t) - t, F.lit(0.0))) / n).otherwise(0.0)
    return ones.select("gid", "kind", "lm", n.alias("estimate"), error.alias("standard_error"))


def identifiers(reads: DataFrame) -> DataFrame:
    """``(day, file_id, name, bases)``, compared as they are counted."""
    name = F.regexp_replace(stripped(F.col("name")), "^@", "")
    bases = F.translate(F.upper(stripped(F.col("bases"))), "U", "T")
    some = lambda c: F.when((F.length(c) > 0) & (c != "*"), c)
    return reads.select(F.to_date("sequenced_at").alias("day"), "file_id", some(name).alias("name"), some(bases).alias("bases"))


def distinct_counts(reads: DataFrame, manifest: DataFrame, target: float = TARGET_ERROR, sets=SETS) -> DataFrame:
    """One row per group of every set: the estimated numbers of distinct names and bases with their standard errors."""
    rows = identifiers(reads)
    same = distinct_sets(sets)
    fine = ("day", *OF_FILE, "file_id")
    direct = [s for s in same if not {"run_accession", "file_id"} & set(s)]
    rest = [s for s in same if s not in direct]
    counted, of_file, by_day = sizes(rows, manifest, target)
    total = log_size_sql(str(reads.count()), target)  # a count from the files' footers

    def sized(df: DataFrame) -> DataFrame:
        of_day = df.join(by_day.withColumnRenamed("day", "d"), F.col("day").eqNullSafe(F.col("d"))).drop("d")
        return of_day.join(of_file.withColumnRenamed("file_id", "f"), F.col("file_id").eqNullSafe(F.col("f"))).drop("f").withColumn("lm_all", F.expr(total))

    groups = [(group_id(s), size_of(s), False) for s in direct] + ([(group_id(fine), "lm_run_accession", True)] if rest else [])
    parts = materialise(partials(sized(rows), groups, {"names": "name", "bases": "bases"}), "p2-partials")
    labels = materialise(sized(counted), "p2-groups")  # a row for each day and file
    found = estimates(parts.where("not base"))
    if rest:
        # a group with run or file is the union of its days and files, folded to its own size
        to = ", ".join(f"struct({group_id(s)} as to, {size_of(s)} as size)" for s in rest)
        into = labels.select(F.expr(group_id(fine)).alias("gid"), F.expr(f"explode(array({to}))").alias("t"))
        met = parts.where("base").join(into, "gid").withColumn("gid", F.col("t.to"))
        found = found.unionByName(estimates(folded(met, F.col("t.size")).groupBy("gid", "kind", "lm", "word").agg(F.bit_or("bits").alias("bits"))))
    cast = lambda c, s: f"cast({c if c in s else 'null'} as {KINDS.get(c, 'string')}) as {c}"
    shown = ", ".join(f"struct({group_id(g)} as gid, {size_of(g)} as lm, '{','.join(s)}' as grouping, {', '.join(cast(c, s) for c in COLUMNS)})" for g, alike in same.items() for s in alike)
    named = labels.select(F.expr(f"explode(array({shown}))").alias("g")).select("g.*").distinct()
    wide = found.groupBy("gid").agg(*(F.expr(f"coalesce(max(case when kind = {k} then {c} end), 0D)").alias(n) for k, c, n in _PICKED))
    zero = (f"coalesce({n}, 0D) as {n}" for _, _, n in _PICKED)
    return named.join(wide, "gid", "left").selectExpr("grouping", *COLUMNS, *zero, "shiftleft(1L, cast(lm as int)) as bitmap_bits")


def accuracy(reads: DataFrame, manifest: DataFrame, target: float = TARGET_ERROR, errors: float = 5.0) -> DataFrame:
    """``(grouping, value, exact_names, exact_bases, names_within, bases_within)`` of all groups by at most one column: the exact
    counts, and whether the estimates lie within that many of their standard errors."""
    sets = [s for s in SETS if len(s) < 2]
    found = distinct_counts(reads, manifest, target, sets)
    value = F.coalesce(*(F.col(c).cast("string") for c in COLUMNS))
    files = manifest.groupBy(F.col("file_id").alias("f")).agg(*(F.min(c).alias(c) for c in OF_FILE)).withColumn("center", F.upper(F.trim("center")))
    known = identifiers(reads).join(files, F.col("file_id") == F.col("f"), "left")
    each = F.explode(F.array(*(F.struct(F.lit(",".join(s)).alias("grouping"), (F.col(s[0]).cast("string") if s else F.lit(None)).alias("value")) for s in sets)))
    ids = known.select(each.alias("g"), *(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in ("name", "bases"))).select("g.*", "name", "bases")
    exact = ids.groupBy(F.col("grouping").alias("e"), F.col("value").alias("v")).agg(F.count_distinct("name").alias("exact_names"), F.count_distinct("bases").alias("exact_bases"))
    both = found.withColumn("value", value).join(exact, (F.col("grouping") == F.col("e")) & F.col("value").eqNullSafe(F.col("v")))
    near = lambda n: (F.abs(F.col(f"distinct_{n}") - F.col(f"exact_{n}")) <= errors * F.col(f"{n}_error") * F.col(f"exact_{n}") + 1).alias(f"{n}_within")
    return both.select("grouping", "value", "exact_names", "exact_bases", near("names"), near("bases"))
