"""Histograms of symbols, their comparison, and what they say of a quality encoding.

Symbols are counted within each partition by ``mapInArrow`` over raw bytes, so that a shuffle moves one row per
partition, group and symbol, not one per base.  Texts are taken as ASCII; null and empty ones count nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (lower, upper) bounds, typical bounds and offsets of the quality intervals.
INTERVALS = {"S": (33, 126, 33, 73, 33), "X": (59, 126, 59, 104, 64), "I": (64, 126, 64, 104, 64), "J": (66, 126, 67, 104, 64), "L": (33, 126, 33, 74, 33)}
#: Scores of the scoring models.
SCORES = range(-5, 41)


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict = {}
    for batch in batches:
        groups = batch.column(0).to_pylist()
        for kind, column in zip(batch.schema.names[1:], batch.columns[1:]):
            texts = [(t or "").encode("ascii", "replace") for t in column.to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            codes, inverse = np.unique(np.array([-1 if g is None else g for g in groups], np.int64), return_inverse=True)
            owner = np.repeat(inverse, [len(t) for t in texts])
            table = np.bincount(owner * 256 + data, minlength=len(codes) * 256).reshape(-1, 256)
            for code, row in zip(codes.tolist(), table):
                key = (code, kind)
                totals[key] = totals[key] + row if key in totals else row.copy()
    out = [(None if g == -1 else g, kind, chr(s), int(row[s])) for (g, kind), row in totals.items() for s in np.flatnonzero(row)]
    cols = list(zip(*out)) if out else [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["grp", "kind", "symbol", "n"])


def symbol_histogram(rows: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """``(group, kind, symbol, n)`` of text columns by an integer group column (-1 is taken for null); ``columns``: kind -> column."""
    picked = rows.select(F.col(group).cast("bigint").alias("grp"), *(F.col(c).alias(k) for k, c in columns.items()))
    partial = picked.mapInArrow(_count_bytes, "grp bigint, kind string, symbol string, n bigint")
    return partial.groupBy(F.col("grp").alias(group), "kind", "symbol").agg(F.sum("n").alias("n"))


def total_histogram(histogram: DataFrame) -> DataFrame:
    """Histograms of groups merged into one: ``(kind, symbol, n)``."""
    return histogram.groupBy("kind", "symbol").agg(F.sum("n").alias("n"))


def histogram_difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("kind", "symbol")) -> DataFrame:
    """``(keys..., n_a, n_b)`` where the counts differ; a missing count is null.  No rows: the histograms are equal."""
    left, right = a.select(*keys, F.col("n").alias("n_a")), b.select(*keys, F.col("n").alias("n_b"))
    return left.join(right, list(keys), "full_outer").where(~F.col("n_a").eqNullSafe(F.col("n_b")))


def interval_weights(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., interval, weight)`` of a quality histogram ``(by..., symbol, n)``: of every interval that holds all its characters,
    the share of characters within the typical bounds."""
    spark = histogram.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in INTERVALS.items()], "interval string, low int, high int, t_low int, t_high int, offset int")
    code = F.ascii("symbol")
    # the fixed intervals as an array: each row of the histogram meets all five
    options = table.agg(F.collect_list(F.struct("interval", "low", "high", "t_low", "t_high")).alias("o")).first()[0]
    literal = F.array(*(F.struct(F.lit(o.interval).alias("interval"), F.lit(o.low).alias("low"), F.lit(o.high).alias("high"), F.lit(o.t_low).alias("t_low"), F.lit(o.t_high).alias("t_high")) for o in options))
    rows = histogram.where("n > 0").select(*by, code.alias("code"), "n", F.explode(literal).alias("i"))
    inside = F.sum(F.when(F.col("code").between(F.col("i.t_low"), F.col("i.t_high")), F.col("n")).otherwise(0))
    out = rows.groupBy(*by, F.col("i.interval").alias("interval"), F.col("i.low").alias("low"), F.col("i.high").alias("high")).agg((inside / F.sum("n")).alias("weight"), F.min("code").alias("a"), F.max("code").alias("b"))
    return out.where((F.col("a") >= F.col("low")) & (F.col("b") <= F.col("high"))).select(*by, "interval", "weight")


def model_shares(kind: str) -> list[float]:
    """Share of each score under uniform error probabilities between 0 and 1 (exclusive), truncated toward zero.

    In closed form: a score's share is the length of the probabilities that give it.
    """
    def edge(score: float) -> float:
        return min(1.0, 10 ** (-score / 10)) if kind == "PHRED" else 1 / (1 + 10 ** (score / 10))

    shares = []
    for s in SCORES:
        # truncation: score s holds values [s, s+1) above zero, (s-1, s] below, (-1, 1) at zero
        low, high = (s, s + 1) if s > 0 else (s - 1, s) if s < 0 else (-1, 1)
        shares.append(max(0.0, edge(low) - edge(high)))
    total = sum(shares)
    return [x / total for x in shares]


def scoring_distances(histogram: DataFrame, offset: int = 33, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., model, distance)``: root mean square distance of a quality histogram to the PHRED and LOGODDS models over the scores -5 to 40."""
    score = F.ascii("symbol") - offset
    rows = histogram.select(*by, score.alias("score"), "n").where(F.col("score").between(SCORES[0], SCORES[-1]))
    shares = rows.groupBy(*by).agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("score", "n"))).alias("m"))  # 46 scores at most
    out = None
    for model in ("PHRED", "LOGODDS"):
        squares = [F.pow(F.lit(p) - F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0)) / F.col("all"), F.lit(2.0)) for s, p in zip(SCORES, model_shares(model))]
        total = squares[0]
        for s in squares[1:]:
            total = total + s
        part = shares.select(*by, F.lit(model).alias("model"), F.sqrt(total / len(SCORES)).alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out
