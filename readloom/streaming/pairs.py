"""Mate assembly over a stream of reads: state per key, dropped when both mates have come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readloom.functions import names

_OUT = "read_key string, forward_name string, forward_bases string, reverse_name string, reverse_bases string"
_STATE = "number int, name string, bases string, until bigint"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
#: How long a read waits for its mate, in event time.
WAIT_MS = 24 * 3600 * 1000


def _assemble(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        _, name, bases, _ = state.get
        state.remove()
        yield pd.DataFrame([(key[0], name, bases, None, None)], columns=_COLUMNS)
        return
    waiting = state.get if state.exists else None
    out = []
    for pdf in frames:
        for number, name, bases, at in pdf.sort_values("number")[["number", "name", "bases", "at"]].itertuples(index=False):
            read = (int(number), name, bases, int(pd.Timestamp(at).value // 1_000_000) + WAIT_MS)
            if waiting is None:
                waiting = read
            elif waiting[0] != read[0]:
                a, b = sorted((waiting, read), key=lambda r: r[0])
                out.append((key[0], a[1], a[2], b[1], b[2]))
                waiting = None
    if waiting is None:
        if state.exists:
            state.remove()
    else:
        state.update(waiting)
        state.setTimeoutTimestamp(max(waiting[3], state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=_COLUMNS)


def assemble_stream(reads: DataFrame, event_time: str = "sequenced_at", late: str = "21 days") -> DataFrame:
    """Pairs of a streaming frame with ``name, bases, file_no`` and an event time, as soon as both mates have come.

    A read comes out as an orphan once the watermark is a day past it.  Reads without name or time are left out; a second
    read of one number is dropped.
    """
    name = F.col("name")
    keyed = reads.where(name.isNotNull() & F.col(event_time).isNotNull()).withWatermark(event_time, late)
    keyed = keyed.select(names.key_or_name(name).alias("read_key"), names.index_or_file(name, F.col("file_no")).alias("number"), "name", "bases", F.col(event_time).alias("at"))
    return keyed.groupBy("read_key").applyInPandasWithState(_assemble, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def file_stats_stream(reads: DataFrame, event_time: str = "sequenced_at", late: str = "21 days", window: str = "1 day") -> DataFrame:
    """Reads and bases by file and window of event time, closed by the watermark; rows later than ``late`` are left out."""
    return reads.withWatermark(event_time, late).groupBy(F.window(event_time, window).alias("w"), "file_id").agg(F.count("*").alias("n_reads"), F.sum(F.length("bases")).alias("n_bases")).select(F.col("w.start").alias("day"), "file_id", "n_reads", "n_bases")
