"""A1 counters and A2 per-window throughput.

Both read a *flagged* event table: every line that reached the pipeline,
with ``_too_long`` (never parsed, S5) and ``_keep`` (passed the filters).
Aggregations are partial per task (map-side) before the shuffle, so the
shuffle carries one row per task (A1) or per task x window x source (A2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logpipe.functions.timestamps import format_rfc3339
from logpipe.sources.lines import TOO_LONG

KEEP = "_keep"


def _too_long() -> Column:
    return F.coalesce(F.col(TOO_LONG), F.lit(False))


def counter_columns() -> list[Column]:
    """processed = lines handed to the parser; dropped = filtered + too long."""
    return [
        F.count_if(~_too_long()).alias("processed"),
        F.count_if(_too_long() | ~F.col(KEEP)).alias("dropped"),
    ]


def stats(flagged: DataFrame) -> DataFrame:
    """A1 as a one-row table ``(processed, dropped, kept)``."""
    return flagged.agg(*counter_columns(), F.count_if(F.col(KEEP)).alias("kept"))


def stats_by(flagged: DataFrame, *keys: str) -> DataFrame:
    """A1 broken down by columns such as ``source`` or ``format``."""
    return flagged.groupBy(*keys).agg(*counter_columns(), F.count_if(F.col(KEEP)).alias("kept"))


def observe(flagged: DataFrame, name: str = "stats") -> tuple[DataFrame, Observation | str]:
    """Attach A1 as observed metrics: the counts arrive with the job's own action.

    Batch: read ``obs.get`` after the action.  Streaming: the metrics appear in
    ``query.lastProgress['observedMetrics'][name]`` per micro-batch.
    """
    if flagged.isStreaming:
        return flagged.observe(name, *counter_columns()), name
    obs = Observation(name)
    return flagged.observe(obs, *counter_columns()), obs


def throughput(flagged: DataFrame, interval: str = "30 seconds", by_source: bool = True,
               watermark: str | None = None) -> DataFrame:
    """A2: per event-time window (and source) counts.

    Lines without a timestamp are not in any window (A1 counts them); nor are
    too-long ones, which are never parsed and so have none.  On a
    stream, ``watermark`` bounds the state and windows are emitted once
    closed (append mode).
    """
    df = flagged.filter(F.col("timestamp").isNotNull())
    if watermark:
        df = df.withWatermark("timestamp", watermark)
    keys = [F.window("timestamp", interval).alias("window")]
    if by_source:
        keys.append(F.col("source"))
    agg = df.groupBy(*keys).agg(*counter_columns(), F.count_if(F.col(KEEP)).alias("kept"))
    cols = [format_rfc3339(F.col("window.start")).alias("window_start"),
            format_rfc3339(F.col("window.end")).alias("window_end")]
    if by_source:
        cols.append(F.col("source"))
    return agg.select(*cols, "processed", "dropped", "kept")


def interval_counts(flagged: DataFrame, interval: str = "30 seconds", late_before: Column | None = None,
                    arrived: Column | None = None) -> DataFrame:
    """A2 of all lines: (window_start, window_end, source, basis, processed, dropped, kept).

    ``basis`` says what put a line into its window: its ``event`` time; its
    event time before ``late_before``, ``late``; or, for lines without a
    timestamp (too-long ones included), when they ``arrived`` (default now).
    So the counts add up to A1, whatever the lines hold.
    """
    time = F.col("timestamp")
    late = F.lit(False) if late_before is None else F.coalesce(time < late_before, F.lit(False))
    basis = F.when(time.isNull(), "arrival").when(late, "late").otherwise("event")
    at = F.coalesce(time, F.current_timestamp() if arrived is None else arrived)
    return (flagged.withColumns({"basis": basis, "_at": at})
            .groupBy(F.window("_at", interval).alias("window"), "source", "basis")
            .agg(*counter_columns(), F.count_if(F.col(KEEP)).alias("kept"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "source", "basis", "processed", "dropped", "kept"))
