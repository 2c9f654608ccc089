"""Structured Streaming runners for the pipeline, its outputs, totals and intervals."""

from logpipe.streaming.stream import (
    Counters, Running, finish, start_buffered, start_job, start_pipeline, start_throughput,
)
from logpipe.streaming.totals import Totals, Windows, totals_table

__all__ = ["Counters", "Running", "Totals", "Windows", "finish", "start_buffered", "start_job", "start_pipeline",
           "start_throughput", "totals_table"]
