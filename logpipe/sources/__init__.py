"""Line sources: files (batch and stream), text columns, rendered fixtures."""

from logpipe.sources.lines import (
    fan_in, limit_length, mark_too_long, normalise, read_lines, source_label, text_lines,
)

__all__ = ["fan_in", "limit_length", "mark_too_long", "normalise", "read_lines",
           "source_label", "text_lines"]
