"""Column -> Column building blocks (levels, timestamps, regexes, encoders)."""

from logpipe.functions.encode import event_json, event_json_pretty, index_name
from logpipe.functions.levels import level_name, level_rank, severity_level, threshold_rank
from logpipe.functions.timestamps import (
    access_log_time, error_log_time, format_rfc3339, parse_timestamp, rfc3164_time,
)

__all__ = [
    "event_json", "event_json_pretty", "index_name",
    "level_name", "level_rank", "severity_level", "threshold_rank",
    "access_log_time", "error_log_time", "format_rfc3339", "parse_timestamp", "rfc3164_time",
]
