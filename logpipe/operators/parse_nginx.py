"""Web-server access log (combined format) and error log."""

from __future__ import annotations

from pyspark.sql import functions as F

from logpipe.functions.regexes import builtin, extract_groups
from logpipe.functions.scalars import contains_any, quote_count_at_least_two, to_int, to_size
from logpipe.functions.timestamps import access_log_time, error_log_time
from logpipe.operators.plan import ParsePlan, choose, unparsed_values
from logpipe.schema import FORMAT, LINE_RAW, LINE_SOURCE

# Line formats and the error-log gate words.
# Access: host ident user [time] "method uri proto" status size "referer" "user agent" ...
ACCESS_RE = builtin(
    r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+(\S+)"\s+(\d+)\s+(\S+)\s+'
    r'"([^"]*)"\s+"([^"]*)".*\z')
# Error: yyyy/MM/dd HH:mm:ss [level] pid...: message
ERROR_RE = builtin(r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+).*?:\s+(.*)\z")
ERROR_GATE_WORDS = ("error", "warn", "notice", "debug")


def nginx_plan() -> ParsePlan:
    raw = F.col(LINE_RAW)
    acc, err = F.col("_acc"), F.col("_err")
    access_gate = raw.startswith('"') | quote_count_at_least_two(raw)
    error_gate = contains_any(raw, ERROR_GATE_WORDS)
    status = to_int(acc[7])
    va = {
        "timestamp": access_log_time(acc[3]),
        "host": acc[0], "ident": acc[1], "user": acc[2],
        "method": acc[4], "uri": acc[5], "proto": acc[6],
        "status": status, "size": to_size(acc[8]), "referer": acc[9], "user_agent": acc[10],
        "message": F.concat(acc[4], F.lit(" "), acc[5]),
        "level": F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info"),
        "raw": LINE_RAW, "source": LINE_SOURCE, FORMAT: F.lit("access"),
    }
    ve = {
        "timestamp": error_log_time(err[0]),
        "level": F.when(err[1] == "error", F.lit("err")).otherwise(err[1]),
        "pid": to_int(err[2]), "message": err[3],
        "raw": LINE_RAW, "source": LINE_SOURCE, FORMAT: F.lit("error"),
    }
    stages = [
        {"_acc": F.when(access_gate, extract_groups(raw, ACCESS_RE, 11))},
        {"_err": F.when(acc.isNull() & error_gate, extract_groups(raw, ERROR_RE, 4))},
    ]
    values = choose([(acc.isNotNull(), va), (err.isNotNull(), ve)], unparsed_values())
    return ParsePlan(stages=stages, ok=acc.isNotNull() | err.isNotNull(), values=values)
