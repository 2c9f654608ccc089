"""Syslog (RFC 5424 first, then RFC 3164)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logpipe.functions.levels import severity_level
from logpipe.functions.regexes import builtin, extract_groups
from logpipe.functions.scalars import to_int
from logpipe.functions.timestamps import parse_timestamp, rfc3164_time
from logpipe.operators.plan import ParsePlan, choose, unparsed_values
from logpipe.schema import FORMAT, LINE_RAW, LINE_SOURCE

# The two line formats (positional groups).
# RFC 5424: pri, version, timestamp, host, program, pid (digits), msgid, structured data, message
RFC5424_RE = builtin(
    r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+?)\s+(\d+)\s+(\S+)\s+(?:\[(.*?)\]\s+)?(.*)\z")
# RFC 3164: pri, "MMM d HH:mm:ss", host, program, optional [pid], message
RFC3164_RE = builtin(
    r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)\z")


def syslog_gate() -> Column:
    raw = F.col(LINE_RAW)
    return raw.startswith("<") & (F.length(raw) >= 4)


def _priority(pri_text: Column) -> dict[str, Column]:
    pri = to_int(pri_text)
    severity = (pri % 8).cast("int")
    return {"facility": F.shiftright(pri, 3), "severity": severity,
            "level": severity_level(severity)}


def syslog_parts(implied_year=None, tz: str = "UTC"):
    """Stages and the two (condition, values) branches, for composition by the router."""
    gate = syslog_gate()
    raw = F.col(LINE_RAW)
    s5, s3 = F.col("_s5"), F.col("_s3")
    v5 = {
        "timestamp": parse_timestamp(s5[2], implied_year),
        "host": s5[3], "program": s5[4], "pid": s5[5].try_cast("bigint"),
        "msgid": s5[6], "structured_data": F.when(s5[7] != "", s5[7]),
        "message": s5[8], "raw": LINE_RAW, "source": LINE_SOURCE, FORMAT: F.lit("rfc5424"),
        **_priority(s5[0]),
    }
    v3 = {
        "timestamp": rfc3164_time(s3[1], implied_year, tz),
        "host": s3[2], "program": s3[3],
        "pid": F.when(s3[4] != "", s3[4].try_cast("bigint")),
        "message": s3[5], "raw": LINE_RAW, "source": LINE_SOURCE, FORMAT: F.lit("rfc3164"),
        **_priority(s3[0]),
    }
    stages = [
        {"_s5": F.when(gate, extract_groups(raw, RFC5424_RE, 9))},
        {"_s3": F.when(gate & s5.isNull(), extract_groups(raw, RFC3164_RE, 6))},
    ]
    return stages, [(s5.isNotNull(), v5), (s3.isNotNull(), v3)]


def syslog_plan(implied_year=None, tz: str = "UTC") -> ParsePlan:
    stages, branches = syslog_parts(implied_year, tz)
    ok = branches[0][0] | branches[1][0]
    return ParsePlan(stages=stages, ok=ok, values=choose(branches, unparsed_values()))
