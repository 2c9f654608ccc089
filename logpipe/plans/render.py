"""Render log lines from the driver's tables (test and benchmark inputs).

The formulas are fixed so an oracle can compute the expected event from the
original columns without parsing.  Each function returns a line table
``(line_id, raw, source, file_path)``; ``line_id`` is ``event_id`` (or
``page_id``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Level of each rendered event, by event type.
EVENT_LEVELS = {"error": "error", "purchase": "warn", "signup": "notice",
                "click": "info", "view": "debug"}
STATUS_BY_MOD4 = (200, 301, 404, 500)
PATH_RE = r"^[a-z]+://[^/?#]*([^?#]*)"


def level_of(event_type: Column) -> Column:
    expr = None
    for k, v in EVENT_LEVELS.items():
        expr = (F.when(event_type == k, v) if expr is None else expr.when(event_type == k, v))
    return expr


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def iso_us(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def json_line() -> Column:
    return F.concat(
        F.lit('{"ts":"'), iso_us(F.col("ts")), F.lit('","lvl":"'), level_of(F.col("event_type")),
        F.lit('","msg":"'), F.col("event_type"), F.lit('","user_id":'), _s("user_id"),
        F.lit(',"value":'), _s("value"), F.lit(',"props":'), F.col("props"), F.lit("}"))


def rfc3164_line() -> Column:
    ts = F.col("ts")
    pid = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("["), _s("event_id"), F.lit("]")))
    return F.concat(
        F.lit("<"), _s(F.col("event_id") % 192), F.lit(">"), F.date_format(ts, "MMM"), F.lit(" "),
        F.lpad(_s(F.dayofmonth(ts)), 2, " "), F.lit(" "), F.date_format(ts, "HH:mm:ss"),
        F.lit(" host"), _s(F.col("user_id") % 10), F.lit(" "), F.col("event_type"), pid,
        F.lit(": value="), _s("value"))


def rfc5424_line() -> Column:
    k = F.get_json_object(F.col("props"), "$.k")
    sd = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[k="'), k, F.lit('"] '))).otherwise(F.lit(""))
    return F.concat(
        F.lit("<"), _s(F.col("event_id") % 192), F.lit(">1 "), iso_us(F.col("ts")),
        F.lit(" host"), _s(F.col("user_id") % 10), F.lit(" "), F.col("event_type"), F.lit(" "),
        _s("event_id"), F.lit(" ID"), _s("user_id"), F.lit(" "), sd, F.lit("value="), _s("value"))


def access_line() -> Column:
    eid = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_MOD4]), (eid % 4 + 1).cast("int"))
    size = F.when(eid % 5 == 0, F.lit("-")).otherwise(_s(eid))
    return F.concat(
        F.lit("10.0.0."), _s(F.col("user_id") % 256), F.lit(" - u"), _s("user_id"), F.lit(" ["),
        F.date_format(F.col("ts"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /e/'), _s(eid),
        F.lit(' HTTP/1.1" '), _s(status), F.lit(" "), size, F.lit(' "-" "ua/'), _s("user_id"), F.lit('"'))


def error_line() -> Column:
    lvl = F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("warn"))
    return F.concat(
        F.date_format(F.col("ts"), "yyyy/MM/dd HH:mm:ss"), F.lit(" ["), lvl, F.lit("] "),
        _s("event_id"), F.lit("#0: *"), _s("user_id"), F.lit(" "), F.col("event_type"))


def text_line() -> Column:
    return F.concat(F.col("event_type"), F.lit(" event for user "), _s("user_id"),
                    F.lit(" value "), _s("value"))


def mixed_line() -> Column:
    m = F.col("event_id") % 4
    return (F.when(m == 0, json_line()).when(m == 1, rfc3164_line())
            .when(m == 2, rfc5424_line()).otherwise(text_line()))


RENDERERS = {
    "json": json_line, "rfc3164": rfc3164_line, "rfc5424": rfc5424_line,
    "access": access_line, "error": error_line, "text": text_line, "mixed": mixed_line,
}


def event_lines(events: DataFrame, kind: str, source: str = "events") -> DataFrame:
    """Line table rendered from ``events`` by one of ``RENDERERS``."""
    return events.select(
        F.col("event_id").alias("line_id"), RENDERERS[kind]().alias("raw"),
        F.lit(source).alias("source"), F.lit(None).cast("string").alias("file_path"))


def page_status() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_MOD4]), (F.col("page_id") % 4 + 1).cast("int"))


def page_access_lines(pages: DataFrame, source: str = "pages") -> DataFrame:
    """Access lines whose URI is the path part of ``pages.url``."""
    path = F.regexp_extract(F.col("url"), PATH_RE, 1)
    uri = F.when(path == "", F.lit("/")).otherwise(path)
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    raw = F.concat(
        F.lit("10.0.1."), _s(F.col("page_id") % 256), F.lit(" - - ["),
        F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), uri,
        F.lit(' HTTP/1.1" '), _s(page_status()), F.lit(" "), _s(F.length("html")), F.lit(' "-" "crawler/1"'))
    return pages.select(F.col("page_id").alias("line_id"), raw.alias("raw"),
                        F.lit(source).alias("source"), F.lit(None).cast("string").alias("file_path"))


def alias_json_line() -> Column:
    """JSON lines exercising the alias rules (even / odd event ids)."""
    even = F.concat(
        F.lit('{"ts":"'), iso_us(F.col("ts")), F.lit('","time":"bad","msg":"'), F.col("event_type"),
        F.lit('","log":"L'), _s("user_id"), F.lit('","lvl":"'), level_of(F.col("event_type")),
        F.lit('","logger":"svc'), _s(F.col("user_id") % 7), F.lit('"}'))
    odd = F.concat(
        F.lit('{"message":"'), F.col("event_type"), F.lit('","msg":"m'), _s("user_id"),
        F.lit('","level":'), _s("user_id"), F.lit(',"source":"s'), _s(F.col("user_id") % 3),
        F.lit('","time":"'), iso_us(F.col("ts")), F.lit('"}'))
    return F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)


def defaults_json_line() -> Column:
    """JSON lines with and without their own ``raw`` / ``source`` keys."""
    even = F.concat(F.lit('{"msg":"'), F.col("event_type"), F.lit('","raw":"R'), _s("event_id"), F.lit('"}'))
    odd = F.concat(F.lit('{"msg":"'), F.col("event_type"), F.lit('","source":"S'), _s("user_id"), F.lit('"}'))
    return F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)


def syslog_line() -> Column:
    """RFC 3164 on odd ids, RFC 5424 on even ids."""
    return F.when(F.col("event_id") % 2 == 1, rfc3164_line()).otherwise(rfc5424_line())


def timestamp_text() -> Column:
    """``events.ts`` written in eight of the accepted timestamp layouts (by ``event_id % 8``)."""
    ts = F.col("ts")
    m = F.col("event_id") % 8
    stamp = F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.lpad(_s(F.dayofmonth(ts)), 2, " "),
                     F.lit(" "), F.date_format(ts, "HH:mm:ss"))
    return (F.when(m == 0, iso_us(ts))
            .when(m == 1, F.concat(F.date_format(ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE"),
                                                 "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+05:30")))
            .when(m == 2, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
            .when(m == 3, F.concat(F.date_format(ts - F.expr("INTERVAL 7 HOURS"), "dd MMM yy HH:mm"),
                                   F.lit(" -0700")))
            .when(m == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))
            .when(m == 5, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
            .when(m == 6, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .otherwise(stamp))


def timestamp_forms() -> Column:
    """``events.ts``, spread over twelve months, in unusual forms of the layouts (by ``event_id % 7``)."""
    ts = F.col("ts") + F.make_dt_interval((F.col("event_id") % 12 * 30).cast("int"))
    m = F.col("event_id") % 7
    at = F.date_format(ts, "HH:mm:ss")
    return (F.when(m == 0, F.concat(F.date_format(ts, "EEE, dd MMM yyyy "), at, F.lit(".25 GMT")))
            .when(m == 1, F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" 5:00:00")))
            .when(m == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'"), at, F.lit(",5Z")))
            .when(m == 3, F.concat(F.lower(F.date_format(ts, "MMM")), F.lit("  "), _s(F.dayofmonth(ts)), F.lit(" "), at))
            .when(m == 4, F.concat(F.date_format(ts, "yyyy/MM/dd"), F.lit("   "), at))
            .when(m == 5, F.concat(F.upper(F.date_format(ts, "MMM")), F.lit(" "), F.lpad(_s(F.dayofmonth(ts)), 2, " "),
                                   F.lit(" "), at, F.lit(".125")))
            .otherwise(F.concat(F.upper(F.date_format(ts, "EEE, dd MMM yyyy ")), at, F.lit("  +0000"))))


RENDERERS.update({"alias_json": alias_json_line, "defaults_json": defaults_json_line,
                  "syslog": syslog_line, "timestamp_text": timestamp_text,
                  "timestamp_forms": timestamp_forms})
