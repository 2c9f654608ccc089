"""Registered queries over the driver's tables, each with an equivalent DuckDB SQL.

Lines are rendered from the tables by fixed formulas (``logpipe.plans.render``)
and pushed through the engine; the SQL computes the expected result from the
original columns, so it shares no parsing logic with the engine.  Outputs
are flat scalar columns: BIGINT, DOUBLE or STRING; timestamps as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logpipe.functions.encode import event_json
from logpipe.functions.levels import facility_name
from logpipe.functions.timestamps import parse_timestamp
from logpipe.operators import fields
from logpipe.operators.filters import DropRule, FilterSpec, apply_filter
from logpipe.operators.parse import parse
from logpipe.operators.stats import stats, stats_by, throughput
from logpipe.operators.transforms import Transform, apply_transforms
from logpipe.plans.pipeline import build_from_lines
from logpipe.plans.spec import PipelineSpec, SourceSpec
from logpipe.sinks.payloads import bulk_payload, kafka_payload, webhook_batches
from logpipe.sources.lines import fan_in, limit_length, source_label, text_lines
from logpipe.plans.render import event_lines, page_access_lines

REFERENCE_YEAR = 2024  # the events tables cover January 2024

# ---------------------------------------------------------------- helpers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return event_lines(table(spark, sf_dir, "events"), kind)


def parsed(spark, sf_dir, kind: str, fmt: str) -> DataFrame:
    return parse(lines_of(spark, sf_dir, kind), fmt, implied_year=REFERENCE_YEAR)


def ts_text(c: str | Column = "timestamp") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def vget(field: str, dtype: str) -> Column:
    return F.try_variant_get(fields.get_variant(field), "$", dtype)


def sget(field: str) -> Column:
    return fields.get_string(field)


def doc_lines(spark, sf_dir) -> DataFrame:
    return text_lines(table(spark, sf_dir, "documents"), "text", "documents", keep=["doc_id"])


def key_list() -> Column:
    return F.array_join(F.array_sort(F.json_object_keys(event_json())), ",")


# SQL fragments (DuckDB)
LEVEL_SQL = ("CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' "
             "WHEN 'signup' THEN 'notice' WHEN 'click' THEN 'info' WHEN 'view' THEN 'debug' END")
LEVEL_RANK_SQL = ("CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 "
                  "WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END")
SEV_SQL = "(['emerg','alert','crit','err','warn','notice','info','debug'])[event_id % 8 + 1]"
SEV_RANK_SQL = "([6,6,5,4,3,2,1,0])[event_id % 8 + 1]"
TS_US = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
TS_S = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f')"
ISO_US = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
K_SQL = "json_extract_string(props, '$.k')"
V = "CAST(value AS VARCHAR)"
DOC_LINES_SQL = """
  s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
  u AS (SELECT doc_id, parts, generate_subscripts(parts, 1) AS i FROM s),
  dl AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no,
                regexp_replace(parts[i], '[\\r\\n]+$', '') AS raw FROM u)"""

# ---------------------------------------------------------------- sources


def q_s4_normalise(spark, d):
    return doc_lines(spark, d).select(
        "doc_id", big("line_no").alias("line_no"), big(F.octet_length("raw")).alias("n_bytes"),
        F.md5("raw").alias("md5"))


SQL_S4 = f"""WITH {DOC_LINES_SQL}
SELECT doc_id, line_no, CAST(strlen(raw) AS BIGINT) AS n_bytes, md5(raw) AS md5 FROM dl WHERE raw <> ''"""


def q_s5_max_len(spark, d):
    return limit_length(doc_lines(spark, d), 4096).select(
        "doc_id", big("line_no").alias("line_no"), big(F.octet_length("raw")).alias("n_bytes"))


SQL_S5 = f"""WITH {DOC_LINES_SQL}
SELECT doc_id, line_no, CAST(strlen(raw) AS BIGINT) AS n_bytes FROM dl WHERE raw <> '' AND strlen(raw) <= 4096"""


def q_s7_fan_in(spark, d):
    docs = doc_lines(spark, d).select("source", F.col("doc_id").alias("id"), F.lit(0).alias("sub"),
                                      "line_no", "raw")
    conv = text_lines(table(spark, d, "conversations"), "text", "conversations",
                      keep=["conv_id", "turn"]).select(
        "source", F.col("conv_id").alias("id"), F.col("turn").alias("sub"), "line_no", "raw")
    return fan_in([docs, conv]).select(
        "source", big("id").alias("id"), big("sub").alias("sub"), big("line_no").alias("line_no"),
        big(F.octet_length("raw")).alias("n_bytes"), F.md5("raw").alias("md5"))


SQL_S7 = f"""WITH {DOC_LINES_SQL},
  cs AS (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations),
  cu AS (SELECT conv_id, turn, parts, generate_subscripts(parts, 1) AS i FROM cs),
  cl AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS line_no,
                regexp_replace(parts[i], '[\\r\\n]+$', '') AS raw FROM cu)
SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS sub, line_no,
       CAST(strlen(raw) AS BIGINT) AS n_bytes, md5(raw) AS md5 FROM dl WHERE raw <> ''
UNION ALL
SELECT 'conversations', conv_id, turn, line_no, CAST(strlen(raw) AS BIGINT), md5(raw) FROM cl WHERE raw <> ''"""

# ---------------------------------------------------------------- JSON


def q_p2_json(spark, d):
    ev = parsed(spark, d, "json", "json")
    return ev.select("line_id", ts_text().alias("ts"), "level", "message", "source", "format",
                     vget("user_id", "bigint").alias("user_id"), vget("value", "double").alias("value"),
                     F.try_variant_get(fields.get_variant("props"), "$.k", "bigint").alias("k"))


SQL_P2 = f"""SELECT event_id AS line_id, {TS_US} AS ts, {LEVEL_SQL} AS level, event_type AS message,
  'events' AS source, 'json' AS format, user_id, value, CAST({K_SQL} AS BIGINT) AS k FROM events"""


def q_p3_alias(spark, d):
    ev = parsed(spark, d, "alias_json", "auto")
    return ev.select("line_id", ts_text().alias("ts"), "level", "message", "source",
                     F.try_variant_get(fields.attr("level"), "$", "bigint").alias("level_num"),
                     big(fields.has_attr("log")).alias("has_log"))


SQL_P3 = f"""SELECT event_id AS line_id, {TS_US} AS ts,
  CASE WHEN event_id % 2 = 0 THEN {LEVEL_SQL} END AS level, event_type AS message,
  CASE WHEN event_id % 2 = 0 THEN 'svc' || CAST(user_id % 7 AS VARCHAR)
       ELSE 's' || CAST(user_id % 3 AS VARCHAR) END AS source,
  CASE WHEN event_id % 2 = 1 THEN user_id END AS level_num,
  CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS has_log FROM events"""


def q_p4_defaults(spark, d):
    ev = parsed(spark, d, "defaults_json", "json")
    return ev.select("line_id", "source", "raw", "message")


SQL_P4 = """SELECT event_id AS line_id,
  CASE WHEN event_id % 2 = 0 THEN 'events' ELSE 'S' || CAST(user_id AS VARCHAR) END AS source,
  CASE WHEN event_id % 2 = 0 THEN 'R' || CAST(event_id AS VARCHAR)
       ELSE '{"msg":"' || event_type || '","source":"S' || CAST(user_id AS VARCHAR) || '"}' END AS raw,
  event_type AS message FROM events"""

# ---------------------------------------------------------------- syslog


def _syslog_cols():
    return [big("facility").alias("facility"), big("severity").alias("severity"), "level"]


def q_p6_rfc5424(spark, d):
    ev = parsed(spark, d, "rfc5424", "syslog")
    return ev.select("line_id", ts_text().alias("ts"), "host", "program", big("pid").alias("pid"),
                     "msgid", "structured_data", "message", *_syslog_cols(), "format")


SQL_P6 = f"""SELECT event_id AS line_id, {TS_US} AS ts, 'host' || CAST(user_id % 10 AS VARCHAR) AS host,
  event_type AS program, event_id AS pid, 'ID' || CAST(user_id AS VARCHAR) AS msgid,
  CASE WHEN event_id % 2 = 0 THEN 'k="' || {K_SQL} || '"' END AS structured_data,
  'value=' || {V} AS message, CAST((event_id % 192) // 8 AS BIGINT) AS facility,
  CAST(event_id % 8 AS BIGINT) AS severity, {SEV_SQL} AS level, 'rfc5424' AS format FROM events"""


def q_p7_rfc3164(spark, d):
    ev = parsed(spark, d, "rfc3164", "syslog")
    return ev.select("line_id", ts_text().alias("ts"), "host", "program", big("pid").alias("pid"),
                     "message", *_syslog_cols(), "format")


SQL_P7 = f"""SELECT event_id AS line_id, {TS_S} AS ts, 'host' || CAST(user_id % 10 AS VARCHAR) AS host,
  event_type AS program, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS pid,
  'value=' || {V} AS message, CAST((event_id % 192) // 8 AS BIGINT) AS facility,
  CAST(event_id % 8 AS BIGINT) AS severity, {SEV_SQL} AS level, 'rfc3164' AS format FROM events"""


def q_p7b_priority(spark, d):
    ev = parsed(spark, d, "syslog", "syslog")
    return ev.select("line_id", "format", *_syslog_cols(), facility_name(F.col("facility")).alias("facility_name"))


SQL_P7B = f"""SELECT event_id AS line_id, CASE WHEN event_id % 2 = 1 THEN 'rfc3164' ELSE 'rfc5424' END AS format,
  CAST((event_id % 192) // 8 AS BIGINT) AS facility, CAST(event_id % 8 AS BIGINT) AS severity,
  {SEV_SQL} AS level,
  CASE (event_id % 192) // 8 WHEN 0 THEN 'kern' WHEN 1 THEN 'user' WHEN 2 THEN 'mail'
    WHEN 3 THEN 'daemon' WHEN 4 THEN 'auth' WHEN 9 THEN 'syslog' WHEN 16 THEN 'local0'
    WHEN 17 THEN 'local1' WHEN 18 THEN 'local2' WHEN 19 THEN 'local3' WHEN 20 THEN 'local4'
    WHEN 21 THEN 'local5' WHEN 22 THEN 'local6' WHEN 23 THEN 'local7' END AS facility_name
FROM events"""

# ---------------------------------------------------------------- web server logs


def q_p8_access(spark, d):
    ev = parsed(spark, d, "access", "nginx")
    return ev.select("line_id", ts_text().alias("ts"), "host", "ident", "user", "method", "uri", "proto",
                     big("status").alias("status"), big("size").alias("size"), "referer", "user_agent",
                     "message", "level", "format")


SQL_P8 = f"""SELECT event_id AS line_id, {TS_S} AS ts, '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS host,
  '-' AS ident, 'u' || CAST(user_id AS VARCHAR) AS "user", 'GET' AS method,
  '/e/' || CAST(event_id AS VARCHAR) AS uri, 'HTTP/1.1' AS proto,
  CAST(([200,301,404,500])[event_id % 4 + 1] AS BIGINT) AS status,
  CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS BIGINT) AS size,
  '-' AS referer, 'ua/' || CAST(user_id AS VARCHAR) AS user_agent,
  'GET /e/' || CAST(event_id AS VARCHAR) AS message,
  CASE event_id % 4 WHEN 3 THEN 'error' WHEN 2 THEN 'warn' ELSE 'info' END AS level, 'access' AS format
FROM events"""


def q_p8c_level(spark, d):
    ev = parse(page_access_lines(table(spark, d, "pages")), "nginx")
    return ev.select("line_id", ts_text().alias("ts"), "uri", big("status").alias("status"),
                     big("size").alias("size"), "level", "message")


SQL_P8C = """WITH p AS (SELECT page_id, html,
    CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
         ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS uri FROM pages)
SELECT page_id AS line_id,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS ts,
  uri, CAST(([200, 301, 404, 500])[page_id % 4 + 1] AS BIGINT) AS status, CAST(length(html) AS BIGINT) AS size,
  (['info', 'info', 'warn', 'error'])[page_id % 4 + 1] AS level, 'GET ' || uri AS message FROM p"""


def q_p9_error(spark, d):
    ev = parsed(spark, d, "error", "nginx")
    return ev.select("line_id", ts_text().alias("ts"), "level", big("pid").alias("pid"), "message", "format")


SQL_P9 = f"""SELECT event_id AS line_id, {TS_S} AS ts,
  CASE WHEN event_type = 'error' THEN 'err' ELSE 'warn' END AS level, event_id AS pid,
  '*' || CAST(user_id AS VARCHAR) || ' ' || event_type AS message, 'error' AS format FROM events"""

# ---------------------------------------------------------------- routing


def q_p11_auto(spark, d):
    ev = parsed(spark, d, "mixed", "auto")
    return ev.select("line_id", "format", "level", "message", "host", "program", ts_text().alias("ts"))


_TEXT_SQL = "event_type || ' event for user ' || CAST(user_id AS VARCHAR) || ' value ' || " + V
SQL_P11 = f"""SELECT event_id AS line_id,
  CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'rfc3164' WHEN 2 THEN 'rfc5424' ELSE 'raw' END AS format,
  CASE event_id % 4 WHEN 0 THEN {LEVEL_SQL} WHEN 3 THEN NULL ELSE {SEV_SQL} END AS level,
  CASE event_id % 4 WHEN 0 THEN event_type WHEN 3 THEN {_TEXT_SQL} ELSE 'value=' || {V} END AS message,
  CASE WHEN event_id % 4 IN (1, 2) THEN 'host' || CAST(user_id % 10 AS VARCHAR) END AS host,
  CASE WHEN event_id % 4 IN (1, 2) THEN event_type END AS program,
  CASE event_id % 4 WHEN 0 THEN {TS_US} WHEN 1 THEN {TS_S} WHEN 2 THEN {TS_US} END AS ts
FROM events"""


def q_p12_unparsed(spark, d):
    ev = parsed(spark, d, "mixed", "syslog")
    return ev.select("line_id", "format", "level", "message")


SQL_P12 = f"""SELECT event_id AS line_id,
  CASE event_id % 4 WHEN 1 THEN 'rfc3164' WHEN 2 THEN 'rfc5424' ELSE 'unparsed' END AS format,
  CASE WHEN event_id % 4 IN (1, 2) THEN {SEV_SQL} END AS level,
  CASE WHEN event_id % 4 IN (1, 2) THEN 'value=' || {V} END AS message FROM events"""


def q_x12_render(spark, d):
    return parsed(spark, d, "rfc3164", "syslog").select("line_id", event_json().alias("json"))


_RAW3164_SQL = ("'<' || CAST(event_id % 192 AS VARCHAR) || '>' || strftime(ts, '%b') || ' ' || "
                "lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') || ' host' || "
                "CAST(user_id % 10 AS VARCHAR) || ' ' || event_type || "
                "CASE WHEN event_id % 3 = 0 THEN '' ELSE '[' || CAST(event_id AS VARCHAR) || ']' END || "
                "': value=' || " + V)
SQL_X12 = f"""SELECT event_id AS line_id,
  '{{"facility":' || CAST((event_id % 192) // 8 AS VARCHAR) || ',"host":"host' || CAST(user_id % 10 AS VARCHAR)
  || '","level":"' || {SEV_SQL} || '","message":"value=' || {V} || '",'
  || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"pid":' || CAST(event_id AS VARCHAR) || ',' END
  || '"program":"' || event_type || '","raw":"' || {_RAW3164_SQL} || '","severity":' || CAST(event_id % 8 AS VARCHAR)
  || ',"source":"events","timestamp":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%fZ') || '"}}' AS json
FROM events"""


def q_x12_json(spark, d):
    """Whole rendered JSON events: sorted keys, aliases, defaults and the escaped raw line."""
    return parsed(spark, d, "alias_json", "auto").select("line_id", event_json().alias("json"))


_JSON_STR = "CAST(to_json({}) AS VARCHAR)".format
_USER, _SVC = "CAST(user_id AS VARCHAR)", "CAST(user_id % 7 AS VARCHAR)"
_ALIAS_RAW_SQL = f"""CASE WHEN event_id % 2 = 0
  THEN '{{"ts":"' || {ISO_US} || '","time":"bad","msg":"' || event_type || '","log":"L' || {_USER} || '","lvl":"'
       || {LEVEL_SQL} || '","logger":"svc' || {_SVC} || '"}}'
  ELSE '{{"message":"' || event_type || '","msg":"m' || {_USER} || '","level":' || {_USER} || ',"source":"s'
       || CAST(user_id % 3 AS VARCHAR) || '","time":"' || {ISO_US} || '"}}' END"""
_ALIAS_JSON_SQL = f"""CASE WHEN event_id % 2 = 0
  THEN '{{"level":"' || {LEVEL_SQL} || '","log":"L' || {_USER} || '","logger":"svc' || {_SVC} || '","lvl":"'
       || {LEVEL_SQL} || '","message":"' || event_type || '","msg":"' || event_type || '","raw":'
       || {_JSON_STR(_ALIAS_RAW_SQL)} || ',"source":"svc' || {_SVC} || '","time":"bad","timestamp":"' || {ISO_US}
       || '","ts":"' || {ISO_US} || '"}}'
  ELSE '{{"level":' || {_USER} || ',"message":"' || event_type || '","msg":"m' || {_USER} || '","raw":'
       || {_JSON_STR(_ALIAS_RAW_SQL)} || ',"source":"s' || CAST(user_id % 3 AS VARCHAR) || '","time":"' || {ISO_US}
       || '","timestamp":"' || {ISO_US} || '"}}' END"""
SQL_X12_JSON = f"SELECT event_id AS line_id, {_ALIAS_JSON_SQL} AS json FROM events"


def q_p7_rfc3164_re2(spark, d):
    ev = parsed(spark, d, "rfc3164", "syslog")
    return ev.select("line_id", "host", "program", big("pid").alias("pid"), "message",
                     big("facility").alias("facility"))


# RE2 oracle: DuckDB renders the same line and extracts the groups with the RE2 pattern.
_RE3164 = r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)$"
SQL_P7_RE2 = f"""WITH l AS (SELECT event_id, {_RAW3164_SQL} AS line FROM events)
SELECT event_id AS line_id, regexp_extract(line, '{_RE3164}', 3) AS host,
  regexp_extract(line, '{_RE3164}', 4) AS program,
  CAST(NULLIF(regexp_extract(line, '{_RE3164}', 5), '') AS BIGINT) AS pid,
  regexp_extract(line, '{_RE3164}', 6) AS message,
  CAST(CAST(regexp_extract(line, '{_RE3164}', 1) AS BIGINT) // 8 AS BIGINT) AS facility
FROM l WHERE regexp_matches(line, '{_RE3164}')"""


def q_p8_access_re2(spark, d):
    ev = parsed(spark, d, "access", "nginx")
    return ev.select("line_id", "user", "uri", big("status").alias("status"), big("size").alias("size"), "level")


_RAW_ACCESS_SQL = ("'10.0.0.' || CAST(user_id % 256 AS VARCHAR) || ' - u' || CAST(user_id AS VARCHAR) || ' [' || "
                   "strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"GET /e/' || CAST(event_id AS VARCHAR) || "
                   "' HTTP/1.1\" ' || CAST(([200,301,404,500])[event_id % 4 + 1] AS VARCHAR) || ' ' || "
                   "CASE WHEN event_id % 5 = 0 THEN '-' ELSE CAST(event_id AS VARCHAR) END || "
                   "' \"-\" \"ua/' || CAST(user_id AS VARCHAR) || '\"'")
_REACC = (r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+(\S+)"\s+(\d+)\s+(\S+)\s+'
          r'"([^"]*)"\s+"([^"]*)".*$')
SQL_P8_RE2 = f"""WITH l AS (SELECT event_id, {_RAW_ACCESS_SQL} AS line FROM events),
  g AS (SELECT event_id, regexp_extract(line, '{_REACC}', 3) AS "user", regexp_extract(line, '{_REACC}', 6) AS uri,
               CAST(regexp_extract(line, '{_REACC}', 8) AS BIGINT) AS status,
               regexp_extract(line, '{_REACC}', 9) AS size_text
        FROM l WHERE regexp_matches(line, '{_REACC}'))
SELECT event_id AS line_id, "user", uri, status,
  CAST(CASE WHEN size_text = '-' THEN 0 ELSE CAST(size_text AS BIGINT) END AS BIGINT) AS size,
  CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 THEN 'warn' ELSE 'info' END AS level
FROM g"""


def q_x1_timestamp(spark, d):
    lines = lines_of(spark, d, "timestamp_text")
    return lines.select("line_id", ts_text(parse_timestamp(F.col("raw"), REFERENCE_YEAR)).alias("ts"))


SQL_X1 = """SELECT event_id AS line_id, strftime(CASE event_id % 8
    WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts) WHEN 3 THEN date_trunc('minute', ts)
    WHEN 4 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END,
  '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events"""

# ---------------------------------------------------------------- filters


def _doc_events(spark, d) -> DataFrame:
    return parse(doc_lines(spark, d), "raw")


def q_f1_include(spark, d):
    ev = apply_filter(_doc_events(spark, d), FilterSpec(include_regex="th[a-z]*er"))
    return ev.select("doc_id", big("line_no").alias("line_no"), big(F.octet_length("raw")).alias("n_bytes"))


SQL_F1 = f"""WITH {DOC_LINES_SQL}
SELECT doc_id, line_no, CAST(strlen(raw) AS BIGINT) AS n_bytes FROM dl
WHERE raw <> '' AND regexp_matches(raw, 'th[a-z]*er')"""


def q_f2_exclude(spark, d):
    ev = apply_filter(_doc_events(spark, d), FilterSpec(exclude_regex="[0-9]|qu"))
    return ev.select("doc_id", big("line_no").alias("line_no"), big(F.octet_length("raw")).alias("n_bytes"))


SQL_F2 = f"""WITH {DOC_LINES_SQL}
SELECT doc_id, line_no, CAST(strlen(raw) AS BIGINT) AS n_bytes FROM dl
WHERE raw <> '' AND NOT regexp_matches(raw, '[0-9]|qu')"""


def q_f3_min_level(spark, d):
    ev = apply_filter(parsed(spark, d, "json", "json"), FilterSpec(min_level="warn"))
    return ev.select("line_id", "level")


SQL_F3 = f"SELECT event_id AS line_id, {LEVEL_SQL} AS level FROM events WHERE event_type IN ('error', 'purchase')"


def q_f4_drop(spark, d):
    ev = apply_filter(parsed(spark, d, "json", "json"), FilterSpec(drop=DropRule("message", "click")))
    return ev.select("line_id", "message")


SQL_F4 = "SELECT event_id AS line_id, event_type AS message FROM events WHERE event_type <> 'click'"


def q_f5_expr(spark, d):
    spec = FilterSpec(expr="try_variant_get(attrs['value'], '$', 'double') > 100.0")
    ev = apply_filter(parsed(spark, d, "json", "json"), spec)
    return ev.select("line_id", vget("value", "double").alias("value"))


SQL_F5 = "SELECT event_id AS line_id, value FROM events WHERE value > 100.0"

# ---------------------------------------------------------------- transforms


def _json_events(spark, d) -> DataFrame:
    return parsed(spark, d, "json", "json")


def q_t1_add(spark, d):
    ev = apply_transforms(_json_events(spark, d), [
        Transform("add", "service", value="myapp"), Transform("set", "environment", value="production"),
        Transform("set", "level", value="notice")])
    return ev.select("line_id", sget("service").alias("service"), sget("environment").alias("environment"),
                     "level")


SQL_T1 = "SELECT event_id AS line_id, 'myapp' AS service, 'production' AS environment, 'notice' AS level FROM events"


def q_t3_rename(spark, d):
    ev = apply_transforms(_json_events(spark, d), [
        Transform("rename", "user_id", to="uid"), Transform("rename", "msg", to="message"),
        Transform("rename", "lvl", to="severity_text"), Transform("rename", "ts", to="time"),
        Transform("rename", "absent_key", to="other")])
    return ev.select("line_id", vget("uid", "bigint").alias("uid"), big(fields.present("user_id")).alias("has_user_id"),
                     "message", big(fields.present("msg")).alias("has_msg"),
                     sget("severity_text").alias("severity_text"), "level", sget("time").alias("time"),
                     big(fields.present("other")).alias("has_other"))


SQL_T3 = f"""SELECT event_id AS line_id, user_id AS uid, CAST(0 AS BIGINT) AS has_user_id,
  event_type AS message, CAST(0 AS BIGINT) AS has_msg, {LEVEL_SQL} AS severity_text,
  {LEVEL_SQL} AS level, {ISO_US} AS time, CAST(0 AS BIGINT) AS has_other FROM events"""


def q_t4_remove(spark, d):
    ev = apply_transforms(_json_events(spark, d), [Transform("remove", "props"), Transform("remove", "lvl")])
    return ev.select("line_id", key_list().alias("keys"))


SQL_T4 = "SELECT event_id AS line_id, 'level,message,msg,raw,source,timestamp,ts,user_id,value' AS keys FROM events"


def q_t5_remove_regex(spark, d):
    ev = apply_transforms(_json_events(spark, d), [Transform("remove", ".^(ts|user_|val)")])
    return ev.select("line_id", key_list().alias("keys"))


SQL_T5 = "SELECT event_id AS line_id, 'level,lvl,message,msg,props,raw,source,timestamp' AS keys FROM events"


def q_t6_path(spark, d):
    ev = _json_events(spark, d)
    return ev.select("line_id", vget("props.k", "bigint").alias("k"),
                     big(fields.present("props.k")).alias("has_k"), big(fields.present("props.z")).alias("has_z"))


SQL_T6 = f"""SELECT event_id AS line_id, CAST({K_SQL} AS BIGINT) AS k, CAST(1 AS BIGINT) AS has_k,
  CAST(0 AS BIGINT) AS has_z FROM events"""


def q_t7_path_write(spark, d):
    ev = apply_transforms(_json_events(spark, d), [
        Transform("set", "props.src", value="web"), Transform("add", "meta.env.name", value="prod"),
        Transform("remove", "props.k")])
    return ev.select("line_id", vget("props.src", "string").alias("src"),
                     vget("meta.env.name", "string").alias("env_name"),
                     big(fields.present("props.k")).alias("has_k"))


SQL_T7 = "SELECT event_id AS line_id, 'web' AS src, 'prod' AS env_name, CAST(0 AS BIGINT) AS has_k FROM events"


def q_t8_expr(spark, d):
    ev = apply_transforms(_json_events(spark, d), [
        Transform("set", "msg_len", expr="length(message)"), Transform("set", "level", expr="upper(level)")])
    return ev.select("line_id", vget("msg_len", "bigint").alias("msg_len"), "level")


SQL_T8 = f"SELECT event_id AS line_id, CAST(length(event_type) AS BIGINT) AS msg_len, upper({LEVEL_SQL}) AS level FROM events"

# ---------------------------------------------------------------- statistics and pipeline


def _mixed_plus_docs(spark, d, pipeline: PipelineSpec):
    ev_lines = lines_of(spark, d, "mixed")
    docs = doc_lines(spark, d).select("raw", "source", "file_path")
    return build_from_lines([(ev_lines, SourceSpec(path="events", name="events")),
                             (docs, SourceSpec(path="documents", name="documents", max_line_length=4096))],
                            pipeline)


A1_PIPELINE = PipelineSpec(parse="auto", min_level="warn", exclude_regex="purchase",
                           reference_year=REFERENCE_YEAR)


def q_a1_stats(spark, d):
    plan = _mixed_plus_docs(spark, d, A1_PIPELINE)
    return stats(plan.flagged)


_RANK_SQL = f"CASE event_id % 4 WHEN 0 THEN {LEVEL_RANK_SQL} WHEN 3 THEN 0 ELSE {SEV_RANK_SQL} END"
SQL_A1 = f"""WITH {DOC_LINES_SQL},
  ev AS (SELECT ({_RANK_SQL}) >= 3 AND event_type <> 'purchase' AS keep FROM events),
  docs AS (SELECT count(*) AS n, count(*) FILTER (WHERE strlen(raw) <= 4096) AS ok FROM dl WHERE raw <> '')
SELECT CAST((SELECT count(*) FROM ev) + (SELECT ok FROM docs) AS BIGINT) AS processed,
       CAST((SELECT count(*) FILTER (WHERE NOT keep) FROM ev) + (SELECT n FROM docs) AS BIGINT) AS dropped,
       CAST((SELECT count(*) FILTER (WHERE keep) FROM ev) AS BIGINT) AS kept"""


def q_a1_format_counts(spark, d):
    plan = build_from_lines([(lines_of(spark, d, "mixed"), None)], A1_PIPELINE)
    out = stats_by(plan.flagged, "format")
    return out.select("format", big("processed").alias("processed"), big("dropped").alias("dropped"),
                      big("kept").alias("kept"))


SQL_A1F = f"""WITH ev AS (SELECT CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'rfc3164'
      WHEN 2 THEN 'rfc5424' ELSE 'raw' END AS format,
    ({_RANK_SQL}) >= 3 AND event_type <> 'purchase' AS keep FROM events)
SELECT format, CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE NOT keep) AS BIGINT) AS dropped,
  CAST(count(*) FILTER (WHERE keep) AS BIGINT) AS kept FROM ev GROUP BY format"""


def q_a2_throughput(spark, d):
    pipeline = PipelineSpec(parse="auto", min_level="warn", reference_year=REFERENCE_YEAR)
    plan = build_from_lines([(lines_of(spark, d, "mixed"), None)], pipeline)
    out = throughput(plan.flagged, "30 seconds")
    return out.select("window_start", "source", big("processed").alias("processed"),
                      big("dropped").alias("dropped"), big("kept").alias("kept"))


_TS_EFF = "CASE event_id % 4 WHEN 1 THEN date_trunc('second', ts) WHEN 3 THEN NULL ELSE ts END"
SQL_A2 = f"""WITH e AS (SELECT {_TS_EFF} AS t, ({_RANK_SQL}) >= 3 AS keep FROM events),
  w AS (SELECT make_timestamp(CAST(epoch_us(t) // 30000000 * 30000000 AS BIGINT)) AS ws, keep FROM e WHERE t IS NOT NULL)
SELECT strftime(ws, '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, 'events' AS source,
  CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE NOT keep) AS BIGINT) AS dropped,
  CAST(count(*) FILTER (WHERE keep) AS BIGINT) AS kept FROM w GROUP BY ws"""


FLAGSHIP = PipelineSpec(
    parse="auto", min_level="warn", exclude_regex="signup", reference_year=REFERENCE_YEAR,
    transforms=(Transform("add", "service", value="api"), Transform("rename", "host", to="hostname"),
                Transform("remove", ".^props$")))


def q_c1_pipeline(spark, d):
    plan = build_from_lines([(lines_of(spark, d, "mixed"), None)], FLAGSHIP)
    ev = plan.events.filter(F.col("timestamp").isNotNull())
    win = F.window("timestamp", "30 seconds")
    out = ev.groupBy(win.alias("w"), "level", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sget("hostname").isNotNull()).alias("with_host"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("window_start"),
                      "level", "source", big("n").alias("n"), big("with_host").alias("with_host"))


_LEVEL_ANY_SQL = f"CASE event_id % 4 WHEN 0 THEN {LEVEL_SQL} ELSE {SEV_SQL} END"
SQL_C1 = f"""WITH e AS (SELECT {_TS_EFF} AS t, {_LEVEL_ANY_SQL} AS level, event_id % 4 AS kind FROM events
    WHERE ({_RANK_SQL}) >= 3 AND event_type <> 'signup'),
  w AS (SELECT make_timestamp(CAST(epoch_us(t) // 30000000 * 30000000 AS BIGINT)) AS ws, level, kind
        FROM e WHERE t IS NOT NULL)
SELECT strftime(ws, '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, level, 'events' AS source,
  CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE kind IN (1, 2)) AS BIGINT) AS with_host
FROM w GROUP BY ws, level"""

# ---------------------------------------------------------------- sinks


def q_o3_bulk(spark, d):
    payload = bulk_payload(_json_events(spark, d), "logs-%Y.%m.%d", keep=["line_id"])
    return payload.select("line_id", F.col("_index").alias("index"), "action", "doc")


_EVENT_RAW_SQL = f"""'{{"ts":"' || {ISO_US} || '","lvl":"' || {LEVEL_SQL} || '","msg":"' || event_type
  || '","user_id":' || {_USER} || ',"value":' || {V} || ',"props":' || props || '}}'"""
# everything between the opening brace and the closing one
_EVENT_BODY_SQL = f"""'"level":"' || {LEVEL_SQL} || '","lvl":"' || {LEVEL_SQL} || '","message":"' || event_type
  || '","msg":"' || event_type || '","props":{{"k":' || {K_SQL} || '}},"raw":' || {_JSON_STR(_EVENT_RAW_SQL)}
  || ',"source":"events","timestamp":"' || {ISO_US} || '","ts":"' || {ISO_US} || '","user_id":' || {_USER}
  || ',"value":' || regexp_replace({V}, '[.]0$', '') || '}}'"""

SQL_O3 = f"""SELECT event_id AS line_id, 'logs-' || strftime(ts, '%Y.%m.%d') AS index,
  '{{"index":{{"_index":"logs-' || strftime(ts, '%Y.%m.%d') || '"}}}}' AS action,
  '{{"@timestamp":"' || {ISO_US} || '",' || {_EVENT_BODY_SQL} AS doc FROM events"""


def q_o4_kafka(spark, d):
    return kafka_payload(parsed(spark, d, "alias_json", "auto"), "logs", keep=["line_id"])


SQL_O4 = f"""SELECT event_id AS line_id,
  CASE WHEN event_id % 2 = 0 THEN 'svc' || CAST(user_id % 7 AS VARCHAR)
       ELSE 's' || CAST(user_id % 3 AS VARCHAR) END AS key,
  'logs' AS topic, {_ALIAS_JSON_SQL} AS value FROM events"""


def q_o5_webhook(spark, d):
    batches = webhook_batches(_json_events(spark, d), 50, order_by=["line_id"], global_order=True)
    return batches.select(big("batch").alias("batch"), big("count").alias("count"),
                          F.col("_first.line_id").alias("first_id"), F.col("_last.line_id").alias("last_id"),
                          F.regexp_replace("body", r'"sent_at":"[^"]*"\}\z', "").alias("body"))


SQL_O5 = f"""WITH b AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS batch FROM events)
SELECT CAST(batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS count,
  min(event_id) AS first_id, max(event_id) AS last_id,
  '{{"count":' || CAST(count(*) AS VARCHAR) || ',"events":['
  || string_agg('{{' || {_EVENT_BODY_SQL}, ',' ORDER BY event_id) || '],' AS body
FROM b GROUP BY batch"""


# ---------------------------------------------------------------- sources, filters and counters on mixed inputs


def q_s6_label(spark, d):
    """Each row labelled with the basename of its own file, as it is and trimmed."""
    return (table(spark, d, "events").select(source_label(None).alias("label"), source_label(None, True).alias("clean"))
            .groupBy("label", "clean").agg(F.count(F.lit(1)).alias("n")))


SQL_S6 = """SELECT 'events.parquet' AS label, 'events.parquet' AS clean, CAST(count(*) AS BIGINT) AS n
FROM events HAVING count(*) > 0"""


def _two_sources(spark, d, **second):
    """JSON lines with their own format next to RFC 3164 lines under the pipeline's."""
    first = SourceSpec(path="json", name="json", parse="json")
    rest = SourceSpec(path="syslog", name="syslog", **second)
    return build_from_lines([(lines_of(spark, d, "json"), first), (lines_of(spark, d, "rfc3164"), rest)],
                            PipelineSpec(parse="syslog", reference_year=REFERENCE_YEAR))


def q_s8_source_parse(spark, d):
    return _two_sources(spark, d, parse="raw").events.select("line_id", "format", "level", "message")


SQL_S8 = f"""SELECT event_id AS line_id, 'json' AS format, {LEVEL_SQL} AS level, event_type AS message FROM events
UNION ALL SELECT event_id, 'raw', NULL, NULL FROM events"""


def q_s9_priority(spark, d):
    return _two_sources(spark, d, priority="warn").events.select("line_id", "format", "level")


SQL_S9 = f"""SELECT event_id AS line_id, 'json' AS format, {LEVEL_SQL} AS level FROM events
UNION ALL SELECT event_id, 'rfc3164', {SEV_SQL} FROM events WHERE ({SEV_RANK_SQL}) >= 3"""


def q_f1_posix(spark, d):
    """POSIX and Perl classes, literal brackets and folding, decided by RE2 on the other side."""
    pattern = POSIX_RE
    ev = apply_filter(parse(doc_lines(spark, d), "raw"), FilterSpec(include_regex=pattern))
    return ev.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("n_bytes"))


POSIX_RE = r"(?i)^[[:alpha:]é&&ü]+[^[:space:]]*\s+.*[.!;[]$"
SQL_F1_POSIX = f"""WITH {DOC_LINES_SQL}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(strlen(raw)) AS BIGINT) AS n_bytes
FROM dl WHERE raw <> '' AND regexp_matches(raw, '{POSIX_RE}') GROUP BY doc_id"""


def q_x1_timestamp_forms(spark, d):
    """Layouts over twelve months in the less usual forms: fractions, short hours, letter case, runs of blanks."""
    lines = event_lines(table(spark, d, "events"), "timestamp_forms")
    return lines.select("line_id", ts_text(parse_timestamp(F.col("raw"), REFERENCE_YEAR)).alias("ts"))


SQL_X1_FORMS = """WITH t AS (SELECT event_id, CAST(ts AS TIMESTAMP)
  + to_days(CAST(30 * (event_id % 12) AS INTEGER)) AS ts FROM events)
SELECT event_id AS line_id, strftime(CASE event_id % 7
    WHEN 0 THEN date_trunc('second', ts) + INTERVAL 250 MILLISECOND
    WHEN 1 THEN date_trunc('hour', ts) - hour(ts) * INTERVAL 1 HOUR + INTERVAL 5 HOUR
    WHEN 2 THEN date_trunc('second', ts) + INTERVAL 500 MILLISECOND
    WHEN 5 THEN date_trunc('second', ts) + INTERVAL 125 MILLISECOND
    ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM t"""


A2_LIMIT = 112  # bytes; some JSON lines and most document lines are longer


def q_a2_throughput_docs(spark, d):
    """Windows over mixed lines of which some exceed the length limit, and A1's totals beside them."""
    plan = build_from_lines(
        [(lines_of(spark, d, "mixed"), SourceSpec(path="mixed", max_line_length=A2_LIMIT)),
         (doc_lines(spark, d), SourceSpec(path="documents", max_line_length=A2_LIMIT))],
        PipelineSpec(parse="auto", exclude_regex="signup", reference_year=REFERENCE_YEAR))
    counts = [big(c).alias(c) for c in ("processed", "dropped", "kept")]
    windows = throughput(plan.flagged, "30 seconds").select("window_start", "source", *counts)
    totals = stats(plan.flagged).select(F.lit("all").alias("window_start"), F.lit("all").alias("source"), *counts)
    return windows.unionByName(totals)


SQL_A2_DOCS = f"""WITH {DOC_LINES_SQL},
  m AS (SELECT event_type = 'signup' AS excluded, {_TS_EFF} AS t,
               event_id % 4 = 0 AND strlen({_EVENT_RAW_SQL}) > {A2_LIMIT} AS over_long FROM events),
  w AS (SELECT make_timestamp(CAST(epoch_us(t) // 30000000 * 30000000 AS BIGINT)) AS ws, excluded
        FROM m WHERE t IS NOT NULL AND NOT over_long),
  a AS (SELECT excluded, over_long FROM m
        UNION ALL SELECT contains(raw, 'signup'), strlen(raw) > {A2_LIMIT} FROM dl WHERE raw <> '')
SELECT strftime(ws, '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, 'events' AS source,
  CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE excluded) AS BIGINT) AS dropped,
  CAST(count(*) FILTER (WHERE NOT excluded) AS BIGINT) AS kept FROM w GROUP BY ws
UNION ALL SELECT 'all', 'all', CAST(count(*) FILTER (WHERE NOT over_long) AS BIGINT),
  CAST(count(*) FILTER (WHERE over_long OR excluded) AS BIGINT),
  CAST(count(*) FILTER (WHERE NOT over_long AND NOT excluded) AS BIGINT) FROM a"""


# ---------------------------------------------------------------- registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "S4_normalise": q_s4_normalise, "S5_max_len": q_s5_max_len, "S7_fan_in": q_s7_fan_in,
    "P2_json": q_p2_json, "P3_alias": q_p3_alias, "P4_defaults": q_p4_defaults,
    "P6_rfc5424": q_p6_rfc5424, "P7_rfc3164": q_p7_rfc3164, "P7b_priority": q_p7b_priority,
    "P8_access": q_p8_access, "P8c_level": q_p8c_level, "P9_error": q_p9_error,
    "P11_auto": q_p11_auto, "P12_unparsed": q_p12_unparsed, "X1_timestamp": q_x1_timestamp,
    "X12_render": q_x12_render, "P7_rfc3164_re2": q_p7_rfc3164_re2,
    "P8_access_re2": q_p8_access_re2,
    "F1_include": q_f1_include, "F2_exclude": q_f2_exclude, "F3_min_level": q_f3_min_level,
    "F4_drop": q_f4_drop, "F5_expr": q_f5_expr,
    "T1_add": q_t1_add, "T3_rename": q_t3_rename, "T4_remove": q_t4_remove,
    "T5_remove_regex": q_t5_remove_regex, "T6_path": q_t6_path, "T7_path_write": q_t7_path_write,
    "T8_expr": q_t8_expr,
    "A1_stats": q_a1_stats, "A1_format_counts": q_a1_format_counts, "A2_throughput": q_a2_throughput,
    "O3_bulk": q_o3_bulk, "O4_kafka": q_o4_kafka, "O5_webhook": q_o5_webhook,
    "C1_pipeline": q_c1_pipeline, "X12_json": q_x12_json, "S6_label": q_s6_label,
    "S8_source_parse": q_s8_source_parse, "S9_priority": q_s9_priority, "F1_posix": q_f1_posix,
    "X1_timestamp_forms": q_x1_timestamp_forms, "A2_throughput_docs": q_a2_throughput_docs,
}

ORACLE_SQL: dict[str, str] = {
    "S4_normalise": SQL_S4, "S5_max_len": SQL_S5, "S7_fan_in": SQL_S7,
    "P2_json": SQL_P2, "P3_alias": SQL_P3, "P4_defaults": SQL_P4,
    "P6_rfc5424": SQL_P6, "P7_rfc3164": SQL_P7, "P7b_priority": SQL_P7B,
    "P8_access": SQL_P8, "P8c_level": SQL_P8C, "P9_error": SQL_P9,
    "P11_auto": SQL_P11, "P12_unparsed": SQL_P12, "X1_timestamp": SQL_X1, "X12_render": SQL_X12, "P7_rfc3164_re2": SQL_P7_RE2,
    "P8_access_re2": SQL_P8_RE2,
    "F1_include": SQL_F1, "F2_exclude": SQL_F2, "F3_min_level": SQL_F3,
    "F4_drop": SQL_F4, "F5_expr": SQL_F5,
    "T1_add": SQL_T1, "T3_rename": SQL_T3, "T4_remove": SQL_T4,
    "T5_remove_regex": SQL_T5, "T6_path": SQL_T6, "T7_path_write": SQL_T7, "T8_expr": SQL_T8,
    "A1_stats": SQL_A1, "A1_format_counts": SQL_A1F, "A2_throughput": SQL_A2,
    "O3_bulk": SQL_O3, "O4_kafka": SQL_O4, "O5_webhook": SQL_O5,
    "C1_pipeline": SQL_C1, "X12_json": SQL_X12_JSON, "S6_label": SQL_S6,
    "S8_source_parse": SQL_S8, "S9_priority": SQL_S9, "F1_posix": SQL_F1_POSIX,
    "X1_timestamp_forms": SQL_X1_FORMS, "A2_throughput_docs": SQL_A2_DOCS,
}
