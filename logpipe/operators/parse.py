"""The format router, raw pass-through and auto detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpipe.operators.parse_json import json_plan
from logpipe.operators.parse_nginx import nginx_plan
from logpipe.operators.parse_syslog import syslog_parts, syslog_plan
from logpipe.operators.plan import ParsePlan, choose, merge_stages, run, unparsed_values
from logpipe.schema import FORMAT, LINE_RAW, LINE_SOURCE
from logpipe.session import configure

PARSE_MODES = ("json", "syslog", "nginx", "raw", "auto")


def parse_mode(fmt: str | None) -> str:
    """Normalised mode; anything unknown means ``auto``."""
    f = (fmt or "").lower()
    return f if f in PARSE_MODES else "auto"


_PLANS: dict[tuple, ParsePlan] = {}


def cached_plan(spark, fmt: str | None, implied_year=None, tz: str = "UTC") -> ParsePlan:
    """``plan_for`` built once per driver JVM: its Columns are immutable and reusable,
    and building one costs hundreds of driver-to-JVM calls."""
    try:
        jvm_id = spark.sparkContext.applicationId
    except Exception:
        return plan_for(fmt, implied_year, tz)
    year = implied_year if not isinstance(implied_year, Column) else None
    if implied_year is not None and year is None:
        return plan_for(fmt, implied_year, tz)
    key = (jvm_id, parse_mode(fmt), year, tz)
    plan = _PLANS.get(key)
    if plan is None:
        plan = _PLANS[key] = plan_for(fmt, implied_year, tz)
    return plan


def plan_for(fmt: str | None, implied_year=None, tz: str = "UTC") -> ParsePlan:
    mode = parse_mode(fmt)
    if mode == "json":
        p = json_plan(strict_first_byte=False, implied_year=implied_year)
        return ParsePlan(p.stages, p.ok, choose([(p.ok, p.values)], unparsed_values()))
    if mode == "syslog":
        return syslog_plan(implied_year, tz)
    if mode == "nginx":
        return nginx_plan()
    if mode == "raw":
        # P10: only raw and source, no message.
        return ParsePlan(values={"raw": LINE_RAW, "source": LINE_SOURCE, FORMAT: F.lit("raw")})
    # P11: "{" -> JSON; else syslog; else the line itself is the message.
    j = json_plan(strict_first_byte=True, implied_year=implied_year)
    s_stages, s_branches = syslog_parts(implied_year, tz)
    fallback = {"raw": LINE_RAW, "source": LINE_SOURCE, "message": F.col(LINE_RAW),
                FORMAT: F.lit("raw")}
    values = choose([(j.ok, j.values)] + s_branches, fallback)
    return ParsePlan(stages=merge_stages([j, ParsePlan(stages=s_stages)]), ok=None, values=values)


def parse(lines: DataFrame, fmt: str | None = "auto", *, implied_year=None, tz: str = "UTC") -> DataFrame:
    """Line table -> event table (``logpipe.schema``); extra input columns are carried."""
    configure(lines.sparkSession)
    if LINE_SOURCE not in lines.columns:
        lines = lines.withColumn(LINE_SOURCE, F.lit(None).cast("string"))
    return run(lines, cached_plan(lines.sparkSession, fmt, implied_year, tz))
