"""C2 spec validation, X1-X15 scalar functions, deviation-ledger cases not covered elsewhere."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logpipe.functions.encode import index_name, strftime_to_datetime_pattern
from logpipe.functions.levels import facility_code, level_name, severity_code, threshold_rank
from logpipe.functions.regexes import re2_to_java
from logpipe.functions.timestamps import access_log_time, error_log_time, parse_timestamp, rfc3164_time
from logpipe.plans.spec import JobSpec, OutputSpec, SourceSpec, from_dict


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [
    ("2026-04-26T12:00:00Z", datetime(2026, 4, 26, 12)),
    ("2026-04-26T12:00:00.123456789+02:00", datetime(2026, 4, 26, 10, 0, 0, 123456)),
    ("Sun, 26 Apr 2026 12:00:00 +0700", datetime(2026, 4, 26, 5)),
    ("Sun, 26 Apr 2026 12:00:00 GMT", datetime(2026, 4, 26, 12)),
    ("26 Apr 26 12:00 -0100", datetime(2026, 4, 26, 13)),
    ("26 Apr 99 12:00 UTC", datetime(1999, 4, 26, 12)),
    ("2026-04-26 12:00:00.250", datetime(2026, 4, 26, 12, 0, 0, 250000)),
    ("2026-04-26 12:00:00", datetime(2026, 4, 26, 12)),
    ("Apr  6 12:00:00", datetime(2024, 4, 6, 12)),
    ("2026/04/26 12:00:00", datetime(2026, 4, 26, 12)),
    ("Mon, 01 Jan 2024 00:00:00.5 GMT", datetime(2024, 1, 1, 0, 0, 0, 500000)),
    ("2024-01-01 5:04:05", datetime(2024, 1, 1, 5, 4, 5)),
    ("jan  1 05:04:05", datetime(2024, 1, 1, 5, 4, 5)),
    ("Jan  1 05:04:05.250", datetime(2024, 1, 1, 5, 4, 5, 250000)),
    ("2024/01/01  05:04:05", datetime(2024, 1, 1, 5, 4, 5)),
    ("2024-01-01T00:00:00,5Z", datetime(2024, 1, 1, 0, 0, 0, 500000)),
    ("2024-01-01T00:00:00Z\n", None),
    ("2026", None), ("12:30", None), ("2026-04-26T12:00:00", None), ("2026-02-30T00:00:00Z", None),
])
def test_parse_timestamp_layouts(spark, text, expected):
    assert one(spark, parse_timestamp(F.lit(text), 2024)) == expected


def test_rfc3164_time_year_zone_and_invalid(spark):
    assert one(spark, rfc3164_time(F.lit("Feb  3 01:02:03"), 2024)) == datetime(2024, 2, 3, 1, 2, 3)
    assert one(spark, rfc3164_time(F.lit("Feb 29 01:02:03"), 2023)) is None
    assert one(spark, rfc3164_time(F.lit("feb 3 01:02:03"), 2024)) is None  # month names are case-sensitive
    assert one(spark, rfc3164_time(F.lit("Feb  3 01:02:03"), 2024, "America/New_York")) == \
        datetime(2024, 2, 3, 6, 2, 3)


def test_web_log_times(spark):
    assert one(spark, access_log_time(F.lit("26/Apr/2026:12:00:00 +0700"))) == datetime(2026, 4, 26, 5)
    assert one(spark, access_log_time(F.lit("26/Apr/2026:12:00:00"))) == datetime(2026, 4, 26, 12)
    assert one(spark, access_log_time(F.lit("2026-04-26T12:00:00Z"))) == datetime(2026, 4, 26, 12)
    assert one(spark, error_log_time(F.lit("2026/04/26 12:00:00"))) == datetime(2026, 4, 26, 12)
    # a run of blanks stands for one, as in the layout rules
    assert one(spark, error_log_time(F.lit("2026/04/26  12:00:00"))) == datetime(2026, 4, 26, 12)


def test_numbers_beyond_32_bits(spark):
    from helpers import lines_df
    from logpipe.operators.parse import parse
    pri = parse(lines_df(spark, ["<99999999999>Feb  3 01:02:03 h p: x"]), "syslog", implied_year=2024).first()
    assert (pri["severity"], pri["level"], pri["facility"]) == (7, "debug", 12499999999)
    line = '1.1.1.1 - - [26/Apr/2026:12:00:00 +0000] "GET / HTTP/1.1" 99999999999 1 "-" "a"'
    assert parse(lines_df(spark, [line]), "nginx").first()["level"] == "error"


def test_level_tables(spark):
    assert threshold_rank("WARNING") == 3 and threshold_rank("") == 0 and threshold_rank("x") == 0
    assert one(spark, level_name(F.lit(6))) == "emergency"
    assert one(spark, severity_code(F.lit("Warning"))) == 4
    assert one(spark, facility_code(F.lit("local7"))) == 23


def test_index_pattern_translation(spark):
    assert strftime_to_datetime_pattern("logs-%Y.%m.%d") == "'logs-'yyyy'.'MM'.'dd"
    assert strftime_to_datetime_pattern("it's-%H%%") == "'it''s-'HH'%'"
    ts = F.lit(datetime(2026, 4, 26, 12)).cast("timestamp")
    assert one(spark, index_name("logs-%Y%m%d", ts)) == "logs-20260426"
    assert one(spark, index_name("", ts)) == "logs"
    assert one(spark, index_name("static", ts)) == "static"
    with pytest.raises(ValueError):
        strftime_to_datetime_pattern("%Q")


def test_re2_translation():
    assert re2_to_java("(?P<user_agent>x)") == "(?d)(?<g1xuseragent>x)"
    assert re2_to_java("[[:alpha:]]+") == "(?d)[\\p{Alpha}]+"
    with pytest.raises(ValueError):
        re2_to_java("(?U)a+")


def test_job_validation():
    with pytest.raises(ValueError, match="needs a path"):
        JobSpec(sources=(SourceSpec(path=""),)).validate()
    with pytest.raises(ValueError, match="two sources"):
        JobSpec(sources=(SourceSpec("a", "x"), SourceSpec("b", "x"))).validate()
    with pytest.raises(ValueError, match="needs an output"):
        JobSpec(outputs=()).validate()
    with pytest.raises(ValueError, match="unknown type"):
        JobSpec(outputs=(OutputSpec(type="ftp"),)).validate()
    with pytest.raises(ValueError, match="needs a url"):
        JobSpec(outputs=(OutputSpec(type="file"),)).validate()
    assert JobSpec().validate().outputs[0].type == "stdout"


def test_from_dict_reference_keys():
    job = from_dict({
        "sources": [{"path": "/var/log/app", "name": "app", "parse": "json", "maxLineLength": 100,
                     "priority": "info"}],
        "pipeline": {"parse": "WEIRD", "minLevel": "info", "excludeRegex": "healthcheck|pulse",
                     "drop": {"field": "level", "value": "debug"},
                     "transforms": [{"action": "add", "field": "service", "value": "myapp"},
                                    {"action": "remove", "field": ".env"}]},
        "outputs": [{"type": "webhook", "url": "https://x", "batchSize": 10, "retryMax": 2,
                     "headers": {"X-App-Name": "t"}}],
    }).validate()
    assert job.sources[0].max_line_length == 100 and job.sources[0].priority == "info"
    assert job.pipeline.parse == "auto" and job.pipeline.drop.value == "debug"
    assert job.pipeline.transforms[1].field == ".env"
    assert job.outputs[0].batch_size == 10 and job.outputs[0].headers == {"X-App-Name": "t"}


def test_looks_like_json_and_batch_observation(spark):
    from logpipe.functions.scalars import looks_like_json
    from logpipe.operators.stats import observe
    from logpipe.plans.pipeline import build_from_lines
    from logpipe.plans.spec import PipelineSpec
    from helpers import lines_df
    assert one(spark, looks_like_json(F.lit('  {"a":1}'))) is True
    assert one(spark, looks_like_json(F.lit("[1]"))) is False
    plan = build_from_lines([(lines_df(spark, ['{"lvl":"error"}', '{"lvl":"info"}', "x" * 70000]), None)],
                            PipelineSpec(min_level="warn"))
    observed, obs = observe(plan.flagged)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == {"processed": 2, "dropped": 2}
