"""Deviation ledger: the intended behaviour we build instead of a defect.

Rows tested elsewhere: V1/V2/V3/V25 ``test_parse_golden``; V5/V6/V8/V9/V10
``test_filters_transforms``; V7/V11/V15/V20 ``test_sources_sinks``; V14
``test_streaming``; V16 ``test_spec_functions``; V19/V22 ``test_sources_sinks``;
V29 ``test_spec_functions::test_from_dict_reference_keys``.
"""

import json
from datetime import datetime

from helpers import FakeTransport, events_as_dicts, lines_df
from pyspark.sql import functions as F

from logpipe.operators.filters import FilterSpec, apply_filter
from logpipe.operators.parse import parse
from logpipe.plans.pipeline import build_from_lines
from logpipe.plans.spec import PipelineSpec
from logpipe.sinks import deliver
from logpipe.sinks.payloads import bulk_payload


def test_v4_access_offset_is_honoured(spark):
    r = parse(lines_df(spark, ['h - - [26/Apr/2026:23:30:00 -0230] "GET / HTTP/1.1" 200 5 "-" "a"']),
              "nginx").first()
    assert r["timestamp"] == datetime(2026, 4, 27, 2, 0, 0)


def test_v12_length_limit_applies_to_any_lines_table(spark):
    plan = build_from_lines([(lines_df(spark, ["x" * 70000, "ok"]), None)], PipelineSpec())
    assert [r["raw"] for r in plan.events.collect()] == ["ok"]


def test_v17_index_from_event_time_and_strftime(spark):
    ev = parse(lines_df(spark, ['{"msg":"a","ts":"2020-02-03T04:05:06Z"}', '{"msg":"b"}']), "json")
    rows = {r["line_id"]: r["_index"] for r in bulk_payload(ev, "logs-%Y%m%d", keep=["line_id"]).collect()}
    assert rows[0] == "logs-20200203"
    assert rows[1] == "logs-" + datetime.utcnow().strftime("%Y%m%d")  # no event time: processing time


def test_v18_bulk_requests_close_at_buffer_size(spark, tmp_dir):
    ev = parse(lines_df(spark, ['{"msg":"m%d"}' % i for i in range(120)]), "json").coalesce(1)
    t = FakeTransport(f"{tmp_dir}/bulk")
    r = deliver.deliver_bulk(ev, "http://es", None, None, None, 50, 0, t, lambda s: None)
    assert (r["requests"], r["events"]) == (3, 120)


def test_v23_json_timestamp_is_parsed_and_original_kept(spark):
    ev = parse(lines_df(spark, ['{"time":"2026-04-26T12:00:00+02:00","msg":"x"}']), "json")
    r = ev.first()
    assert r["timestamp"] == datetime(2026, 4, 26, 10, 0, 0)
    doc = json.loads(bulk_payload(ev).first()["doc"])
    assert doc["time"] == "2026-04-26T12:00:00+02:00" and doc["@timestamp"] == "2026-04-26T10:00:00.000000Z"


def test_v24_filter_level_table_is_authoritative(spark):
    ev = parse(lines_df(spark, ['{"level":"panic"}', '{"level":"alert"}', '{"level":"fatal"}',
                                '{"level":"unknown"}']), "json")
    kept = sorted(r["line_id"] for r in apply_filter(ev, FilterSpec(min_level="emergency")).collect())
    assert kept == [0, 1]  # panic and alert rank 6, fatal 5, unknown 0


def test_v26_auto_does_not_try_web_logs(spark):
    line = '10.0.0.1 - - [26/Apr/2026:12:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "-"'
    r = parse(lines_df(spark, [line]), "auto").first()
    assert r["format"] == "raw" and r["message"] == line


def test_v27_json_numbers_stay_exact(spark):
    ev = parse(lines_df(spark, ['{"big":12345678901234567890,"dec":0.1000000000000000055511151231257827}']),
               "json")
    d = events_as_dicts(ev)[0]
    assert d["big"] == 12345678901234567890
    text = ev.select(F.to_json(F.col("attrs")["dec"])).first()[0]
    assert text.startswith("0.1000000000000000055")
