"""S1-S7 file sources, O1-O8 sinks (fake transport: no port is opened)."""

import gzip
import json
import os

import pytest
from helpers import FakeTransport, lines_df

from logpipe.operators.parse import parse
from logpipe.operators.stats import stats
from logpipe.plans.pipeline import build, build_from_lines
from logpipe.plans.spec import JobSpec, PipelineSpec, SourceSpec
from logpipe.sinks import deliver
from logpipe.sinks.outputs import OutputSpec, build_sink, fan_out, write_file
from logpipe.sinks.payloads import bulk_lines, bulk_payload, kafka_payload, webhook_batches
from logpipe.sources.lines import fan_in, read_lines


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_read_lines_normalises_and_labels(spark, tmp_dir):
    # names starting with "_" or "." are hidden from Spark's file listing
    write(f"{tmp_dir}/logs/app.log._", b"one\r\ntwo\rthree\n\n\nfour\r\r\n")
    df = read_lines(spark, f"{tmp_dir}/logs")
    rows = df.collect()
    assert [r["raw"] for r in rows] == ["one", "two\rthree", "four"]
    assert {r["source"] for r in rows} == {"app.log._"}
    assert read_lines(spark, f"{tmp_dir}/logs", clean_name=True).first()["source"] == "app.log"
    assert read_lines(spark, f"{tmp_dir}/logs", "named").first()["source"] == "named"
    assert rows[0]["file_path"].endswith("app.log._")


def test_recursive_glob(spark, tmp_dir):
    write(f"{tmp_dir}/r/a.log", b"a\n")
    write(f"{tmp_dir}/r/sub/deeper/b.log", b"b\n")
    write(f"{tmp_dir}/r/sub/c.txt", b"c\n")
    df = read_lines(spark, f"{tmp_dir}/r", recursive=True, path_glob="*.log")
    assert sorted(r["raw"] for r in df.collect()) == ["a", "b"]


def test_too_long_lines_skipped_and_counted(spark, tmp_dir):
    ok, long_ = "x" * 65536, "y" * 65537
    write(f"{tmp_dir}/l/a.log", (ok + "\n" + long_ + "\nshort\n").encode())
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/l", name="l"),))
    plan = build(spark, job)
    assert sorted(len(r["raw"]) for r in plan.events.select("raw").collect()) == [5, 65536]
    s = stats(plan.flagged).first()
    assert (s["processed"], s["dropped"], s["kept"]) == (2, 1, 2)


def test_invalid_utf8_line_is_kept(spark, tmp_dir):
    write(f"{tmp_dir}/u/a.log", b"ok\nbad \xff\xfe bytes\n")
    rows = read_lines(spark, f"{tmp_dir}/u").collect()
    assert len(rows) == 2


def test_per_source_parse_and_priority(spark, tmp_dir):
    write(f"{tmp_dir}/s1/a.log", b'{"msg":"j","lvl":"debug"}\n{"msg":"k","lvl":"error"}\n')
    write(f"{tmp_dir}/s2/b.log", b"<11>Feb  3 01:02:03 h p: e\n<15>Feb  3 01:02:03 h p: d\n")
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/s1", name="app", parse="json", priority="error"),
                           SourceSpec(path=f"{tmp_dir}/s2", name="sys", parse="syslog")),
                  pipeline=PipelineSpec(parse="raw", reference_year=2026))
    rows = build(spark, job).events.select("source", "format", "message").collect()
    assert sorted(tuple(r) for r in rows) == [("app", "json", "k"), ("sys", "rfc3164", "d"),
                                             ("sys", "rfc3164", "e")]


def test_fan_in_union_by_name(spark):
    a = lines_df(spark, ["x"], "a")
    b = lines_df(spark, ["y"], "b").select("raw", "source")
    assert sorted(r["source"] for r in fan_in([a, b]).collect()) == ["a", "b"]


@pytest.fixture
def events(spark):
    lines = ['{"msg":"m%d","lvl":"warn","ts":"2026-04-2%dT12:00:00Z"}' % (i, i % 3) for i in range(120)]
    return parse(lines_df(spark, lines, "svc"), "json")


def test_file_sink_gzip_round_trip(spark, events, tmp_dir):
    out = f"{tmp_dir}/out"
    write_file(events, OutputSpec(type="file", url=out, compress=True, max_records_per_file=50))
    files = [f for f in os.listdir(out) if f.endswith(".gz")]
    assert files
    lines = []
    for f in files:
        with gzip.open(os.path.join(out, f), "rt") as fh:
            lines += fh.read().splitlines()
    assert len(lines) == 120 and all(json.loads(line)["lvl"] == "warn" for line in lines)


def test_bulk_payload_index_and_timestamp(spark, events):
    p = bulk_payload(events, "logs-%Y.%m.%d", keep=["line_id"])
    r = p.filter("line_id = 1").first()
    assert r["_index"] == "logs-2026.04.21"
    assert json.loads(r["action"]) == {"index": {"_index": "logs-2026.04.21"}}
    assert json.loads(r["doc"])["@timestamp"] == "2026-04-21T12:00:00.000000Z"
    assert bulk_lines(p).count() == 240
    assert bulk_payload(events, None).first()["_index"] == "logs"


def test_kafka_payload(spark, events):
    r = kafka_payload(events).first()
    assert (r["key"], r["topic"]) == ("svc", "logs")
    assert json.loads(r["value"])["source"] == "svc"


def test_webhook_batches_cover_every_event_once(spark, events):
    b = webhook_batches(events, 50, order_by=["line_id"], buckets=3)
    rows = b.collect()
    assert sum(r["count"] for r in rows) == 120
    assert max(r["count"] for r in rows) <= 50
    ids = []
    for r in rows:
        env = json.loads(r["body"])
        assert env["count"] == len(env["events"]) == r["count"]
        ids += [e["msg"] for e in env["events"]]
    assert sorted(ids) == sorted(f"m{i}" for i in range(120))


def test_webhook_delivery_batches_and_retries(spark, events, tmp_dir):
    sleeps = []
    t = FakeTransport(f"{tmp_dir}/wh", fail_first=0)
    r = deliver.deliver_webhook(events.coalesce(1), "http://x", {"X-App": "t"}, 50, 3, t, sleeps.append)
    assert (r["events"], r["requests"], r["failed_requests"]) == (120, 3, 0)
    sizes = sorted(json.loads(open(os.path.join(t.folder, f)).read())["count"] for f in os.listdir(t.folder))
    assert sizes == [20, 50, 50]


def test_send_with_retry_backoff_and_give_up():
    calls, sleeps = [], []

    def always_500(method, url, body, headers, timeout):
        calls.append(url)
        return 500, "err"

    ok, attempts, err, _ = deliver.send_with_retry(always_500, "u", b"{}", {}, 3, sleep=sleeps.append)
    assert not ok and attempts == 4 and sleeps == [2.0, 4.0, 8.0] and "HTTP 500" in err

    seq = iter([RuntimeError("down"), (200, "")])

    def flaky(method, url, body, headers, timeout):
        x = next(seq)
        if isinstance(x, Exception):
            raise x
        return x

    ok, attempts, err, _ = deliver.send_with_retry(flaky, "u", b"{}", {}, 3, sleep=lambda s: None)
    assert ok and attempts == 2


def test_bulk_item_errors_count_as_failure(spark, events, tmp_dir):
    reply = json.dumps({"errors": True, "items": [{"index": {"error": {"type": "x"}}}]})
    t = FakeTransport(f"{tmp_dir}/es", reply=reply)
    r = deliver.deliver_bulk(events.coalesce(1), "http://es", "logs-%Y", "u", "p", 1000, 1, t, lambda s: None)
    assert r["failed_requests"] == 1 and r["events"] == 120
    bodies = [open(os.path.join(t.folder, f)).read() for f in os.listdir(t.folder)]
    assert bodies[0].count("\n") == 240


def test_fan_out_survives_a_failing_sink(spark, events, tmp_dir):
    seen = []

    def broken(df, batch_id=None):
        raise RuntimeError("sink down")

    def counting(df, batch_id=None):
        seen.append(df.count())
        return 0

    assert fan_out(events, [broken, counting], 0, on_error="count") == 1
    assert seen == [120]
    with pytest.raises(RuntimeError):
        fan_out(events, [broken, counting], 1, on_error="raise")
    assert seen == [120, 120]


def test_unknown_output_type(spark):
    with pytest.raises(ValueError, match="unknown type"):
        build_sink(OutputSpec(type="carrier-pigeon"))


def test_pipeline_plan_has_no_shuffle(spark):
    plan = build_from_lines([(lines_df(spark, ["x"]), None)],
                            PipelineSpec(min_level="warn", exclude_regex="x"))
    text = plan.events._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_console_payload_is_indented_json(spark, events, capsys):
    from logpipe.sinks.outputs import write_console
    from logpipe.sinks.payloads import console_payload
    text = console_payload(events).first()["value"]
    assert "\n" in text and json.loads(text)["lvl"] == "warn"
    write_console(events, OutputSpec(type="stdout"))
    assert capsys.readouterr().out.count('"lvl"') == 120
