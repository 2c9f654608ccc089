"""Nothing is lost, repeated or left uncounted on the way to the outputs."""

import json
import os

import pytest
from helpers import FakeTransport, lines_df

from logpipe.operators.parse import parse
from logpipe.plans.pipeline import build_from_lines
from logpipe.plans.spec import JobSpec, OutputSpec, PipelineSpec, SourceSpec, from_dict
from logpipe.operators.stats import stats, throughput
from logpipe.sinks import deliver
from logpipe.sinks.outputs import DeliveryError, build_sink, fan_out, write_file
from logpipe.sinks.payloads import ENVELOPE, envelope_text, webhook_batches
from logpipe.sources.lines import read_lines, split_glob
from logpipe.streaming.stream import finish, start_pipeline


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w") as f:
        f.write(text)
    os.rename(path + ".tmp", path)


def json_lines(n, start=0):
    return "".join('{"msg":"m%d","lvl":"warn"}\n' % i for i in range(start, start + n))


@pytest.fixture
def five(spark):
    return parse(lines_df(spark, json_lines(5).splitlines(), "svc"), "json")


def text_lines(folder):
    out = []
    for root, _, files in os.walk(folder):
        for f in files:
            if f.startswith("part-"):
                with open(os.path.join(root, f)) as fh:
                    out += fh.read().splitlines()
    return out


def test_console_prints_and_counts_every_event_of_a_stream(spark, tmp_dir, capsys):
    write(f"{tmp_dir}/in/a.log", json_lines(800))
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app"),), pipeline=PipelineSpec(parse="json"))
    q, counters = start_pipeline(spark, job, f"{tmp_dir}/ckpt", available_now=True)
    finish(q, counters)
    assert q.exception() is None
    assert capsys.readouterr().out.count('"lvl"') == 800
    assert (counters.processed, counters.dropped) == (800, 0)


def test_totals_cover_more_batches_than_spark_remembers(spark, tmp_dir):
    for i in range(8):
        write(f"{tmp_dir}/in/{i}.log", json_lines(10, 10 * i))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app"),), pipeline=PipelineSpec(parse="json"),
                      outputs=(OutputSpec(type="file", url=f"{tmp_dir}/out"),))
        q, counters = start_pipeline(spark, job, f"{tmp_dir}/ckpt", available_now=True, max_files_per_trigger=1)
        finish(q, counters)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert len(counters.batches) == 8 and counters.processed == 80
    assert len(text_lines(f"{tmp_dir}/out")) == 80


def test_finish_with_a_timeout_reads_what_waits(spark, tmp_dir):
    write(f"{tmp_dir}/in/a.log", json_lines(10))
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app"),), pipeline=PipelineSpec(parse="json"),
                  outputs=(OutputSpec(type="file", url=f"{tmp_dir}/out", flush_interval="100 ms"),))
    q, counters = start_pipeline(spark, job, f"{tmp_dir}/ckpt")
    finish(q, counters, timeout=60)
    assert counters.processed == 10 and len(text_lines(f"{tmp_dir}/out")) == 10


def test_failed_requests_raise_after_all_sinks_ran(spark, five, tmp_dir):
    hook = OutputSpec(type="webhook", url="http://x", retry_max=1)
    bad = build_sink(hook, FakeTransport(f"{tmp_dir}/wh", fail_first=10 ** 6), lambda s: None)
    seen = []
    with pytest.raises(DeliveryError):
        fan_out(five.coalesce(1), [bad, lambda df, b=None: seen.append(df.count())], 3)
    assert seen == [5]
    assert fan_out(five.coalesce(1), [bad], 3, on_error="count") == 1


def test_replayed_batch_is_written_once(spark, five, tmp_dir):
    out = OutputSpec(type="file", url=f"{tmp_dir}/out")
    for _ in range(2):
        write_file(five, out, 7)
    assert len(text_lines(f"{tmp_dir}/out")) == 5
    write_file(five, out, 8)
    assert len(text_lines(f"{tmp_dir}/out")) == 10
    assert spark.read.text(f"{tmp_dir}/out").where("batch_id = 8").count() == 5


def test_files_roll_by_bytes(spark, tmp_dir):
    events = parse(lines_df(spark, json_lines(40).splitlines(), "svc").coalesce(1), "json")
    size = max(len(x) + 1 for x in [r["value"] for r in _rendered(events)])
    write_file(events, OutputSpec(type="file", url=f"{tmp_dir}/out", max_bytes_per_file=3 * size))
    sizes = [os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(f"{tmp_dir}/out") for f in fs
             if f.startswith("part-")]
    assert len(sizes) >= 13 and max(sizes) <= 3 * size and len(text_lines(f"{tmp_dir}/out")) == 40


def _rendered(events):
    from logpipe.sinks.payloads import jsonl_payload
    return jsonl_payload(events).collect()


class Replies:
    """Answers bulk posts from a list and keeps the bodies."""

    def __init__(self, *replies):
        self.replies, self.bodies = list(replies), []

    def __call__(self, method, url, body, headers, timeout):
        self.bodies.append(body.decode())
        return 200, self.replies.pop(0)


def bulk_reply(*statuses):
    return json.dumps({"errors": any(s >= 400 for s in statuses), "items": [
        {"index": {"status": s} | ({"error": {"type": "e"}} if s >= 400 else {})} for s in statuses]})


def test_bulk_posts_only_items_that_may_yet_succeed():
    items = [f"{i}\n" for i in range(5)]
    once = Replies(bulk_reply(201, 201, 400, 201, 201))
    assert deliver.send_bulk(items, once, "u", {}, 3, sleep=lambda s: None)[:2] == (1, 1)
    assert len(once.bodies) == 1
    busy = Replies(bulk_reply(201, 429, 400, 503, 201), bulk_reply(201, 503), bulk_reply(201))
    assert deliver.send_bulk(items, busy, "u", {}, 3, sleep=lambda s: None)[:2] == (3, 1)
    assert busy.bodies == ["0\n1\n2\n3\n4\n", "1\n3\n", "3\n"]
    never = Replies(*[bulk_reply(503, 503)] * 2)
    assert deliver.send_bulk(items[:2], never, "u", {}, 1, sleep=lambda s: None)[:2] == (2, 2)


def test_permanent_item_error_counts_one_event(spark, five, tmp_dir):
    t = FakeTransport(f"{tmp_dir}/es", reply=bulk_reply(201, 201, 400, 201, 201))
    r = deliver.deliver_bulk(five.coalesce(1), "http://es", "logs", None, None, 1000, 3, t, lambda s: None)
    assert (r["events"], r["failed_events"], r["failed_requests"]) == (5, 1, 1)
    assert len(os.listdir(t.folder)) == 1


def test_table_and_sink_share_one_envelope(spark, five):
    row = webhook_batches(five, 50, order_by=["line_id"], global_order=True).first()
    events = [r["value"] for r in _rendered(five.orderBy("line_id"))]
    stamp = json.loads(row["body"])["sent_at"]
    assert row["body"] == envelope_text(events, stamp) and ENVELOPE[0] == '{"count":'


def test_global_batches_need_no_more_expressions_for_more_ranges(spark, five):
    a, b = (webhook_batches(five, 2, order_by=["line_id"], buckets=n, global_order=True) for n in (3, 200))
    pick = ("batch", "count", "_first", "_last")
    assert sorted(a.select(*pick).collect()) == sorted(b.select(*pick).collect())


def test_a1_and_a2_agree_when_lines_are_too_long(spark):
    long = '{"ts":"2024-01-01T00:00:00Z","msg":"%s"}' % ("x" * 200)
    short = '{"ts":"2024-01-01T00:00:01Z","msg":"y"}'
    plan = build_from_lines([(lines_df(spark, [long, short]), SourceSpec(path="p", max_line_length=100))],
                            PipelineSpec(parse="json"))
    a1, a2 = stats(plan.flagged).first(), throughput(plan.flagged).first()
    assert a1["processed"] == a2["processed"] == 1 and a1["dropped"] == 1
    assert plan.flagged.where("_too_long").first()["message"] is None


def test_double_star_reaches_every_depth(spark, tmp_dir):
    for path in ("a.log", "x/b.log", "x/y/c.log", "x/y/d.txt", "z/e.log"):
        write(f"{tmp_dir}/d/{path}", path + "\n")

    def read(glob):
        return sorted(r["raw"] for r in read_lines(spark, f"{tmp_dir}/d/{glob}").collect())

    assert read("**/*.log") == ["a.log", "x/b.log", "x/y/c.log", "z/e.log"]
    assert read("**") == ["a.log", "x/b.log", "x/y/c.log", "x/y/d.txt", "z/e.log"]
    assert read("**/y/*.{log,txt}") == ["x/y/c.log", "x/y/d.txt"]
    assert split_glob("/var/log/*.log") == ("/var/log/*.log", None, None)


def test_unsupported_keys_raise():
    with pytest.raises(ValueError, match="maxBackups"):
        from_dict({"outputs": [{"type": "file", "url": "x", "maxSize": 10, "maxBackups": 5}]})
    with pytest.raises(ValueError, match="sauce"):
        from_dict({"sources": [{"path": "x", "sauce": 1}]})
    assert from_dict({"outputs": [{"type": "file", "url": "x", "maxSize": 10}]}).outputs[0].max_bytes_per_file == 10
