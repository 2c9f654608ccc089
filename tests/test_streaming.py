"""S3, O6, O7, A1/A2 on Structured Streaming: batch = stream, restart, counters."""

import json
import os

from logpipe.operators.stats import stats
from logpipe.plans.pipeline import build
from logpipe.plans.spec import JobSpec, OutputSpec, PipelineSpec, SourceSpec
from logpipe.streaming.stream import finish, flush_trigger, interval_ms, start_pipeline, start_throughput

JSON_A = "\n".join('{"msg":"a%d","lvl":"%s","ts":"2026-04-26T12:00:%02dZ"}' % (i, "warn" if i % 2 else "info", i)
                   for i in range(20)) + "\n"
SYSLOG_B = "\n".join("<%d>Apr 26 12:01:%02d h app[%d]: b%d" % (8 + i % 8, i, i, i) for i in range(10)) + "\n"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = path + ".tmp"
    with open(tmp, "w") as f:
        f.write(text)
    os.rename(tmp, path)  # land files atomically, as a log shipper would


def read_jsonl(folder):
    out = []
    for root, _, files in os.walk(folder):
        for f in files:
            if f.startswith("part-") and not f.endswith(".crc"):
                with open(os.path.join(root, f)) as fh:
                    out += [json.loads(x) for x in fh if x.strip()]
    return out


def job_for(src_dir, out_dir):
    return JobSpec(sources=(SourceSpec(path=src_dir, name="app"),),
                   pipeline=PipelineSpec(parse="auto", min_level="warn", reference_year=2026),
                   outputs=(OutputSpec(type="file", url=out_dir),))


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_dir):
    src, out, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    write(f"{src}/a.log", JSON_A)
    write(f"{src}/b.log", SYSLOG_B)
    job = job_for(src, out)

    q, counters = start_pipeline(spark, job, ckpt, available_now=True)
    finish(q, counters)
    streamed = sorted(d["raw"] for d in read_jsonl(out))
    batch_plan = build(spark, job)
    batch = sorted(r["raw"] for r in batch_plan.events.select("raw").collect())
    assert streamed == batch and len(batch) > 0
    s = stats(batch_plan.flagged).first()
    assert (counters.processed, counters.dropped) == (s["processed"], s["dropped"]) == (30, 30 - len(batch))

    # restart on the same checkpoint: nothing new
    q, c2 = start_pipeline(spark, job, ckpt, available_now=True)
    finish(q, c2)
    assert len(read_jsonl(out)) == len(batch)

    # a file landing later is read from its first line
    write(f"{src}/c.log", '{"msg":"late","lvl":"error"}\n')
    q, c3 = start_pipeline(spark, job, ckpt, available_now=True)
    finish(q, c3)
    assert sorted(d.get("msg") for d in read_jsonl(out) if d.get("msg") == "late") == ["late"]
    assert c3.processed == 1


def test_throughput_stream_emits_closed_windows(spark, tmp_dir):
    src = f"{tmp_dir}/tin"
    early = "\n".join('{"msg":"a%d","lvl":"warn","ts":"2026-04-26T12:00:%02dZ"}' % (i, 2 * i)
                      for i in range(20))
    # an event an hour later moves the watermark past the two early windows
    write(f"{src}/a.log", early + '\n{"msg":"later","lvl":"warn","ts":"2026-04-26T13:00:00Z"}\n')
    job = JobSpec(sources=(SourceSpec(path=src, name="app"),), pipeline=PipelineSpec(parse="json"))
    q = start_throughput(spark, job, "tp_out", f"{tmp_dir}/tckpt", interval="30 seconds",
                         watermark="10 minutes", available_now=True, fmt="memory")
    q.awaitTermination(300)
    rows = spark.sql("SELECT * FROM tp_out ORDER BY window_start").collect()
    assert [(r["window_start"], r["processed"]) for r in rows] == [
        ("2026-04-26T12:00:00.000000Z", 15), ("2026-04-26T12:00:30.000000Z", 5)]


def test_flush_trigger_is_shortest_interval():
    job = JobSpec(outputs=(OutputSpec(type="stdout", flush_interval="5 seconds"),
                           OutputSpec(type="webhook", url="u", flush_interval="500 ms")))
    assert flush_trigger(job) == "500 milliseconds"
    assert [interval_ms(x) for x in ("5s", "1m30s", "250ms", "5 seconds")] == [5000, 90000, 250, 5000]


def test_stream_two_sources_file_and_webhook(spark, tmp_dir):
    from helpers import FakeTransport
    write(f"{tmp_dir}/s1/a.log", JSON_A)
    write(f"{tmp_dir}/s2/b.log", SYSLOG_B)
    out = f"{tmp_dir}/out2"
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/s1", name="app", parse="json"),
                           SourceSpec(path=f"{tmp_dir}/s2", name="sys", parse="syslog")),
                  pipeline=PipelineSpec(min_level="warn", reference_year=2026),
                  outputs=(OutputSpec(type="file", url=out),
                           OutputSpec(type="webhook", url="http://hook", batch_size=4)))
    transport = FakeTransport(f"{tmp_dir}/hook")
    q, counters = start_pipeline(spark, job, f"{tmp_dir}/ckpt2", available_now=True,
                                 transport=transport, sleep=lambda s: None, on_error="count")
    finish(q, counters)
    written = read_jsonl(out)
    sources = sorted({d["source"] for d in written})
    assert sources == ["app", "sys"]
    # JSON: 10 warn lines; syslog: severity i % 8 for i in 0..9, ranks >= warn for 0..4 -> 7 lines
    assert len(written) == 17 and counters.errored == 0
    posted = []
    for f in os.listdir(transport.folder):
        with open(os.path.join(transport.folder, f)) as fh:
            env = json.loads(fh.read())
        assert env["count"] <= 4
        posted += env["events"]
    assert sorted(e["raw"] for e in posted) == sorted(d["raw"] for d in written)
