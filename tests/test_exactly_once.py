"""Replays, restarts and lost tasks: every request is posted once, every line counted once."""

import json
import os
import time

import pytest
from helpers import lines_df
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logpipe.operators.parse import parse
from logpipe.operators.stats import stats
from logpipe.plans.pipeline import build
from logpipe.plans.spec import JobSpec, OutputSpec, PipelineSpec, SourceSpec
from logpipe.sinks import writers
from logpipe.sinks.ledger import Ledger
from logpipe.sinks.outputs import DeliveryError, build_all, fan_out
from logpipe.streaming import Totals, Windows, finish, start_job, start_pipeline, totals_table
from logpipe.streaming.buffered import close_batches
from test_delivery import json_lines, text_lines, write


class Server:
    """Keeps every accepted body in a folder; ``fails`` says which posts are refused, by a file that counts down."""

    def __init__(self, folder, fails=0, crash=False, only=None, reply=""):
        self.folder, self.crash, self.only, self.reply = folder, crash, only, reply
        os.makedirs(folder, exist_ok=True)
        self.set_fails(fails)

    def set_fails(self, n):
        with open(f"{self.folder}.fails", "w") as f:
            f.write(str(n))

    def __call__(self, method, url, body, headers, timeout):
        if self.only is None or self.only in body.decode():
            n = int(open(f"{self.folder}.fails").read())
            if n > 0:
                self.set_fails(n - 1)
                if self.crash:
                    raise KeyboardInterrupt  # the task dies
                return 503, "busy"
        with open(f"{self.folder}/{time.time_ns()}-{os.getpid()}-{id(body)}", "wb") as f:
            f.write(body)
        return 200, self.reply

    def bodies(self):
        return [open(f"{self.folder}/{n}").read() for n in sorted(os.listdir(self.folder))]

    def messages(self):
        return sorted(e["msg"] for b in self.bodies() for e in json.loads(b)["events"])


def names(n, start=0):
    return sorted(f"m{i}" for i in range(start, start + n))


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(json.dumps({"msg": f"m{i}"}),) for i in range(10)], "value string").coalesce(1)


# ------------------------------------------------------------------ writers
def options(tmp_dir, server, **more):
    return {"url": "http://x", "batchSize": "3", "retryMax": "0", "ledger": f"{tmp_dir}/ledger", "sink": "s", "batch": "7",
            "transport": writers.pack(server)} | more


def test_a_write_commits_what_its_tasks_sent(spark, texts, tmp_dir):
    writers.register(spark)
    server = Server(f"{tmp_dir}/web")
    texts.write.format("logpipe_webhook").options(**options(tmp_dir, server)).mode("append").save()
    assert server.messages() == names(10) and len(server.bodies()) == 4
    assert Ledger(f"{tmp_dir}/ledger").summary("s", "7") == {
        "events": 10, "requests": 4, "failed_requests": 0, "failed_events": 0, "skipped_requests": 0, "error": None}


def test_a_lost_task_counts_nothing_and_sends_the_rest_when_run_again(spark, texts, tmp_dir):
    writers.register(spark)
    server = Server(f"{tmp_dir}/web", fails=1, crash=True, only='"m6"')
    book = Ledger(f"{tmp_dir}/ledger")

    def run():
        texts.write.format("logpipe_webhook").options(**options(tmp_dir, server)).mode("append").save()

    with pytest.raises(Exception):
        run()
    assert book.summary("s", "7") is None and len(server.bodies()) == 2
    run()
    assert server.messages() == names(10)
    assert {k: book.summary("s", "7")[k] for k in ("events", "requests", "skipped_requests")} == {
        "events": 10, "requests": 2, "skipped_requests": 2}


def test_failed_requests_fail_the_write_unless_counted(spark, texts, tmp_dir):
    writers.register(spark)
    server = Server(f"{tmp_dir}/web", fails=1)
    with pytest.raises(Exception, match="1 requests failed: HTTP 503"):
        texts.write.format("logpipe_webhook").options(**options(tmp_dir, server)).mode("append").save()
    assert len(server.bodies()) == 3  # the other requests were sent all the same
    texts.write.format("logpipe_webhook").options(**options(tmp_dir, server)).mode("append").save()
    assert server.messages() == names(10)
    with pytest.raises(Exception, match="one column of texts"):
        texts.withColumn("x", F.lit(1)).write.format("logpipe_bulk").options(**options(tmp_dir, server)).mode("append").save()


def test_bulk_replays_only_items_that_were_not_accepted(spark, tmp_dir):
    items = spark.createDataFrame([(f'{{"index":{{}}}}\n{{"i":{i}}}\n',) for i in range(4)], "value string").coalesce(1)
    statuses = [201, 429, 400, 201]
    reply = json.dumps({"errors": True, "items": [{"index": {"status": s} | ({"error": {}} if s > 201 else {})} for s in statuses]})
    server = Server(f"{tmp_dir}/es", reply=reply)
    known = dict(ledger=f"{tmp_dir}/ledger", sink="b", batch="1", retry_max=0)
    first = writers.write_http(items, "bulk", "http://es", transport=server, **known)
    assert (first["failed_requests"], first["failed_events"]) == (1, 2)
    server.reply = ""
    again = writers.write_http(items, "bulk", "http://es", transport=server, **known)
    assert (again["requests"], again["failed_events"]) == (1, 0)
    assert [b.count("\n") for b in server.bodies()] == [8, 2] and '"i":1' in server.bodies()[1]
    assert writers.write_http(items, "bulk", "http://es", transport=server, **known)["skipped_requests"] == 1


# ------------------------------------------------------------------ fan-out
def test_one_sink_failing_once_makes_no_other_repeat(spark, tmp_dir):
    events = parse(lines_df(spark, json_lines(9).splitlines(), "svc"), "json").coalesce(1)
    good, bad = Server(f"{tmp_dir}/good"), Server(f"{tmp_dir}/bad", fails=1, only='"m4"')
    book = Ledger(f"{tmp_dir}/ledger")
    hook = OutputSpec(type="webhook", url="http://x", batch_size=2, retry_max=1)
    kept = []

    def third(df, batch_id=None):
        kept.append(df.count())
        return 0

    third.label = "2-own"
    sinks = [*build_all([hook], good, lambda s: None, book)]
    failing = build_all([hook, hook], bad, lambda s: None, book)[1]
    bad.set_fails(2)
    sinks += [failing, third]
    with pytest.raises(DeliveryError):
        fan_out(events, sinks, 3, ledger=book)
    assert fan_out(events, sinks, 3, ledger=book) == 0  # the replay
    assert fan_out(events, sinks, 3, ledger=book) == 0  # everything has it
    assert good.messages() == bad.messages() == names(9)
    assert len(good.bodies()) == len(bad.bodies()) == 5 and kept == [9]
    fan_out(events, sinks, 4, ledger=book)
    assert len(good.bodies()) == 10 and book.names("0-webhook") == ["4"]  # older batches cannot come again


def test_ordered_webhook_requests(spark, tmp_dir):
    events = parse(lines_df(spark, json_lines(23).splitlines(), "svc").repartition(5), "json")
    server = Server(f"{tmp_dir}/web")
    hook = OutputSpec(type="webhook", url="http://x", batch_size=5, order_by="line_id")
    assert fan_out(events, build_all([hook], server)) == 0
    batches = sorted(([e["msg"] for e in json.loads(b)["events"]] for b in server.bodies()), key=lambda x: int(x[0][1:]))
    assert batches == [[f"m{i}" for i in range(a, min(23, a + 5))] for a in range(0, 23, 5)]


# ------------------------------------------------------------------ totals
def test_totals_of_a_stream_that_failed_and_was_restarted(spark, tmp_dir):
    server, ckpt = Server(f"{tmp_dir}/web", fails=2, only='"m11"'), f"{tmp_dir}/ckpt"
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app"),),
                  pipeline=PipelineSpec(parse="json", exclude_regex="m1[5-9]"),
                  outputs=(OutputSpec(type="file", url=f"{tmp_dir}/out"),
                           OutputSpec(type="webhook", url="http://x", batch_size=4, retry_max=1)))

    def run():
        q, c = start_pipeline(spark, job, ckpt, available_now=True, transport=server, sleep=lambda s: None)
        finish(q, c)
        return q, c

    write(f"{tmp_dir}/in/a.log", json_lines(10))
    run()
    write(f"{tmp_dir}/in/b.log", json_lines(10, 10))
    q, c = run()
    assert isinstance(q.exception(), StreamingQueryException) and c.processed == 0 and c.errored == 1
    assert c.totals.last() == {"processed": 10, "dropped": 0, "kept": 10, "errored": 0}
    q, c = run()  # the batch is replayed
    assert q.exception() is None and c.processed == 10
    write(f"{tmp_dir}/in/c.log", json_lines(10, 20))
    _, c = run()
    one = stats(build(spark, job).flagged).first().asDict()
    assert c.totals.last() == one | {"errored": 1} == {"processed": 30, "dropped": 5, "kept": 25, "errored": 1}
    assert server.messages() == sorted(names(15) + names(10, 20))
    assert len(text_lines(f"{tmp_dir}/out")) == 25
    table = totals_table(spark, f"{ckpt}/totals").orderBy("batch_id").collect()
    assert [(r["batch_id"], r["processed"], r["errored"]) for r in table] == [(0, 10, 0), (1, 20, 1), (2, 30, 1)]


def test_totals_are_kept_by_batch(tmp_dir):
    t = Totals(f"{tmp_dir}/totals")
    count = {"processed": 2, "dropped": 1, "kept": 1, "errored": 0, "latest": 5}
    t.add(0, count)
    t.add(1, count | {"latest": None})
    t.add(1, count | {"latest": None})  # a replay counts once
    t.add(2, {}, 3, failed=True)
    assert t.last() == {"processed": 4, "dropped": 2, "kept": 2, "errored": 0} and t.before(2)["latest"] == 5
    t.add(2, {}, 1, failed=True)
    assert t.add(2, count | {"latest": 9})["errored"] == 4
    assert t.last() == {"processed": 6, "dropped": 3, "kept": 3, "errored": 4}
    for n in range(3, 120):
        t.add(n, count)
    assert len(t.names("")) == 100 and t.last()["processed"] == 240
    assert Totals(f"{tmp_dir}/none").last() == {"processed": 0, "dropped": 0, "kept": 0, "errored": 0}


def test_intervals_add_up_to_the_totals_with_late_and_untimed_lines(spark, tmp_dir):
    def line(i, ts):
        return json.dumps({"msg": f"m{i}", "lvl": "warn" if i % 2 else "debug"} | ({"ts": ts} if ts else {})) + "\n"

    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app", max_line_length=500),),
                  pipeline=PipelineSpec(parse="json", min_level="info"), outputs=(OutputSpec(type="file", url=f"{tmp_dir}/out"),))
    ckpt, path = f"{tmp_dir}/ckpt", f"{tmp_dir}/a2"
    files = ["".join(line(i, f"2026-04-26T12:00:{i:02d}Z") for i in range(40)) + "z" * 600 + "\n" + line(1, None),
             line(3, "2026-04-26T13:00:00Z") + line(4, "2026-04-26T12:00:10Z"),   # not late yet: the hour is new
             line(5, "2026-04-26T12:00:10Z") + line(7, None) + line(9, "2026-04-26T12:55:00Z") + "no json\n"]
    for i, text in enumerate(files):
        write(f"{tmp_dir}/in/{i}.log", text)
        q, c = start_pipeline(spark, job, ckpt, available_now=True, windows=path)
        finish(q, c)
        assert q.exception() is None
    rows = Windows(spark, path).table().collect()
    total = {k: sum(r[k] for r in rows) for k in ("processed", "dropped", "kept")}
    assert total | {"errored": 0} == c.totals.last()
    assert total["processed"] == 47 and total["dropped"] > 20
    by = {}
    for r in rows:
        by.setdefault(r["basis"], []).append((str(r["window_start"])[11:], r["processed"]))
    assert sorted(by["event"]) == [("12:00:00", 31), ("12:00:30", 10), ("12:55:00", 1), ("13:00:00", 1)]
    assert by["late"] == [("12:00:00", 1)]
    assert sum(n for _, n in by["arrival"]) == 3


def test_interval_tables_are_added_up(spark, tmp_dir):
    flagged = build_flagged(spark)
    table = Windows(spark, f"{tmp_dir}/a2", every=3)
    for n in range(8):
        table.add(flagged, n, None)
        if n % 3 == 0:
            table.add(flagged, n, None)  # replayed
        rows = table.table().where("basis = 'event'").collect()
        assert sum(r["processed"] for r in rows) == 4 * (n + 1)
    assert len([x for x in os.listdir(f"{tmp_dir}/a2") if "=" in x]) <= 3


def build_flagged(spark):
    from logpipe.plans.pipeline import build_from_lines
    lines = ['{"msg":"a","ts":"2026-04-26T12:00:0%dZ"}' % i for i in range(4)]
    return build_from_lines([(lines_df(spark, lines), None)], PipelineSpec(parse="json")).flagged


# ------------------------------------------------------------------ buffers
def test_close_batches():
    assert close_batches([], None, ["a"], 100, 3, 50) == ([], ["a"], 100)
    assert close_batches(["a"], 100, ["b"], 149, 3, 50) == ([], ["a", "b"], 100)
    assert close_batches(["a"], 100, ["b"], 150, 3, 50) == ([["a", "b"]], [], None)
    assert close_batches(["a"], 100, list("bcdefgh"), 120, 3, 50) == ([["a", "b", "c"], ["d", "e", "f"]], ["g", "h"], 120)
    assert close_batches(["a"], 100, [], 149, 3, 50, True) == ([["a"]], [], None)
    assert close_batches([], None, [], 100, 3, 50) == ([], [], None)


def test_outputs_keep_their_own_intervals_and_buffers_survive_a_restart(spark, tmp_dir):
    server = Server(f"{tmp_dir}/web")
    slow = OutputSpec(type="webhook", url="http://slow", batch_size=5, flush_interval="1 hour", headers={"X": "slow"})
    fast = OutputSpec(type="elasticsearch", url="http://fast", buffer_size=100, flush_interval="300 ms")
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app"),), pipeline=PipelineSpec(parse="json"),
                  outputs=(slow, fast, OutputSpec(type="file", url=f"{tmp_dir}/out")))

    def events(bulk):
        return [b for b in server.bodies() if b.startswith('{"index"') == bulk]

    def until(check, seconds=60):
        end = time.time() + seconds
        while not check() and time.time() < end:
            time.sleep(0.1)
        assert check()

    def start():
        return start_job(spark, job, f"{tmp_dir}/ckpt", trigger="100 milliseconds", transport=server, sleep=lambda s: None)

    write(f"{tmp_dir}/in/a.log", json_lines(7))
    running = start()
    # the short interval sends all seven; the long one only a full buffer
    until(lambda: sum(b.count("\n") for b in events(True)) == 14 and len(events(False)) == 1)
    assert json.loads(events(False)[0])["count"] == 5
    for q in running.queries.values():
        q.stop()
    write(f"{tmp_dir}/in/b.log", json_lines(3, 7))
    running = start()
    until(lambda: len(events(False)) == 2 and sum(b.count("\n") for b in events(True)) == 20)
    assert server_messages(events(False)) == names(10)  # two of them were held over the restart
    running.finish(timeout=60)
    assert len(text_lines(f"{tmp_dir}/out")) == 10
    assert Totals(f"{tmp_dir}/ckpt/main/totals").last()["processed"] == 10


def server_messages(bodies):
    return sorted(e["msg"] for b in bodies for e in json.loads(b)["events"])


def test_finish_sends_what_the_buffers_hold(spark, tmp_dir):
    server = Server(f"{tmp_dir}/web")
    hook = OutputSpec(type="webhook", url="http://x", batch_size=50, flush_interval="1 s")
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app"),), pipeline=PipelineSpec(parse="json"), outputs=(hook,))
    write(f"{tmp_dir}/in/a.log", json_lines(7))
    counters = start_job(spark, job, f"{tmp_dir}/ckpt", transport=server, shards=2).finish()
    assert server.messages() == names(7) and counters["0-webhook"].processed == 7


def test_a_failed_request_of_a_buffer_is_replayed_alone(spark, tmp_dir):
    server = Server(f"{tmp_dir}/web", fails=1, only='"m7"')
    hook = OutputSpec(type="webhook", url="http://x", batch_size=4, flush_interval="200 ms", retry_max=1)
    job = JobSpec(sources=(SourceSpec(path=f"{tmp_dir}/in", name="app"),), pipeline=PipelineSpec(parse="json"), outputs=(hook,))
    write(f"{tmp_dir}/in/a.log", json_lines(12))
    server.set_fails(2)
    running = start_job(spark, job, f"{tmp_dir}/ckpt", transport=server, sleep=lambda s: None)
    running.finish(timeout=60)
    assert running.queries["0-webhook"].exception() is not None
    start_job(spark, job, f"{tmp_dir}/ckpt", transport=server, sleep=lambda s: None).finish(timeout=60)
    assert server.messages() == names(12) and len(server.bodies()) == 3
