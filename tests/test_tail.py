"""S3: growing files are followed; every line comes once, through appends, rotation, truncation and restarts."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException

from logpipe.plans.spec import JobSpec, OutputSpec, PipelineSpec, SourceSpec, from_dict
from logpipe.sources import tail
from logpipe.sources.lines import follow_lines
from logpipe.sources.tail import TailReader
from logpipe.streaming.stream import finish, start_pipeline
from test_streaming import read_jsonl


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


class Poll:
    """What a query does, without one: plan from the last offset to the newest, read all ranges."""

    def __init__(self, **options):
        self.options = options
        self.reader = TailReader(options)
        self.offset = self.reader.initialOffset()

    def restart(self):
        self.reader = TailReader(self.options)

    def __call__(self):
        end = self.reader.latestOffset()
        rows = self.rows(self.offset, end)
        self.offset = end
        return rows

    def rows(self, start, end):
        out = []
        for part in self.reader.partitions(start, end):
            for batch in self.reader.read(part):
                out += batch.column("value").to_pylist()
        return out


def test_appended_and_half_lines(tmp_dir):
    log = f"{tmp_dir}/in/app.log"
    append(log, "one\ntwo\nthr")
    poll = Poll(path=f"{tmp_dir}/in/*.log")
    assert poll() == ["one", "two"]
    assert poll() == []
    append(log, "ee")
    assert poll() == []
    append(log, "\nfour\n\nfi")
    assert poll() == ["three", "four", ""]
    append(f"{tmp_dir}/in/other.txt", "not matched\n")
    append(f"{tmp_dir}/in/new.log", "no newline yet")
    assert poll() == []
    append(f"{tmp_dir}/in/new.log", " but now\n")
    append(log, "ve\n")
    assert sorted(poll()) == ["five", "no newline yet but now"]


def test_rotation_by_renaming(tmp_dir):
    log = f"{tmp_dir}/app.log"
    append(log, "a1\na2\n")
    poll = Poll(path=log)
    assert poll() == ["a1", "a2"]
    writer = open(log, "ab")  # keeps the renamed file open, as a daemon does
    writer.write(b"a3\n")
    writer.flush()
    os.rename(log, f"{log}.1")
    append(log, "b1\n")
    writer.write(b"a4\n")
    writer.flush()
    assert sorted(poll()) == ["a3", "a4", "b1"]
    writer.write(b"a5\n")
    writer.close()
    os.rename(f"{log}.1", f"{log}.2")
    assert poll() == ["a5"]
    append(log, "b2\n")
    os.remove(f"{log}.2")
    assert poll() == ["b2"]
    assert len(poll.offset["files"]) == 1  # what has gone is forgotten


def test_rotation_while_down_needs_the_state_folder(tmp_dir):
    log = f"{tmp_dir}/app.log"
    for state, want in ((f"{tmp_dir}/state", ["a2", "b1"]), (None, ["b1"])):
        append(log, "a1\n")
        poll = Poll(path=log, **({"stateLocation": state} if state else {}))
        assert poll() == ["a1"]
        append(log, "a2\n")
        os.rename(log, f"{log}.old")
        append(log, "b1\n")
        poll.restart()
        assert sorted(poll()) == want
        os.remove(log)
        os.remove(f"{log}.old")


def test_truncated_and_rewritten(tmp_dir):
    log = f"{tmp_dir}/app.log"
    append(log, "first\nsecond\nthird\n")
    poll = Poll(path=log)
    assert len(poll()) == 3
    os.truncate(log, 0)
    assert poll() == []
    append(log, "first\nfourth\n")  # the same first line, but shorter than what was read
    assert poll() == ["first", "fourth"]
    with open(log, "wb") as f:  # the same inode, already longer than what was read
        f.write(b"other\n" * 9)
    assert poll() == ["other"] * 9
    append(log, "x\n")
    assert poll() == ["x"]


def test_a_planned_range_reads_the_same_again(tmp_dir):
    log = f"{tmp_dir}/app.log"
    append(log, "a\nb\n")
    poll = Poll(path=f"{tmp_dir}/app.log")
    start, end = poll.offset, poll.reader.latestOffset()
    append(log, "c\n")
    os.rename(log, f"{log}.1")  # renamed between planning and reading
    append(log, "d\n")
    for _ in range(2):
        poll.restart()
        assert poll.rows(start, end) == ["a", "b"]
    os.remove(f"{log}.1")
    with pytest.raises(FileNotFoundError):
        poll.rows(start, end)
    poll.options["failOnDataLoss"] = "false"
    poll.restart()
    assert poll.rows(start, end) == []


def test_pieces_and_limits_lose_and_repeat_nothing(tmp_dir, monkeypatch):
    rng = random.Random(6)
    lines = ["x" * rng.choice([0, 1, 5, 40, 300]) + str(i) for i in range(400)]
    for i in range(3):
        append(f"{tmp_dir}/d{i}/deep/f.log", "".join(x + "\n" for x in lines[i::3]))
    for chunk, piece, per_trigger in ((7, 11, 0), (64, 1, 50), (4096, 100, 333), (1 << 20, 1 << 20, 1)):
        monkeypatch.setattr(tail, "CHUNK", chunk)
        monkeypatch.setattr(tail, "BATCH_LINES", 3)
        poll = Poll(path=f"{tmp_dir}/**/*.log", maxBytesPerPartition=str(piece), maxBytesPerTrigger=str(per_trigger))
        got, rounds = [], 0
        while rows := poll():
            got += rows
            rounds += 1
        assert sorted(got) == sorted(lines)
        assert rounds == 1 if not per_trigger else rounds > 20
    positions = [p for part in poll.reader.partitions({"files": {}}, poll.offset)
                 for b in poll.reader.read(part) for p in b.column("position").to_pylist()]
    assert len(positions) == len(lines)


def test_long_lines_are_cut_for_the_length_limit(tmp_dir):
    append(f"{tmp_dir}/a.log", "y" * 10_000 + "\nshort\n" + b"\xff\xfe".decode("latin-1") + "\n")
    append(f"{tmp_dir}/a.log", b"bad \xff byte\n")
    poll = Poll(path=f"{tmp_dir}/a.log", maxLineLength="100")
    got = poll()
    assert got[0] == "y" * 101 and got[1] == "short" and got[3] == "bad � byte"


def test_latest_reads_only_what_comes(tmp_dir):
    append(f"{tmp_dir}/a.log", "old\nhalf")
    poll = Poll(path=f"{tmp_dir}/*.log", startingPosition="latest")
    assert poll() == []
    append(f"{tmp_dir}/a.log", " line\nnew\n")
    append(f"{tmp_dir}/b.log", "whole\n")
    assert sorted(poll()) == ["half line", "new", "whole"]


def test_follow_in_a_query_with_rotation_and_restart(spark, tmp_dir):
    log, out, ckpt = f"{tmp_dir}/in/app.log", f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    job = from_dict({"sources": [{"path": f"{tmp_dir}/in/app.log", "follow": True, "cleanName": True, "maxLineLength": 200}],
                     "pipeline": {"parse": "raw"}, "outputs": [{"type": "file", "url": out}]})

    def run():
        q, counters = start_pipeline(spark, job, ckpt, available_now=True)
        return finish(q, counters)

    append(log, "l0\nl1\nhal")
    assert run().processed == 2
    append(log, "f\n" + "z" * 300 + "\n")
    os.rename(log, f"{log}.1")
    append(log, "l2\n")
    c = run()
    assert (c.processed, c.dropped) == (2, 1)
    assert run().processed == 0
    # a running query: appended lines arrive without a restart
    q, counters = start_pipeline(spark, job, ckpt, trigger="200 milliseconds")
    for i in range(3, 6):
        append(log, f"l{i}\n")
        q.processAllAvailable()
    finish(q, counters)
    assert counters.processed == 3
    events = read_jsonl(out)
    assert sorted(e["raw"] for e in events) == ["half", *(f"l{i}" for i in range(6))]
    assert {e["source"] for e in events} == {"app.log"}


def test_read_failures_reach_the_query(spark, tmp_dir):
    append(f"{tmp_dir}/in/a.log", "one\n")
    df = follow_lines(spark, f"{tmp_dir}/in/*.log", "s")
    q = df.writeStream.format("memory").queryName("tail_ok").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["raw"] for r in spark.table("tail_ok").collect()] == ["one"]
    bad = spark.readStream.format(tail.NAME).load()
    with pytest.raises(StreamingQueryException, match="needs a path"):
        bad.writeStream.format("memory").queryName("tail_bad").start().awaitTermination(120)


def test_spec_checks_the_starting_position():
    with pytest.raises(ValueError, match="starting position"):
        JobSpec(sources=(SourceSpec(path="x", starting_position="end"),), pipeline=PipelineSpec(),
                outputs=(OutputSpec(type="stdout"),)).validate()
