"""S3, O6, O7, O9, A1, A2 on streams: the same plan run as Structured Streaming queries.

* Files landing in a watched directory are read once each, growing files line
  by line (S3); progress is in the checkpoint, so a restarted query neither
  re-reads nor skips anything.
* Each micro-batch goes to every sink through ``fan_out`` (O6) inside
  ``foreachBatch``; a ledger in the checkpoint folder keeps a replayed batch
  from being sent again (O8).
* The counters (A1) and, if asked for, the counts of all intervals (A2) are
  written with the batch and go on after a restart (``logpipe.streaming.totals``).
* ``start_pipeline`` runs a job as one query, whose trigger is the shortest
  flush interval.  ``start_job`` gives every HTTP output a query and a buffer
  of its own, which is sent when it is full or its own interval is over (O7).
* ``start_throughput`` is A2 as an event-time aggregation with a watermark,
  emitted in append mode once each window closes.
"""

from __future__ import annotations

import datetime as dt
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logpipe.operators.stats import throughput
from logpipe.plans.pipeline import build, output_events
from logpipe.plans.spec import JobSpec
from logpipe.session import checkpoint_root, subdir
from logpipe.sinks import deliver
from logpipe.sinks.ledger import Ledger
from logpipe.sinks.outputs import DeliveryError, OutputSpec, build_all, fan_out
from logpipe.sinks.writers import write_http
from logpipe.streaming.buffered import buffered_requests
from logpipe.streaming.totals import Totals, Windows, batch_counts

BUFFERED = ("elasticsearch", "webhook")


@dataclass
class Counters:
    """Totals since the query was started; ``totals`` also has those of earlier runs."""
    processed: int = 0
    dropped: int = 0
    errored: int = 0
    batches: list = field(default_factory=list)
    totals: Totals | None = None

    def snapshot(self) -> dict:
        return {"processed": self.processed, "dropped": self.dropped, "errored": self.errored}


_UNITS_MS = {"ms": 1, "millisecond": 1, "milliseconds": 1, "s": 1000, "second": 1000, "seconds": 1000,
             "m": 60_000, "minute": 60_000, "minutes": 60_000, "h": 3_600_000, "hour": 3_600_000,
             "hours": 3_600_000}


def interval_ms(text: str) -> int:
    """Milliseconds of ``5s``, ``1m30s``, ``500ms`` or ``5 seconds``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", text.strip().lower())
    if not parts or any(unit not in _UNITS_MS for _, unit in parts):
        raise ValueError(f"not an interval: {text!r}")
    return round(sum(float(n) * _UNITS_MS[unit] for n, unit in parts))


def flush_trigger(job: JobSpec) -> str:
    """The shortest flush interval of the outputs."""
    intervals = [interval_ms(o.flush_interval) for o in job.outputs if o.flush_interval]
    return f"{min(intervals, default=5000)} milliseconds"


def start_pipeline(spark: SparkSession, job: JobSpec, checkpoint: str | None = None, *,
                   available_now: bool = False, trigger: str | None = None,
                   on_error: str = "raise", transport: deliver.Transport = deliver.http_transport,
                   sleep=None, max_files_per_trigger: int | None = None,
                   query_name: str | None = None, windows: str | None = None, interval: str = "30 seconds",
                   watermark: str = "10 minutes") -> tuple[StreamingQuery, Counters]:
    """Run the job as one stream: sources -> pipeline -> every output.

    Totals are kept under ``<checkpoint>/totals``; ``windows`` names a folder
    for the counts of all intervals (see ``Windows``).
    """
    ckpt = checkpoint or subdir(checkpoint_root(spark), "logpipe", query_name or "pipeline")
    plan = build(spark, job, stream=True, max_files_per_trigger=max_files_per_trigger, state=subdir(ckpt, "followed"))
    ledger = Ledger(subdir(ckpt, "delivered"))
    sinks = build_all(list(job.outputs), transport, sleep, ledger)
    counters = Counters(totals=Totals(subdir(ckpt, "totals")))
    table = Windows(spark, windows, interval, watermark) if windows else None

    def each_batch(flagged: DataFrame, batch_id: int) -> None:
        flagged = flagged.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = batch_counts(flagged)
            if table is not None:
                table.add(flagged, batch_id, counters.totals.before(batch_id)["latest"])
            errors = fan_out(output_events(flagged, job.pipeline), sinks, batch_id, "count", ledger,
                             persist=False)
            counters.errored += errors
            again = bool(errors) and on_error == "raise"
            counters.totals.add(batch_id, counts | {"errored": errors} if not again else {}, errors if again else 0, again)
            if again:
                raise DeliveryError(f"{errors} failed writes")
        finally:
            flagged.unpersist()
        counters.processed += counts["processed"]
        counters.dropped += counts["dropped"]
        counters.batches.append(batch_id)

    writer = plan.flagged.writeStream.foreachBatch(each_batch).option("checkpointLocation", ckpt)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=trigger or flush_trigger(job))
    return writer.start(), counters


def start_buffered(spark: SparkSession, job: JobSpec, number: int, checkpoint: str, *, shards: int = 1,
                   on_error: str = "raise", transport: deliver.Transport = deliver.http_transport, sleep=None,
                   trigger: str | None = None) -> tuple[StreamingQuery, Counters]:
    """One HTTP output of the job, with a buffer and a flush interval of its own.

    ``counters.processed`` counts the events delivered.
    """
    spec: OutputSpec = job.outputs[number]
    pause = interval_ms(spec.flush_interval)
    plan = build(spark, job, stream=True, state=subdir(checkpoint, "followed"))
    requests = buffered_requests(plan.events, spec, pause, shards)
    bulk = spec.type == "elasticsearch"
    label, ledger = f"{number}-{spec.type}", Ledger(subdir(checkpoint, "delivered"))
    counters = Counters()

    def each_batch(closed: DataFrame, batch_id: int) -> None:
        rows = closed.select("body", "count", F.concat_ws("-", "shard", "number").alias("name"))
        r = write_http(rows, "bulk" if bulk else "webhook", deliver.bulk_endpoint(spec.url) if bulk else spec.url,
                       headers=deliver.bulk_headers(spec.username, spec.password) if bulk else spec.headers,
                       retry_max=spec.retry_max if spec.retry_max > 0 else 3, whole=True, transport=transport,
                       sleep=sleep or time.sleep, ledger=ledger.root, sink=label, batch=str(batch_id))
        counters.errored += r["failed_requests"]
        if r["failed_requests"] and on_error == "raise":
            raise DeliveryError(f"{r['failed_requests']} failed requests: {r['error']}")
        ledger.forget(label, before=batch_id)
        counters.processed += r["events"]
        counters.batches.append(batch_id)

    tick = trigger or f"{min(1000, max(100, pause // 4))} milliseconds"
    writer = requests.writeStream.outputMode("append").foreachBatch(each_batch)
    writer = writer.option("checkpointLocation", checkpoint).trigger(processingTime=tick)
    # a query keeps the number of partitions it is started with: one for each buffer
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        return writer.start(), counters
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


@dataclass
class Running:
    """The queries of a job: ``main`` for direct outputs and totals, one for each buffered output."""
    queries: dict[str, StreamingQuery]
    counters: dict[str, Counters]
    longest_wait: float = 0.0

    def finish(self, timeout: float | None = None) -> dict[str, Counters]:
        """Drain the sources, wait until the buffers' intervals have passed, stop.

        Gives up waiting after ``timeout`` seconds (default: a minute more
        than the longest interval); what still waits is sent after a restart.
        """
        end = time.time() + (timeout if timeout is not None else self.longest_wait + 60)
        _within(lambda: _drain(self.queries["main"]), end - time.time())
        asked = dt.datetime.now(dt.timezone.utc)
        for name, query in self.queries.items():
            while name != "main" and query.isActive and not _empty(query, asked) and time.time() < end:
                time.sleep(0.1)
        for query in self.queries.values():
            query.stop()
        return self.counters


def start_job(spark: SparkSession, job: JobSpec, checkpoint: str | None = None, *, shards: int = 1,
              trigger: str | None = None, **options) -> Running:
    """Run a job so that outputs do not wait for each other.

    Console, file and Kafka outputs share one query, which also keeps totals
    and intervals (options of ``start_pipeline``).  Every HTTP output is a
    query of its own over the same sources, with its own checkpoint, buffer
    and flush interval; ``shards`` buffers fill side by side.
    """
    ckpt = checkpoint or subdir(checkpoint_root(spark), "logpipe", "job")
    own = {i: o for i, o in enumerate(job.outputs) if o.type in BUFFERED}
    direct = tuple(o for i, o in enumerate(job.outputs) if i not in own)
    job.validate()
    running = Running({}, {}, max((interval_ms(o.flush_interval) / 1000 for o in own.values()), default=0.0))
    http = {k: options[k] for k in ("on_error", "transport", "sleep") if k in options}
    running.queries["main"], running.counters["main"] = start_pipeline(
        spark, job.with_outputs(direct), subdir(ckpt, "main"), trigger=trigger, **options)
    for i, spec in own.items():
        name = f"{i}-{spec.type}"
        running.queries[name], running.counters[name] = start_buffered(
            spark, job, i, subdir(ckpt, name), shards=shards, trigger=trigger, **http)
    return running


def finish(query: StreamingQuery, counters: Counters, timeout: float | None = None) -> Counters:
    """Drain what is available (for at most ``timeout`` seconds) and stop."""
    _within(lambda: _drain(query), timeout)
    query.stop()
    return counters


def _within(work: Callable[[], None], timeout: float | None) -> None:
    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(timeout)


def _empty(query: StreamingQuery, since: dt.datetime) -> bool:
    """Whether a batch begun after ``since`` found no new rows, and the buffers are empty.

    (A query with timers always has another batch to run, so it never counts as drained.)
    """
    p = query.lastProgress
    return (p is not None and dt.datetime.fromisoformat(p.timestamp) >= since and not p.numInputRows
            and not any(op.numRowsTotal for op in p.stateOperators))


def _drain(query: StreamingQuery) -> None:
    try:
        query.processAllAvailable()
    except StreamingQueryException:
        pass  # kept as query.exception()


def start_throughput(spark: SparkSession, job: JobSpec, path: str, checkpoint: str | None = None, *,
                     interval: str = "30 seconds", watermark: str = "10 minutes",
                     available_now: bool = False, fmt: str = "parquet") -> StreamingQuery:
    """A2 as a stream: closed windows appended to ``path`` (``fmt='memory'``: a table name)."""
    plan = build(spark, job, stream=True)
    table = throughput(plan.flagged, interval, by_source=True, watermark=watermark)
    ckpt = checkpoint or subdir(checkpoint_root(spark), "logpipe", "throughput")
    writer = table.writeStream.outputMode("append").option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    if fmt == "memory":
        return writer.format("memory").queryName(path).start()
    return writer.format(fmt).option("path", path).start()
