"""Output specs, the sink registry and the fan-out.

A sink is ``write(events_df, batch_id) -> failed_count``.  ``fan_out`` runs
every sink on the same (persisted) micro-batch; a failing sink does not stop
the others.  With a ledger, a batch that is replayed goes only to the sinks
that do not have it yet, and HTTP sinks post only what was not answered.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from logpipe.sinks import deliver
from logpipe.sinks.ledger import Ledger
from logpipe.sinks.payloads import console_payload, jsonl_payload, kafka_payload

log = logging.getLogger("logpipe")

OUTPUT_TYPES = ("stdout", "file", "elasticsearch", "kafka", "webhook")
KAFKA_CODECS = ("none", "gzip", "snappy", "lz4", "zstd")


@dataclass(frozen=True)
class OutputSpec:
    type: str
    url: str | None = None              # file path / base URL / broker list
    index: str | None = None            # elasticsearch index pattern (strftime subset)
    topic: str | None = None            # kafka
    max_records_per_file: int | None = None
    max_bytes_per_file: int | None = None   # file: a new file before a line would pass this size
    compress: bool = False
    buffer_size: int = 1000             # elasticsearch events per request
    flush_interval: str = "5 seconds"   # micro-batch trigger when streaming
    batch_size: int = 50                # webhook events per request
    headers: dict = field(default_factory=dict)
    username: str | None = None
    password: str | None = None
    compression: str | None = None      # kafka codec
    retry_max: int = 3
    order_by: str | None = None         # webhook: requests are runs of the order of this unique column


class DeliveryError(RuntimeError):
    """Some writes failed after all sinks ran; the batch should be replayed."""


def write_console(events: DataFrame, spec: OutputSpec, batch_id: int | None = None) -> int:
    """O1: print every event as indented JSON, one partition at a time."""
    for row in console_payload(events).toLocalIterator(prefetchPartitions=True):
        print(row["value"])
    return 0


def _roll_by_bytes(lines: DataFrame, limit: int) -> DataFrame:
    """Add ``roll``: which of its task's files a line goes to (sizes before compression).

    A file ends before the line that would pass the limit; that depends on
    where the last file ended, so a task goes through its lines' lengths in
    their order.  It does so file by file on whole Arrow columns; a window
    over each task's rows would shuffle all texts for it.
    """
    def run(batches):
        roll, size = 0, 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            rolls, at = np.zeros(len(ends), np.int32), 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + limit - size, "right"))
                if to <= at and not size:
                    to = at + 1  # a line over the limit has a file of its own
                rolls[at:to] = roll
                if to > at:
                    size += int(ends[to - 1]) - before
                    at = to
                if at < len(ends):
                    roll, size = roll + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rolls)], ["value", "roll"])
    return lines.mapInArrow(run, "value string, roll int")


def write_file(events: DataFrame, spec: OutputSpec, batch_id: int | None = None) -> int:
    """O2: JSON Lines files under ``spec.url``, rolled by records or bytes, optional gzip.

    A micro-batch has a folder of its own, ``batch_id=<n>``, which a replay of
    the batch overwrites, so every event is there once.  Without a batch id
    files are added to what is there.
    """
    lines = jsonl_payload(events)
    if spec.max_bytes_per_file:
        lines = _roll_by_bytes(lines, int(spec.max_bytes_per_file))
    writer = lines.write.mode("append" if batch_id is None else "overwrite")
    if spec.max_bytes_per_file:
        writer = writer.partitionBy("roll").option("partitionOverwriteMode", "static")
    if spec.max_records_per_file:
        writer = writer.option("maxRecordsPerFile", str(spec.max_records_per_file))
    if spec.compress:
        writer = writer.option("compression", "gzip")
    writer.text(spec.url if batch_id is None else f"{spec.url.rstrip('/')}/batch_id={batch_id}")
    return 0


def write_kafka(events: DataFrame, spec: OutputSpec, batch_id: int | None = None) -> int:
    """key = source, value = event JSON; needs the Kafka connector on the classpath."""
    codec = (spec.compression or "none").lower()
    if codec not in KAFKA_CODECS:
        codec = "none"
    (kafka_payload(events, spec.topic).write.format("kafka")
        .option("kafka.bootstrap.servers", spec.url)
        .option("kafka.compression.type", codec)
        .option("kafka.retries", str(spec.retry_max if spec.retry_max > 0 else 3))
        .save())
    return 0


def http_sink(spec: OutputSpec, transport: deliver.Transport, sleep, label: str, ledger: Ledger | None):
    """``write(events, batch_id)`` that counts the requests given up."""
    retry_max = spec.retry_max if spec.retry_max > 0 else 3

    def write(events: DataFrame, batch_id: int | None = None) -> int:
        known = {} if ledger is None else {"ledger": ledger.root, "sink": label,
                                           "batch": None if batch_id is None else str(batch_id)}
        if spec.type == "elasticsearch":
            r = deliver.deliver_bulk(events, spec.url, spec.index, spec.username, spec.password,
                                     spec.buffer_size if spec.buffer_size > 0 else 1000, retry_max, transport, sleep,
                                     **known)
        else:
            r = deliver.deliver_webhook(events, spec.url, spec.headers, spec.batch_size if spec.batch_size > 0 else 50,
                                        retry_max, transport, sleep, spec.order_by, **known)
        return int(r["failed_requests"])

    return write


Sink = Callable[[DataFrame, int | None], int]


def build_sink(spec: OutputSpec, transport: deliver.Transport = deliver.http_transport, sleep=None,
               label: str | None = None, ledger: Ledger | None = None) -> Sink:
    """O0: sink by type name; ``label`` names it in the ledger."""
    table = {"stdout": write_console, "file": write_file, "kafka": write_kafka}
    if spec.type in ("elasticsearch", "webhook"):
        sink = http_sink(spec, transport, sleep or time.sleep, label or spec.type, ledger)
    elif spec.type in table:
        def sink(events: DataFrame, batch_id: int | None = None) -> int:
            return table[spec.type](events, spec, batch_id)
    else:
        raise ValueError(f"output: unknown type {spec.type}")
    sink.label = label or spec.type
    return sink


def build_all(specs: list[OutputSpec], transport: deliver.Transport = deliver.http_transport,
              sleep=None, ledger: Ledger | None = None) -> list[Sink]:
    return [build_sink(s, transport, sleep, f"{i}-{s.type}", ledger) for i, s in enumerate(specs)]


def fan_out(events: DataFrame, sinks: list[Sink], batch_id: int | None = None,
            on_error: str = "raise", ledger: Ledger | None = None, persist: bool = True) -> int:
    """Every event to every sink; returns the number of failed writes.

    ``on_error="raise"`` raises after all sinks ran if any write failed,
    failed HTTP requests included (a streaming batch is then replayed from its
    checkpoint); ``"count"`` only counts (the batch is committed, the failed
    sink loses it, as in the reference).  Sinks that have the batch according
    to ``ledger`` are passed over.  ``persist=False``: the caller has stored
    what the events are made of.
    """
    batch = None if ledger is None or batch_id is None else str(batch_id)
    if batch is not None:
        sinks = [s for s in sinks if not (hasattr(s, "label") and ledger.done(s.label, batch))]
    persist = persist and len(sinks) > 1
    if persist:
        events = events.persist(StorageLevel.MEMORY_AND_DISK)
    errors, first_exc = 0, None
    try:
        for sink in sinks:
            try:
                failed = int(sink(events, batch_id) or 0)
                errors += failed
                if batch is not None and not failed and hasattr(sink, "label"):
                    ledger.finish(sink.label, batch)
                    ledger.forget(sink.label, before=batch_id)
            except Exception as e:  # one sink's failure must not stop the others
                errors += 1
                first_exc = first_exc or e
                log.error("output write: %s", e)
    finally:
        if persist:
            events.unpersist()
    if errors and on_error == "raise":
        raise first_exc or DeliveryError(f"{errors} failed writes")
    return errors
