"""HTTP sinks as data source writers, ``df.write.format("logpipe_webhook")`` and ``("logpipe_bulk")``.

The table has one column of texts: events for a webhook, action and document
lines (each with its newline) for a bulk endpoint.  A task cuts its rows into
requests of at most ``batchSize`` texts and answers with a commit message of
what it sent; only the messages of tasks that ended well are counted, when the
write commits.  With ``whole=true`` every row is a request already; a second
column says how many events it holds, a third gives it a name by which a
replay knows it wherever it comes up.

Every answered request is noted in the ledger before the next one is sent: a
task that is run again, or a batch that is replayed, posts only what is
missing (O8).  ``sink`` and ``batch`` name the ledger's folder; without
``batch`` a write is not shared with any other.  ``onError=raise`` (default)
fails the write if requests were given up, after all tasks have sent theirs;
``count`` only writes the totals to the ledger.
"""

from __future__ import annotations

import base64
import pickle
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from logpipe.session import checkpoint_root, ship_package, subdir
from logpipe.sinks.ledger import Ledger, chunk_name
from logpipe.sinks.payloads import envelope_text
from logpipe.sinks.posting import DEFAULT_RETRY_MAX, DEFAULT_TIMEOUT, http_transport, post_bulk, send_with_retry

COUNTS = ("events", "requests", "failed_requests", "failed_events", "skipped_requests")


def pack(value) -> str:
    """A picklable object as an option."""
    return base64.b64encode(cloudpickle.dumps(value)).decode()


def unpack(text: str | None, default):
    return pickle.loads(base64.b64decode(text)) if text else default


@dataclass
class Sent(WriterCommitMessage):
    """What one task has sent."""
    events: int = 0
    requests: int = 0
    failed_requests: int = 0
    failed_events: int = 0
    skipped_requests: int = 0       # answered in an earlier attempt
    error: str | None = None


class HttpWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        if not get("url"):
            raise ValueError("an HTTP sink needs a url")
        self.url, self.whole = get("url"), get("whole", "false") == "true"
        self.size = max(1, int(get("batchsize", "50")))
        self.retry_max = int(get("retrymax", str(DEFAULT_RETRY_MAX)))
        self.timeout = float(get("timeout", str(DEFAULT_TIMEOUT)))
        self.headers = unpack(get("headers"), {})
        self.transport = unpack(get("transport"), http_transport)
        self.sleep = unpack(get("sleep"), time.sleep)
        self.strict = get("onerror", "raise") == "raise"
        self.sink, self.batch = get("sink", "http"), get("batch") or uuid.uuid4().hex
        self.ledger = Ledger(get("ledger"))

    def post(self, items: list[str], left: list[int]) -> tuple[list[int], int, str | None, bool]:
        """Post the items at the positions ``left``: (positions not accepted yet, items refused, error, answered)."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        sent = Sent()
        task = "named" if self.whole else str(TaskContext.get().partitionId())
        known = {} if self.whole else self.ledger.answered(self.sink, self.batch, task)
        for name, items, events in self._requests(iterator):
            if self.whole:
                before = self.ledger.answered_one(self.sink, self.batch, task, name)
            else:
                before = known.get(name)
            sent.events += events
            left = list(range(len(items))) if before is None else before
            if not left:
                sent.skipped_requests += 1
                continue
            left, refused, error, answered = self.post(items, left)
            sent.requests += 1
            if answered:
                self.ledger.answer(self.sink, self.batch, task, name, left)
            if left or refused:
                sent.failed_requests += 1
                sent.failed_events += self.failed(left, refused, events)
                sent.error = error
        return sent

    def _requests(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], int]]:
        """(name, texts, number of events) of each request."""
        held: list[str] = []
        number = 0
        for batch in batches:
            if self.whole:
                columns = (batch.column(i).to_pylist() for i in range(3))
                for text, events, name in zip(*columns):
                    yield name, self.items(text), events
                continue
            for text in batch.column(0).to_pylist():
                held.append(text)
                if len(held) == self.size:
                    yield chunk_name(number, held), held, len(held)
                    held, number = [], number + 1
        if held:
            yield chunk_name(number, held), held, len(held)

    def items(self, text: str) -> list[str]:
        """The items of a request that comes whole."""
        return [text]

    def failed(self, left: list[int], refused: int, events: int) -> int:
        """Events that were not accepted."""
        return len(left) + refused

    def _totals(self, messages: list[Sent | None]) -> dict:
        done = [m for m in messages if m is not None]
        return {k: sum(getattr(m, k) for m in done) for k in COUNTS} | {
            "error": next((m.error for m in done if m.error), None)}

    def commit(self, messages: list[Sent | None]) -> None:
        totals = self._totals(messages)
        self.ledger.summarise(self.sink, self.batch, totals)
        if self.strict and totals["failed_requests"]:
            raise RuntimeError(f"{totals['failed_requests']} requests failed: {totals['error']}")

    def abort(self, messages: list[Sent | None]) -> None:
        """A write that failed counts nothing; what was answered stays noted for the next attempt."""


class WebhookWriter(HttpWriter):
    """Envelopes of events."""

    def post(self, items, left):
        headers = {"Content-Type": "application/json", **self.headers}
        body = items[0] if self.whole else envelope_text(items, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
        ok, _, error, _ = send_with_retry(self.transport, self.url, body.encode(), headers, self.retry_max,
                                          self.timeout, self.sleep)
        return ([], 0, None, True) if ok else (left, 0, error, False)

    def failed(self, left, refused, events):
        return events if left else 0


class BulkWriter(HttpWriter):
    """O3: bulk requests; items refused for good are not posted again."""

    def items(self, text):
        lines = text.split("\n")  # action and document by turns
        return [f"{a}\n{d}\n" for a, d in zip(lines[::2], lines[1::2])]

    def post(self, items, left):
        _, refused, waiting, error, answered = post_bulk([items[i] for i in left], self.transport, self.url,
                                                         self.headers, self.retry_max, self.timeout, self.sleep)
        return [left[i] for i in waiting], refused, error, answered


class _HttpSink(DataSource):
    writes: type[HttpWriter]

    def writer(self, schema, overwrite: bool) -> HttpWriter:
        kinds = [f.dataType.simpleString() for f in schema.fields]
        whole = {k.lower(): v for k, v in self.options.items()}.get("whole") == "true"
        if kinds != (["string", "bigint", "string"] if whole else ["string"]):
            raise ValueError("an HTTP sink takes one column of texts" + ", their numbers of events and names" * whole)
        return self.writes(self.options)


class WebhookSink(_HttpSink):
    writes = WebhookWriter

    @classmethod
    def name(cls) -> str:
        return "logpipe_webhook"


class BulkSink(_HttpSink):
    writes = BulkWriter

    @classmethod
    def name(cls) -> str:
        return "logpipe_bulk"


def register(spark: SparkSession) -> None:
    """Make the HTTP sinks' formats known to a session and its workers."""
    ship_package(spark)
    for sink in (WebhookSink, BulkSink):
        spark.dataSource.register(sink)


def ledger_root(spark: SparkSession) -> str:
    return subdir(checkpoint_root(spark), "logpipe", "ledger")


def write_http(texts: DataFrame, kind: str, url: str, *, headers: dict | None = None, batch_size: int = 50,
               retry_max: int = DEFAULT_RETRY_MAX, whole: bool = False, transport=http_transport, sleep=time.sleep,
               ledger: str | None = None, sink: str | None = None, batch: str | None = None) -> dict:
    """Write a column of texts to an HTTP sink; the totals of the tasks that committed.

    Without ``batch`` the ledger only serves tasks that are run again, and is
    deleted after the write.
    """
    spark = texts.sparkSession
    register(spark)
    book = Ledger(ledger or ledger_root(spark))
    sink, own = sink or kind, batch or uuid.uuid4().hex
    options = {"url": url, "headers": pack(headers or {}), "batchSize": str(batch_size), "retryMax": str(retry_max),
               "whole": str(whole).lower(), "ledger": book.root, "sink": sink, "batch": own, "onError": "count"}
    if transport is not http_transport:
        options["transport"] = pack(transport)
    if sleep is not time.sleep:
        options["sleep"] = pack(sleep)
    texts.write.format(f"logpipe_{kind}").options(**options).mode("append").save()
    totals = book.summary(sink, own)
    if batch is None:
        book.forget(sink, own)
    return totals

