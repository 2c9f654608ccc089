"""An HTTP output's own buffer on a stream.

Events wait in keyed state until ``size`` of them are there or the oldest has
waited for the output's flush interval; then they are one request.  The state
is part of the query's checkpoint, so what waits survives a restart.  Events
are dealt to ``shards`` buffers by a hash of their text, so a buffer's rows
of one micro-batch are a share of it; they are taken in the order of their
texts, which makes a replayed micro-batch close the same requests.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logpipe.functions.encode import event_json
from logpipe.session import ship_package
from logpipe.sinks.deliver import bulk_texts
from logpipe.sinks.outputs import OutputSpec
from logpipe.sinks.payloads import envelope_text

REQUESTS = "shard int, number int, count long, body string"


def close_batches(held: list[str], since: int | None, new: list[str], now: int, size: int, interval_ms: int,
                  timed_out: bool = False) -> tuple[list[list[str]], list[str], int | None]:
    """(closed batches, texts still held, when the oldest of them came) after ``new`` texts came at ``now``."""
    fresh = not held
    held = held + new
    if held and (fresh or since is None):
        since = now
    closed = []
    while len(held) >= size:
        closed.append(held[:size])
        held, since = held[size:], now
    if held and (timed_out or now - since >= interval_ms):
        closed.append(held)
        held = []
    return closed, held, since if held else None


def _buffer(size: int, interval_ms: int, kind: str):
    def body(items: list[str], now: int) -> str:
        if kind == "elasticsearch":
            return "".join(items)
        return envelope_text(items, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now / 1000)))

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        text, since = state.get if state.exists else ("[]", None)
        timed_out = state.hasTimedOut
        new = [] if timed_out else sorted(v for pdf in pdfs for v in pdf["value"])
        closed, held, since = close_batches(json.loads(text), since, new, now, size, interval_ms, timed_out)
        if held:
            state.update((json.dumps(held), since))
            state.setTimeoutDuration(max(1, since + interval_ms - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"shard": [key[0]] * len(closed), "number": list(range(len(closed))),
                            "count": [len(c) for c in closed], "body": [body(c, now) for c in closed]})
    return run


def buffered_requests(events: DataFrame, spec: OutputSpec, interval_ms: int, shards: int = 1) -> DataFrame:
    """(shard, number, count, body): the requests that each micro-batch closes."""
    ship_package(events.sparkSession)
    if spec.type == "elasticsearch":
        texts, size = bulk_texts(events, spec.index), spec.buffer_size if spec.buffer_size > 0 else 1000
    else:
        texts, size = events.select(event_json().alias("value")), spec.batch_size if spec.batch_size > 0 else 50
    dealt = texts.select(F.pmod(F.xxhash64("value"), F.lit(shards)).cast("int").alias("shard"), "value")
    return dealt.groupBy("shard").applyInPandasWithState(
        _buffer(size, interval_ms, spec.type), REQUESTS, "items string, since long", "append",
        GroupStateTimeout.ProcessingTimeTimeout)
