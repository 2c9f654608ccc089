"""Payload tables: what each sink sends, as DataFrames.

Building the payload is ordinary column work; only the network call (see
``deliver``) runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpipe.functions.encode import event_json, event_json_pretty, index_name
from logpipe.functions.scalars import source_or_empty
from logpipe.functions.timestamps import format_rfc3339
from logpipe.operators import fields
from logpipe.operators.batching import (
    BATCH, BUCKET, assign_batches, assign_global_batches, collect_batches,
)

DEFAULT_TOPIC = "logs"
#: The webhook body; names stand for the count, the events' JSON texts and the time.
ENVELOPE = ('{"count":', "count", ',"events":[', "events", '],"sent_at":"', "sent_at", '"}')
DEFAULT_BULK_BUFFER = 1000
DEFAULT_WEBHOOK_BATCH = 50


def console_payload(events: DataFrame) -> DataFrame:
    """O1: one indented JSON document per event."""
    return events.select(event_json_pretty().alias("value"))


def jsonl_payload(events: DataFrame) -> DataFrame:
    """O2: one compact JSON line per event."""
    return events.select(event_json().alias("value"))


def bulk_payload(events: DataFrame, index_pattern: str | None = None, keep: list[str] = ()) -> DataFrame:
    """O3: ``_index``, the action line and the document (with ``@timestamp``)."""
    idx = index_name(index_pattern, F.col("timestamp"))
    action = F.to_json(F.struct(F.struct(idx.alias("_index")).alias("index")))
    doc = event_json(extra={"@timestamp": F.when(F.col("timestamp").isNotNull(),
                                                 format_rfc3339(F.col("timestamp")))})
    return events.select(*keep, idx.alias("_index"), action.alias("action"), doc.alias("doc"))


def bulk_lines(payload: DataFrame) -> DataFrame:
    """NDJSON body lines: action, document, action, document, ..."""
    return payload.select(F.explode(F.array("action", "doc")).alias("value"))


def kafka_payload(events: DataFrame, topic: str | None = None, keep: list[str] = ()) -> DataFrame:
    """``key`` = source (``""`` when absent), ``value`` = event JSON, ``topic``."""
    return events.select(*keep, source_or_empty(fields.get_string("source")).alias("key"),
                         event_json().alias("value"),
                         F.lit(topic or DEFAULT_TOPIC).alias("topic"))


def envelope_text(events: list[str], sent_at: str) -> str:
    """The body that carries these events."""
    parts = {"count": str(len(events)), "events": ",".join(events), "sent_at": sent_at}
    return "".join(parts.get(x, x) for x in ENVELOPE)


def sent_at() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def webhook_batches(events: DataFrame, batch_size: int = DEFAULT_WEBHOOK_BATCH,
                    order_by: list[str] | None = None, buckets: int | None = None,
                    global_order: bool = False) -> DataFrame:
    """One row per batch of at most ``batch_size`` events with its envelope text.

    ``order_by`` fixes the order inside batches (default: the rendered event
    itself, so the result is deterministic).  ``global_order=True`` cuts
    consecutive runs of the global order (``order_by`` must be unique), for
    which the events are rendered once, when this is called; otherwise rows
    are batched inside hash buckets.
    """
    rendered = events.withColumn("_event", event_json())
    order = order_by or ["_event"]
    if global_order:
        batched = assign_global_batches(rendered.select(*dict.fromkeys(order + ["_event"])), batch_size, order, buckets)
    else:
        batched = assign_batches(rendered, batch_size, order, buckets)
    first_last = [F.min(F.struct(*[F.col(c) for c in order])).alias("_first"),
                  F.max(F.struct(*[F.col(c) for c in order])).alias("_last")]
    out = collect_batches(batched, "_event", first_last)
    count, events, stamp = F.col("count").cast("string"), F.array_join("payloads", ","), sent_at()
    parts = {"count": count, "events": events, "sent_at": stamp}
    envelope = F.concat(*[parts[x] if x in parts else F.lit(x) for x in ENVELOPE])
    return out.select(F.col(BUCKET).alias("bucket"), F.col(BATCH).alias("batch"), "count",
                      "_first", "_last", envelope.alias("body"))
