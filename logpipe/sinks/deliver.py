"""Deliver events over HTTP, from the executors.

Each task takes its own rows, cuts them into bodies of at most ``batch_size``
events and posts them; nothing is gathered on the driver and no shuffle is
needed.  Webhook batches in a key's order are numbered first (one shuffle).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.functions.encode import event_json
from logpipe.sinks.payloads import bulk_payload, webhook_batches
from logpipe.sinks.posting import (  # noqa: F401
    DEFAULT_RETRY_MAX, Transport, bulk_headers, http_transport, post_bulk, rejected_items, send_bulk, send_with_retry,
)
from logpipe.sinks.writers import write_http


def deliver_webhook(events: DataFrame, url: str, headers: dict | None = None, batch_size: int = 50,
                    retry_max: int = DEFAULT_RETRY_MAX, transport: Transport = http_transport,
                    sleep: Callable[[float], None] = time.sleep, order_by: str | None = None, **ledger) -> dict:
    """O5 + O8: post every event, ``batch_size`` per request, per task; in runs of the order of a unique key if given.

    Returns the totals (``writers.COUNTS``); ``ledger`` names sink and batch (see ``writers.write_http``).
    """
    if order_by:
        batches = webhook_batches(events, batch_size, [order_by], global_order=True)
        rows = batches.select("body", "count", F.concat_ws("-", "bucket", "batch").alias("name"))
        return write_http(rows, "webhook", url, headers=headers, retry_max=retry_max,
                          whole=True, transport=transport, sleep=sleep, **ledger)
    return write_http(events.select(event_json().alias("value")), "webhook", url, headers=headers,
                      batch_size=batch_size, retry_max=retry_max, transport=transport, sleep=sleep, **ledger)


def bulk_texts(events: DataFrame, index_pattern: str | None = None) -> DataFrame:
    """O3: action and document lines of every event, as one text."""
    return bulk_payload(events, index_pattern).select(F.concat("action", F.lit("\n"), "doc", F.lit("\n")).alias("value"))


def bulk_endpoint(url: str) -> str:
    return url.rstrip("/") + "/_bulk"


def deliver_bulk(events: DataFrame, url: str, index_pattern: str | None = None,
                 username: str | None = None, password: str | None = None,
                 buffer_size: int = 1000, retry_max: int = DEFAULT_RETRY_MAX,
                 transport: Transport = http_transport,
                 sleep: Callable[[float], None] = time.sleep, **ledger) -> dict:
    """O3 + O8: NDJSON bulk requests of ``buffer_size`` events, per task; returns the totals."""
    return write_http(bulk_texts(events, index_pattern), "bulk", bulk_endpoint(url),
                      headers=bulk_headers(username, password), batch_size=buffer_size, retry_max=retry_max,
                      transport=transport, sleep=sleep, **ledger)
