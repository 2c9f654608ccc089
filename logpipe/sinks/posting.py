"""One HTTP request with its retries.

A transport is a picklable callable
``(method, url, body: bytes, headers: dict, timeout: float) -> (status, text)``
so tests inject a fake one (no port is opened).
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

Transport = Callable[[str, str, bytes, dict, float], tuple[int, str]]
DEFAULT_TIMEOUT = 30.0
DEFAULT_RETRY_MAX = 3


def http_transport(method: str, url: str, body: bytes, headers: dict, timeout: float) -> tuple[int, str]:
    req = urllib.request.Request(url, data=body, method=method, headers=headers)
    try:
        with urllib.request.urlopen(req, timeout=timeout) as resp:
            return resp.status, resp.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def send_with_retry(transport: Transport, url: str, body: bytes, headers: dict,
                    retry_max: int = DEFAULT_RETRY_MAX, timeout: float = DEFAULT_TIMEOUT,
                    sleep: Callable[[float], None] = time.sleep) -> tuple[bool, int, str | None, str]:
    """Attempts 0..retry_max, sleeping 2^attempt s before each retry; status >= 400 fails.

    Returns ``(ok, attempts, error, last_reply_text)``.
    """
    last_err, text = None, ""
    for attempt in range(retry_max + 1):
        if attempt > 0:
            sleep(float(2 ** attempt))
        try:
            status, text = transport("POST", url, body, headers, timeout)
        except Exception as e:  # network error
            last_err = f"{type(e).__name__}: {e}"
            continue
        if status < 400:
            return True, attempt + 1, None, text
        last_err = f"HTTP {status}: {text[:200]}"
    return False, retry_max + 1, last_err, text


def rejected_items(text: str, n: int) -> tuple[list[int], list[int]]:
    """(positions worth retrying, positions rejected for good) of a bulk reply to ``n`` items.

    An item may be retried when the server was busy or failed (429, 5xx).
    """
    try:
        reply = json.loads(text) if text else {}
    except ValueError:
        return [], []
    if not isinstance(reply, dict) or not reply.get("errors"):
        return [], []
    again, lost = [], []
    for i, item in enumerate((reply.get("items") or [])[:n]):
        result = next((v for v in (item or {}).values() if isinstance(v, dict)), {})
        status = result.get("status")
        if result.get("error") or isinstance(status, int) and status >= 400:
            busy = isinstance(status, int) and (status == 429 or status >= 500)
            (again if busy else lost).append(i)
    return again, lost


def post_bulk(items: list[str], transport: Transport, url: str, headers: dict, retry_max: int,
              timeout: float = DEFAULT_TIMEOUT, sleep: Callable[[float], None] = time.sleep,
              ) -> tuple[int, int, list[int], str | None, bool]:
    """(attempts, items refused for good, positions of items that may yet succeed, error, whether any post was answered).

    Only items that may yet succeed are posted again.
    """
    lost, err, answered, waiting = 0, None, False, list(range(len(items)))
    for attempt in range(retry_max + 1):
        if attempt > 0:
            sleep(float(2 ** attempt))
        try:
            status, text = transport("POST", url, "".join(items[i] for i in waiting).encode(), headers, timeout)
        except Exception as e:  # network error
            err = f"{type(e).__name__}: {e}"
            continue
        if status >= 400:
            err = f"HTTP {status}: {text[:200]}"
            continue
        answered = True
        again, gone = rejected_items(text, len(waiting))
        lost += len(gone)
        if again or gone:
            err = f"bulk: {len(again) + lost} item(s) rejected"
        waiting = [waiting[i] for i in again]
        if not waiting:
            return attempt + 1, lost, [], err, True
    return retry_max + 1, lost, waiting, err, answered


def send_bulk(items: list[str], transport: Transport, url: str, headers: dict, retry_max: int,
              timeout: float = DEFAULT_TIMEOUT,
              sleep: Callable[[float], None] = time.sleep) -> tuple[int, int, str | None]:
    """(attempts, items not stored, error)."""
    attempts, lost, waiting, err, _ = post_bulk(items, transport, url, headers, retry_max, timeout, sleep)
    return attempts, lost + len(waiting), err


def bulk_headers(username: str | None = None, password: str | None = None) -> dict:
    headers = {"Content-Type": "application/x-ndjson"}
    if username:
        token = base64.b64encode(f"{username}:{password or ''}".encode()).decode()
        headers["Authorization"] = "Basic " + token
    return headers
