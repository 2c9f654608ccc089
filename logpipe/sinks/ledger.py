"""What has been delivered, kept in a shared folder so that a replay does not send it again.

For each sink and batch there is a folder with one small file for every
request that was answered (``<task>/<chunk>``), read by the task that is about
to send the same chunk, and a ``done`` file once the whole sink has the batch.
A chunk is named by its place and a digest of its content, so a chunk that
comes out differently in a replay is a new one.  Only the last batch can be
replayed: older folders are deleted.
"""

from __future__ import annotations

import hashlib

from logpipe.functions.notes import Notes


class Ledger(Notes):
    """What the sinks have of each batch."""

    # ------------------------------------------------------------ requests
    def answered(self, sink: str, batch: str, task: str) -> dict[str, list[int]]:
        """Chunk -> positions of its items that were not accepted yet, for the chunks of one task that were answered."""
        folder = f"{sink}/{batch}/{task}"
        return {name: self.get(f"{folder}/{name}") or [] for name in self.names(folder)}

    def answered_one(self, sink: str, batch: str, task: str, chunk: str) -> list[int] | None:
        """The same for one chunk; None if it was not answered."""
        return self.get(f"{sink}/{batch}/{task}/{chunk}")

    def answer(self, sink: str, batch: str, task: str, chunk: str, left: list[int]) -> None:
        self.put(f"{sink}/{batch}/{task}/{chunk}", left)

    # ------------------------------------------------------------ sinks
    def summarise(self, sink: str, batch: str, totals: dict) -> None:
        self.put(f"{sink}/{batch}/summary", totals)

    def summary(self, sink: str, batch: str) -> dict | None:
        return self.get(f"{sink}/{batch}/summary")

    def finish(self, sink: str, batch: str) -> None:
        self.put(f"{sink}/{batch}/done", True)

    def done(self, sink: str, batch: str) -> bool:
        return bool(self.get(f"{sink}/{batch}/done"))

    def forget(self, sink: str, batch: str | None = None, before: int | None = None) -> None:
        """Delete a batch's folder, or all of batches numbered below ``before``."""
        names = [batch] if batch is not None else [n for n in self.names(sink) if n.isdigit() and int(n) < before]
        for name in names:
            self.delete(f"{sink}/{name}")


def chunk_name(number: int, items: list[str]) -> str:
    digest = hashlib.sha1()
    for item in items:
        digest.update(item.encode("utf-8", "surrogatepass"))
        digest.update(b"\0")
    return f"{number:08d}-{digest.hexdigest()[:16]}"
