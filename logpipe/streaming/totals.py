"""A1 and A2 of a stream as tables that outlive it.

Both are keyed by micro-batch, so a batch that is replayed replaces what it
wrote before, and a restarted stream goes on from the last batch.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logpipe.functions.notes import Notes
from logpipe.operators.stats import KEEP, counter_columns, interval_counts

#: Batches whose totals are kept.
KEPT_BATCHES = 100
COUNTS = ("processed", "dropped", "kept", "errored")
NOTHING = dict.fromkeys(COUNTS, 0) | {"latest": None}


@dataclass(frozen=True)
class Totals(Notes):
    """Running totals after each batch: ``COUNTS`` and ``latest``, the largest timestamp in microseconds.

    ``errored`` are the failed writes, those of attempts that were replayed
    included.
    """

    def before(self, batch_id: int) -> dict:
        """The totals of all batches before one."""
        earlier = [n for n in self._batches() if n < batch_id]
        return dict(NOTHING) if not earlier else {k: v for k, v in self.get(self._name(max(earlier))).items() if k in NOTHING}

    def add(self, batch_id: int, counts: dict, errors: int = 0, failed: bool = False) -> dict:
        """Note a batch's counts, or only its errors if it ``failed`` and will be replayed; the new totals."""
        before, again = self.before(batch_id), self.get(self._name(batch_id)) or {}
        tried = again.get("tried", 0) if again.get("failed") else 0
        if failed:
            self.put(self._name(batch_id), before | {"batch_id": batch_id, "failed": True, "tried": tried + errors})
            return before
        now = {k: before[k] + counts.get(k, 0) for k in COUNTS}
        now["errored"] += tried + errors
        now["latest"] = max((x for x in (before["latest"], counts.get("latest")) if x is not None), default=None)
        self.put(self._name(batch_id), now | {"batch_id": batch_id, "failed": False, "tried": 0})
        for old in [n for n in self._batches() if n <= batch_id - KEPT_BATCHES]:
            self.delete(self._name(old))
        return now

    def last(self) -> dict:
        """The totals of all batches that were not given up."""
        done = [t for t in (self.get(self._name(n)) for n in sorted(self._batches(), reverse=True)[:2]) if not t["failed"]]
        return {k: (done[0] if done else NOTHING)[k] for k in COUNTS}

    def _batches(self) -> list[int]:
        return [int(m[1]) for m in (re.fullmatch(r"batch-(\d+)\.json", n) for n in self.names("")) if m]

    @staticmethod
    def _name(batch_id: int) -> str:
        return f"batch-{batch_id}.json"


def batch_counts(flagged: DataFrame) -> dict:
    """A1 of one batch, and its largest timestamp."""
    row = flagged.agg(*counter_columns(), F.count_if(F.col(KEEP)).alias("kept"),
                      F.max(F.unix_micros("timestamp")).alias("latest")).first()
    return row.asDict()


def totals_table(spark: SparkSession, root: str) -> DataFrame:
    """The totals after each of the last batches."""
    return spark.read.schema("batch_id long, processed long, dropped long, kept long, errored long, failed boolean") \
        .json(f"{root.rstrip('/')}/batch-*.json").where("not failed").drop("failed")


@dataclass(frozen=True)
class Windows:
    """A2 below ``root``: each batch's counts, now and then added up.

    A line behind the watermark (``delay`` before the largest timestamp of
    earlier batches) is counted as late in its own window.
    """
    spark: SparkSession
    root: str
    interval: str = "30 seconds"
    delay: str = "10 minutes"
    #: Batches after which their tables are added up into one.
    every: int = 200

    def add(self, flagged: DataFrame, batch_id: int, latest: int | None) -> None:
        if batch_id <= self._parts()[0]:
            return  # added up already
        before = None
        if latest is not None:
            before = F.timestamp_micros(F.lit(latest)) - F.expr(f"interval {self.delay}")
        arrived = F.lit(dt.datetime.now(dt.timezone.utc))
        counts = interval_counts(flagged, self.interval, before, arrived)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        until, batches = self._parts()
        if len(batches) >= self.every:
            self._add_up(until, batches)

    def _add_up(self, until: int, batches: list[int]) -> None:
        # the last batch may yet be replayed and stays as it is
        *settled, _ = batches
        self._sum(until, settled).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/until={settled[-1]}")
        for name in [f"until={until}", *(f"batch={n}" for n in settled)]:
            self._fs().delete(self._path(name), True)

    def _sum(self, until: int, batches: list[int]) -> DataFrame:
        paths = [f"{self.root}/until={until}"] * (until >= 0) + [f"{self.root}/batch={n}" for n in batches]
        kind = ("window_start timestamp, window_end timestamp, source string, basis string, "
                "processed long, dropped long, kept long")
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.groupBy("window_start", "window_end", "source", "basis").agg(
            *(F.sum(c).alias(c) for c in ("processed", "dropped", "kept")))

    def table(self) -> DataFrame:
        """One row per window, source and basis."""
        return self._sum(*self._parts())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _parts(self) -> tuple[int, list[int]]:
        """(last batch that is added up or -1, the later batches); unfinished folders do not count."""
        fs, out = self._fs(), {"until": [-1], "batch": []}
        if fs.exists(self._path()):
            for f in fs.listStatus(self._path()):
                m = re.fullmatch(r"(until|batch)=(\d+)", f.getPath().getName())
                if m and fs.exists(self._path(f"{m[0]}/_SUCCESS")):
                    out[m[1]].append(int(m[2]))
        until = max(out["until"])
        return until, sorted(n for n in out["batch"] if n > until)
