"""Delivery batches of at most ``batch_size`` events (bulk and webhook sinks).

Two deterministic strategies, neither of which funnels rows through one task:

* ``assign_batches`` (hash): rows are spread over ``buckets`` by a hash of the
  order key (a hot source is split like any other), numbered inside each
  bucket and cut every ``batch_size`` rows.  One shuffle; the batch grouping
  reuses its partitioning.
* ``assign_global_batches`` (global order): consecutive runs of ``batch_size``
  rows in the global order of a unique key, as one ordered buffer would cut
  them.  The rows are written once; sizes and places are found on the key
  column alone, and the rows then go to ranges of the key that begin and end
  with a batch.  One shuffle of the rows, whose number of ranges follows
  from their count; the batch grouping reuses its partitioning.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logpipe.session import write_once

BUCKET, BATCH, SEQ = "_bucket", "_batch", "_seq"
#: Rows of one key range of global batches; more where there would be over ``MOST_RANGES``, whose ends the driver holds.
RANGE_ROWS = 50_000
MOST_RANGES = 20_000
_FAN = 16  # branches of a node in the search for a key's range


def default_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def assign_batches(df: DataFrame, batch_size: int, order_by: list[str],
                   buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``, ``_batch`` (0-based within the bucket) and ``_seq`` (position in batch)."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    n = buckets or default_buckets(df)
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in order_by]), F.lit(n))
    w = Window.partitionBy(BUCKET).orderBy(*[F.col(c) for c in order_by])
    rn = F.row_number().over(w) - 1
    return (df.withColumn(BUCKET, bucket.cast("bigint"))
              .withColumn("_rn", rn)
              .withColumn(BATCH, F.floor(F.col("_rn") / F.lit(batch_size)).cast("bigint"))
              .withColumn(SEQ, (F.col("_rn") % F.lit(batch_size)).cast("int"))
              .drop("_rn"))


def _add_range(df: DataFrame, key: str, bounds: list) -> DataFrame:
    """Add ``_range``: how many of the sorted ``bounds`` are below the key.

    A search tree of ``_FAN`` branches a node: each level counts the node's
    separators below the key, taken from one literal array per level, so the
    expressions hardly grow with the number of ranges.
    """
    levels = 1
    while _FAN ** levels <= len(bounds):
        levels += 1
    kind = df.schema[key].dataType.simpleString()
    at = F.lit(0)
    for level in range(levels):
        span = _FAN ** (levels - level - 1)  # ranges below each branch
        places = [node * span * _FAN + j * span - 1 for node in range(_FAN ** level) for j in range(1, _FAN)]
        text = json.dumps([bounds[p] if p < len(bounds) else None for p in places], default=str)
        separators = F.from_json(F.lit(text), f"array<{kind}>")
        below = F.lit(0)
        for j in range(1, _FAN):
            above = F.col(key) > F.get(separators, at * (_FAN - 1) + (j - 1))
            below = below + F.coalesce(above.cast("int"), F.lit(0))
        df = df.withColumn("_range", at * _FAN + below)
        at = F.col("_range")
    return df


def assign_global_batches(df: DataFrame, batch_size: int, order_by: list[str],
                          partitions: int | None = None) -> DataFrame:
    """Add ``_bucket`` (the key range), ``_batch`` = global position div ``batch_size`` and ``_seq``.

    ``df`` is evaluated once, into the shared checkpoint folder; ranges have
    ``RANGE_ROWS`` rows, or there are about ``partitions`` of them.  The (unique,
    orderable) key's approximate quantiles split its column for counting; the
    exact keys that end every range are then collected: as many as there are
    ranges, not as the data has rows.  Every later step is a deterministic
    function of the key, so a recomputed task lands its rows in the same
    range and position.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if len(order_by) != 1:
        raise ValueError("global batching orders by one unique column")
    key, rows = order_by[0], write_once(df)
    n = rows.count()
    per_range = -(-n // partitions) if partitions else max(RANGE_ROWS, -(-n // MOST_RANGES))
    per_range = max(1, per_range // batch_size) * batch_size
    ranges = -(-n // per_range)
    bounds = _range_ends(rows.select(key), key, per_range, ranges) if ranges > 1 else []
    pos = F.row_number().over(Window.partitionBy(BUCKET).orderBy(key)) - 1
    ranged = _add_range(rows, key, bounds)
    placed = ranged.withColumn(BUCKET, F.col("_range").cast("bigint")).drop("_range").withColumn("_pos", pos)
    rank = F.col(BUCKET) * per_range + F.col("_pos")
    return (placed.withColumn(BATCH, F.floor(rank / F.lit(batch_size)).cast("bigint"))
                  .withColumn(SEQ, (F.col("_pos") % F.lit(batch_size)).cast("int")).drop("_pos"))


def _range_ends(keys: DataFrame, key: str, per_range: int, ranges: int) -> list:
    """The keys at the last place of every range but the last."""
    probs = [i / ranges for i in range(1, ranges)]
    got = keys.agg(F.percentile_approx(key, probs, max(10_000, 20 * ranges)).alias("q")).first()["q"]
    near = _add_range(keys, key, sorted(set(v for v in (got or []) if v is not None)))
    sizes = near.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) + F.col("_off")
    ends = near.join(F.broadcast(offsets), "_range").withColumn("_place", place).where(F.col("_place") % per_range == 0)
    return [r[0] for r in ends.orderBy("_place").select(key).limit(ranges - 1).collect()]


def collect_batches(batched: DataFrame, payload_col: str, extra_aggs: list[Column] = ()) -> DataFrame:
    """One row per batch: payloads in order (each group holds at most ``batch_size`` rows)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(SEQ), F.col(payload_col).alias("p"))))
    return (batched.groupBy(BUCKET, BATCH)
                   .agg(F.count(F.lit(1)).alias("count"), ordered.alias("_items"), *extra_aggs)
                   .withColumn("payloads", F.col("_items.p"))
                   .drop("_items"))
