"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  Whole copies of a source
come first; what its budget leaves is fitted on the length counts alone, by
bounded-knapsack dynamic programming, and seeded documents are then selected
by the number wanted of each length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, store

#: What counts as a word of a document's size.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a source's budget that are left to dynamic programming.
FIT_WORDS = 1 << 16
#: Rows of one source and length that are ranked in one group.
RANK_ROWS = 200
#: Buckets that a larger group is dealt to at once.
BUCKETS = 1024
#: Rows (of at most 64 bytes) up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000

_KEY = ["src", "none", "size"]


def fit(lengths: list[int], counts: list[int], budget: int, times: int = 1) -> list[int]:
    """How many documents of each length to take so that their words come near ``budget``.

    Every length first gives its share of the budget, rounded down; then more
    of each, longest first, bring the rest below ``FIT_WORDS``, and that is
    filled as far as any bounded combination of the documents left reaches.
    Only if a rest remains may documents be taken more than once, up to
    ``times``, and at last one more whose words pass the budget by less than
    would else be missing.
    """
    total = sum(x * n for x, n in zip(lengths, counts))
    if budget >= total * times:
        return [n * times for n in counts]
    taken = [n * budget // total if x else 0 for x, n in zip(lengths, counts)]
    rest = budget - sum(x * n for x, n in zip(lengths, taken))
    order = sorted((i for i, x in enumerate(lengths) if x), key=lambda i: -lengths[i])
    for most in range(1, times + 1):
        left = {i: most * counts[i] - taken[i] for i in order}
        for i in order:
            if rest > FIT_WORDS:
                more = min(left[i], (rest - FIT_WORDS) // lengths[i] + 1, rest // lengths[i])
                taken[i] += more
                left[i] -= more
                rest -= more * lengths[i]
        if 0 < rest <= FIT_WORDS:
            for i, n in _reach([(i, lengths[i], min(left[i], rest // lengths[i])) for i in order], rest):
                taken[i] += n
                left[i] -= n
            rest = budget - sum(x * n for x, n in zip(lengths, taken))
        if not rest:
            return taken
    over = min((i for i in order if left[i]), key=lambda i: lengths[i], default=None)
    if over is not None and lengths[over] < 2 * rest:
        taken[over] += 1
    return taken


def _reach(items: list[tuple[int, int, int]], rest: int) -> list[tuple[int, int]]:
    """(index, number) of the items (index, length, number at most) that fill ``rest`` best.

    A bitset holds the sums reached; ``step`` remembers for each sum the part
    (a power of two of one length, as in binary splitting) that reached it first.
    """
    mask, reached = (1 << rest + 1) - 1, 1
    step = np.zeros(rest + 1, np.int32)
    parts: list[tuple[int, int, int]] = []
    for i, length, most in items:
        block = 1
        while most and not reached >> rest & 1:
            n = min(block, most)
            most, block = most - n, block * 2
            new = (reached << n * length) & mask & ~reached
            if new:
                parts.append((i, n, n * length))
                bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8),
                                     bitorder="little")
                step[np.flatnonzero(bits)] = len(parts)
                reached |= new
    at, out = reached.bit_length() - 1, []
    while at:
        i, n, words = parts[step[at] - 1]
        out.append((i, n))
        at -= words
    return out


def _fit_source(t: pa.Table) -> pa.Table:
    """One source's length counts with ``whole`` (copies of every document) and ``extra`` (documents once more), by length."""
    lengths, counts = t.column("size").to_pylist(), t.column("n").to_pylist()
    target, own = t.column("target")[0].as_py(), t.column("source_size")[0].as_py()
    whole = int(target // own) if own else 0
    taken = [0] * len(lengths)
    if own:
        taken = fit(lengths, counts, round(target - whole * own), max(1, t.column("most")[0].as_py() - whole))
    return (t.drop_columns(["most"]).append_column("whole", pa.array([whole + x // n for x, n in zip(taken, counts)], pa.int64()))
            .append_column("extra", pa.array([x % n for x, n in zip(taken, counts)], pa.int64())))


def _targets(sources: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """``sources(src, none, source_size)`` with ``target``.

    Weights go by rank in code-point order, NULL last; ranks are counted per
    range of the sorted table, so no task needs all sources.  What a source
    cannot take is reshared: below its limit, a target is its weight times
    one common level, and each round the level rises by what more limits free.
    """
    spark = sources.sparkSession
    ranged = store(sources.repartitionByRange(8, "none", "src").withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # one row per range
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("none", "src")) - 1 + F.col("before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = store(ranged.join(offsets, "part").withColumn("weight", weight).drop("part", "before"))
    limit = F.col("source_size") * F.lit(float(most))
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = limit < F.col("weight") * F.lit(level)
        n, fixed, free = weighed.agg(F.count_if(above), F.sum(F.when(above, limit)),
                                     F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (total - (fixed or 0.0)) / free
    return weighed.withColumn("target", F.least(limit, F.col("weight") * F.lit(level))).drop("weight")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 13,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    Sources share ``share`` times all words by ``weights`` (repeating over the
    sources in code-point order, NULL last), none above ``most`` times its own
    words.  ``copies`` is how often the mix takes a document and ``taken`` its
    words so taken, at most ``most`` times its size; copies within a source
    differ by one unless its budget can only so be met.  Sizes are numbers of
    ``WORD``; NULL and empty texts have none, are counted with
    their source and add no words.  Which of equally long documents are taken
    depends on seed, id and text alone; rows equal in these and the source are
    told apart arbitrarily.  Repeated and NULL ids are rows like any other, a
    source without words has target 0, an empty table gives an empty result;
    other columns are not read.

    A task fits one source: one row per distinct length, whose number grows at
    most with the root of the source's words.  Large groups of one source and
    length are split by the seeded hash, bucket by bucket, until the bucket
    in which the number wanted ends can be ranked.
    """
    prepare(docs.sparkSession)
    text, source = F.col(text_col), F.col(source_col)
    base = store(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("none"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"), F.monotonically_increasing_id().alias("row")))
    lengths = store(base.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("same")))
    sources = store(lengths.groupBy("src", "none").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    targets = _targets(sources, weights, share, most)
    counted = lengths.join(_small(targets), ["src", "none"]).withColumn("most", F.lit(int(most)))
    fitted = store(counted.groupBy("src", "none").applyInArrow(
        _fit_source, "src string, none boolean, size long, n long, same boolean, source_size long, target double, "
                     "whole long, extra long"))
    rows = base.join(_small(fitted), _KEY)
    # settled: 1 taken once more, 0 not, NULL not known yet
    rows = rows.withColumn("settled", F.when(F.col("extra") == 0, 0).when(F.col("extra") == F.col("n"), 1))
    groups = fitted.where(f"extra > 0 and extra < n and n > {RANK_ROWS}").select(*_KEY, "n", "same", "extra")
    level = 0
    while not groups.isEmpty():
        level += 1
        large = F.col("settled").isNull() & (F.col("n") > RANK_ROWS)
        # rows of one hash (equal in id and text) are dealt by their place in the table
        deal = F.xxhash64(F.lit(level), F.when(F.col("same"), F.col("row")).otherwise(F.col("h")))
        rows = rows.withColumn("bucket", F.when(large, F.pmod(
            deal, F.least(F.lit(BUCKETS), F.ceil(F.col("n") / RANK_ROWS)))))
        sizes = rows.where("bucket is not null").groupBy(*_KEY, "bucket", "extra").agg(
            F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("same"))
        after = F.sum("n").over(Window.partitionBy(*_KEY).orderBy("bucket"))
        edge = (sizes.withColumn("after", after).where("after >= extra and after - n < extra")
                .select(*_KEY, F.col("bucket").alias("edge"), F.col("n").alias("edge_n"), F.col("same").alias("edge_same"),
                        (F.col("extra") - F.col("after") + F.col("n")).alias("edge_extra")))
        edge = store(edge)
        b, e = F.col("bucket"), F.col("edge")
        rows = rows.join(_small(edge), _KEY, "left").withColumns({
            "settled": F.when(b < e, 1).when(b > e, 0).when((b == e) & (F.col("edge_extra") == F.col("edge_n")), 1)
            .otherwise(F.col("settled")),
            "extra": F.when(b == e, F.col("edge_extra")).otherwise(F.col("extra")),
            "same": F.when(b == e, F.col("edge_same")).otherwise(F.col("same")),
            "n": F.when(b == e, F.col("edge_n")).otherwise(F.col("n"))}).drop("bucket", "edge", "edge_n", "edge_same", "edge_extra")
        groups = edge.where(f"edge_extra < edge_n and edge_n > {RANK_ROWS}")
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy("h", "row"))
    ranked = rows.where("settled is null").withColumn("settled", (rank <= F.col("extra")).cast("int"))
    out = rows.where("settled is not null").unionByName(ranked)
    copies = F.col("whole") + F.col("settled")
    return out.select("doc_id", F.when(~F.col("none"), F.col("src")).alias("source"), "size", "source_size", "target",
                      copies.alias("copies"), (copies * F.col("size")).alias("taken"))
