"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import discard, store

#: Shares that the links of one node are joined in.
SHARES = 16


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones,
    below its smallest neighbour; links become stars in about log(n) rounds.
    Only links move, never groups: a node with very many links is spread by
    pre-aggregation and by joins that adaptive execution can split.  Loops,
    repeated links and NULL ends are ignored.  Every round is written to the
    shared folder, so a lost executor repeats one round at most.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("a is not null and b is not null and a <> b").distinct())
    state = _state(edges)
    while True:
        after = store(_small_star(_large_star(edges)))
        new_state = _state(after)
        discard(edges)
        edges = after
        if new_state == state:
            break
        state = new_state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_low(edges: DataFrame) -> DataFrame:
    """Each link (u, v) with ``low``, the smallest v of its u.

    A node with very many links is joined in ``SHARES`` shares of them; its
    low is sent to the shares that it has.
    """
    dealt = edges.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SHARES)))
    low = dealt.groupBy("u").agg(F.min("v").alias("low"), F.collect_set("share").alias("shares"))
    low = low.select("u", "low", F.explode("shares").alias("share"))
    return dealt.join(low, ["u", "share"]).drop("share")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _with_low(edges.union(edges.select("v", "u")))
    return both.where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    rows = _with_low(edges)
    moved = rows.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(rows.where("v = low").select("u", "low")).distinct()
