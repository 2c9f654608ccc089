"""Exact top-k inner products by tiled matrix products.

Queries are broadcast in bounded blocks.  Each task multiplies a block with
its candidates, tile by tile, selects what may be among each query's best k
of a tile, and keeps every query's list over its tiles; the tasks' lists are
merged in parts, and the parts' lists into one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, store
from logpipe.llm.covertree import LONG_MAX, PLAIN_NORM, exact, norms, quantise

#: Rows of a query tile and of a candidate tile.
QUERY_TILE = 1024
CANDIDATE_TILE = 4096
#: Bytes of the vectors of a block of queries that is broadcast.
BLOCK_BYTES = 4 << 20
#: Parts in which the tasks' lists of one query are merged first.
MERGE_PARTS = 32

_FOUND = "query_id long, vec_id long, score long"


def vectors(col: pa.ChunkedArray | pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, one vector a row."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float64()))
    return quantise(col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy()), scale)


def usable(vector: str):
    """Whether a vector takes part: it is not NULL, and all its components are there and finite."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T as whole numbers, held at the ends of a long.

    Rows of moderate norm are multiplied in doubles, where no sum leaves
    2**53; products with larger rows are worked out one by one.
    """
    width = min(q.shape[1], c.shape[1])
    q_plain, c_plain = norms(q) <= PLAIN_NORM, norms(c) <= PLAIN_NORM
    if q_plain.all() and c_plain.all():
        return (q[:, :width] @ c[:, :width].T).astype(np.int64)
    out = np.zeros((len(q), len(c)), np.int64)
    out[np.ix_(q_plain, c_plain)] = (q[q_plain, :width] @ c[c_plain, :width].T).astype(np.int64)
    for i in np.flatnonzero(~q_plain):
        out[i] = exact(c, q[i]).astype(np.int64)
    for j in np.flatnonzero(~c_plain):
        out[q_plain, j] = exact(q[q_plain], c[j]).astype(np.int64)
    return out


class Lists:
    """Every query's best ``k`` (score, id) so far, higher scores and then smaller ids first."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.need = np.full(len(ids), -LONG_MAX - 1)
        self.held: list[list[tuple[int, int]]] = [[] for _ in ids]

    def add(self, first: int, score: np.ndarray, ident: np.ndarray) -> None:
        """Scores of the queries from number ``first`` on with one tile of candidates."""
        last = first + len(score)
        own = self.ids[first:last, None] == ident[None, :]
        score[own] = -LONG_MAX - 1
        need = self.need[first:last]
        if score.shape[1] > self.k:
            need = np.maximum(need, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        hit = (score >= need[:, None]) & ~own
        for r in np.flatnonzero(hit.any(1)).tolist():
            at, n = np.flatnonzero(hit[r]), first + r
            if len(at) > self.k:
                at = np.array(sorted(at.tolist(), key=lambda i: (-int(score[r, i]), ident[i]))[:self.k])
            held = sorted(self.held[n] + [(-int(score[r, i]), int(ident[i])) for i in at.tolist()])[:self.k]
            self.held[n] = held
            if len(held) == self.k:
                self.need[n] = -held[-1][0]


def _search(shared, k: int, scale: float):
    def run(batches):
        ids, q = shared.value
        lists = Lists(ids, k)
        for b in batches:
            for start in range(0, b.num_rows, CANDIDATE_TILE):
                tile = b.slice(start, CANDIDATE_TILE)
                c, ident = vectors(tile.column("v"), scale), tile.column("vec_id").to_numpy()
                for i in range(0, len(q), QUERY_TILE):
                    lists.add(i, product(q[i:i + QUERY_TILE], c), ident)
        found = [(int(ids[n]), i, -s) for n, held in enumerate(lists.held) for s, i in held]
        for at in range(0, len(found), 4096):
            query, vec, score = zip(*found[at:at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, vec, score)],
                                             ["query_id", "vec_id", "score"])
    return run


def best_of(found: DataFrame, keys: list[str], k: int, ident: str) -> DataFrame:
    """The best ``k`` rows of each key with their ``rank``; parts of the tasks' lists are merged first."""
    order = (F.desc("score"), F.asc(ident))
    parts = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order)))
    first = first.where(F.col("rank") <= k)
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("rank") <= k).drop("part"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products.

    Scores are whole numbers of floor(``scale`` * x); ties go to the smaller
    id; rows with a query's own id are no candidates for it.  Vectors that are
    NULL or hold a NULL or a component that is not finite, and rows with a
    NULL id, are left out on either side.  Every other row counts: a row that
    is repeated is as many candidates, and queries of one id share one list,
    in which each of them has its candidates.  Scores are exact; those past a
    long's range count as its end.  Short vectors are filled up with zeros.
    Fewer candidates give fewer rows, empty tables none; other columns are
    not read.
    """
    spark = prepare(queries.sparkSession)

    def side(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")) \
            .where(F.col("vec_id").isNotNull() & usable("v"))

    q, c = store(side(queries)), side(candidates)
    size = q.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    blocks = size * 8 // BLOCK_BYTES + 1
    # equal rows are dealt apart by their place in the stored table
    dealt = store(q.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))))
    paths = []
    for block in range(blocks):
        t = dealt.where(F.col("block") == block).toArrow()  # about BLOCK_BYTES
        if t.num_rows:
            shared = spark.sparkContext.broadcast((t.column("vec_id").to_numpy(), vectors(t.column("v"), scale)))
            paths.append(store(c.mapInArrow(_search(shared, k, scale), _FOUND)).stored_path)
            shared.unpersist()
    found = spark.read.schema(_FOUND).parquet(*paths) if paths else spark.createDataFrame([], _FOUND)
    return best_of(found, ["query_id"], k, "vec_id").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
