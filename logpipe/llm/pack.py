"""Best-fit packing of tokenised documents by minimum bin slack.

Only the number of pieces of each length matters for the packing, so it is
planned on the length histogram (at most ``capacity`` entries, whatever the
data).  Each bin starts from the largest length left and is filled as far as
any combination can by a subset-sum over the lengths still available, kept as
bits of one whole number.  A combination is used as often as its lengths last
before the next is sought.  The pieces themselves never leave Spark: each is
ranked within its length and finds its bin from the rank.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, schema, store
from logpipe.llm.vocabulary import is_plain, library, merges, plain_splitter

#: Words remembered by a worker before it starts afresh.
REMEMBERED = 400_000
#: Mean pieces of one length that are ranked together.
RANK_ROWS = 500
#: How the word vocabulary's splitter cuts a lower-cased text.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_split = plain_splitter(WORD)


@lru_cache(maxsize=4)
def _memory(path: str) -> dict[str, bytes]:
    """Ids of words a worker knows; it lasts from task to task."""
    return {}


def token_ids(text: str | None, path: str) -> bytes:
    """The text's ids as little-endian 32-bit numbers, without added tokens.

    Texts of plain Latin characters are cut into words here; the ids of words
    are remembered by a worker, within bounds.  Any other text, and any that
    could hold a special string, is encoded by the library as a whole.
    """
    if not text:
        return b""
    if "<|" in text or not is_plain(text) or not merges(path).usable:
        return np.array(library(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    words, memory = _split(text.lower()), _memory(path)
    got = list(map(memory.get, words))
    if None in got:
        new = {w for w, g in zip(words, got) if g is None}
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = set(words)
        new = list(new)
        ids, ends = merges(path).words(new)
        stops, raw = (4 * ends).tolist(), ids.tobytes()
        memory.update(zip(new, (raw[a:b] for a, b in zip([0, *stops], stops))))
        got = map(memory.__getitem__, words)
    return b"".join(got)


_PIECE = ("piece integer", "start long", "length long", "ids_crc32 long")


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: tokenised documents, only longer ones cut."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("t").to_pylist()):
                ids = token_ids(text, tokenizer_path) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, schema(rows.schema["doc_id"], *_PIECE))


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination with the largest length left and the least slack: length -> how many.

    ``counts`` maps available lengths to how many are left.  Bit s of a whole
    number stands for "sum s can be reached"; lengths join from the largest
    down until the bin can be filled or none is left.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        most = min(counts[length] - (length == first), room // length)
        if most <= 0:
            continue
        block, left = 1, most
        while left:  # 1, 2, 4, ... of this length, as many as there are
            take = min(block, left)
            after = (reach | reach << (take * length)) & full
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int = 4096) -> list[tuple[dict[int, int], int]]:
    """(combination, number of bins filled with it), until every length is used up."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        used = fullest(left, capacity)
        bins = min(left[length] // n for length, n in used.items())
        out.append((used, bins))
        for length, n in used.items():
            left[length] -= bins * n
            if not left[length]:
                del left[length]
    return out


def _places(planned) -> dict[str, np.ndarray]:
    """Plan rows by (length, first rank): where ranks of a length go."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for used, bins in planned:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rank = seen.get(length, 0)
            rows.append((length, rank, n, base, offset))
            seen[length] = rank + n * bins
            offset += n * length
        base += bins
    rows.sort()
    return dict(zip(("length", "rank", "n", "base", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Every document ends with ``end_id``; NULL and empty texts are that token
    alone.  Repeated rows and ids, NULL ids included, are packed as they come.
    Equal lengths are told apart by id, piece and content, then arbitrarily.
    An empty table gives an empty result; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    cut = store(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id))
    # at most ``capacity`` rows, whatever the data
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    # one length may hold a third of all pieces: its ranks are made up of many small shares
    shares = spark.createDataFrame([(length, n // RANK_ROWS + 1) for length, n in counts.items()],
                                   "length long, shares long")
    cut = cut.join(F.broadcast(shares), "length").withColumn(
        "share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "shares")).drop("shares")
    sizes = cut.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "share", (F.sum("n").over(
        Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (cut.withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "share"])
              .withColumn("rank", F.col("before") + F.col("within"))
              .select("doc_id", "piece", "start", "length", "ids_crc32", "rank"))
    wide = np.int64(1 << 48)

    def run(batches):
        p = places.value
        keys = p["length"] * wide + p["rank"]
        for b in batches:
            length, rank = (b.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            past = rank - p["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in b.schema.names[:5]),
                 pa.array(p["base"][at] + past // p["n"][at]),
                 pa.array(p["offset"][at] + past % p["n"][at] * length)],
                [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema(ranked.schema["doc_id"], *_PIECE, "sequence_id long", "offset long"))
