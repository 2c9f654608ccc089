"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's ball is every value within half the permitted distance.  Two
fingerprints within the distance share at least one value of their balls, and
two that share a value are within the distance, so the members of one value
may be linked to the smallest of them: no pair is lost, none is emitted twice
over.  Values are shuffled by their leading bits: a row stands for all values
of one ball in one such region, and the region's task writes them out,
dedupes them and verifies what collides.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, schema, store, utf8
from logpipe.llm.graph import components

#: Mean rows of a region, and ball values held at once by its task.
REGION_ROWS = 2000
VALUES_AT_ONCE = 1 << 21
#: Shingle hashes turned into bits at once.
HASHES_AT_ONCE = 1 << 14


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included.

    Words are runs of anything but ASCII white space after lower-casing A-Z.
    A text of fewer words is one shingle, a text without words gives 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
    size = min(shingle, len(words))
    h64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(joined[s:e], 42) for s, e in zip(starts, ends[size - 1:])),
                         np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[i:i + HASHES_AT_ONCE].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8)).reshape(-1, 64)
        ones += (np.ones(len(bits), np.float32) @ bits.astype(np.float32)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 4) -> DataFrame:
    """(id, text_hash, fp) per row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                       utf8(text_col).alias("t"))
    return rows.mapInArrow(run, schema(rows.schema["id"], "text_hash long", "fp long"))


@lru_cache(maxsize=256)
def _masks(width: int, flips: int) -> np.ndarray:
    """Every mask of at most ``flips`` ones in the ``width`` lowest bits."""
    return np.array([sum(1 << b for b in bits) for k in range(flips + 1)
                     for bits in combinations(range(width), k)], np.uint64)


def _region_links(fp: np.ndarray, used: np.ndarray, depth: int, radius: int, distance: int):
    """Pairs (index, smaller index) of fingerprints that share a ball value.

    All values here agree in their first ``depth`` bits; ``used`` counts the
    bits that a fingerprint has already flipped for that.  Regions with too
    many values are halved by their next bit.
    """
    if len(fp) < 2:
        return
    width = 64 - depth
    left = radius - used
    n_values = sum(int((left == r).sum()) * len(_masks(width, r)) for r in range(radius + 1))
    if n_values > VALUES_AT_ONCE and depth < 56:
        bit = (fp["fp"] >> np.uint64(63 - depth)) & np.uint64(1)
        for side in (0, 1):
            now = used + (bit != side)
            keep = now <= radius
            yield from _region_links(fp[keep], now[keep], depth + 1, radius, distance)
        return
    low = fp["fp"] & np.uint64((1 << width) - 1)
    values, owners = [], []
    for r in range(radius + 1):
        own = np.flatnonzero(left == r)
        masks = _masks(width, r)
        values.append((low[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    ranked = np.sort(value)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(again):
        return
    at = np.minimum(np.searchsorted(again, value), len(again) - 1)
    hit = again[at] == value
    owner, at = owner[hit], at[hit]
    order = np.lexsort((owner, at))
    owner, at = owner[order], at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    head = owner[np.repeat(first, np.diff(np.r_[first, len(at)]))]
    near = (owner != head) & (np.bitwise_count(fp["fp"][owner] ^ fp["fp"][head]) <= distance)
    yield fp["at"][owner[near]], fp["at"][head[near]]


def _forest(n: int, pairs) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over ``pairs``."""
    root = np.arange(n)
    ends = [np.unique(a.astype(np.int64) * n + b) for a, b in pairs]
    if ends:
        both = np.unique(np.concatenate(ends))
        a, b = both // n, both % n
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            np.minimum.at(root, before[a], low)
            np.minimum.at(root, before[b], low)
            root = root[root]
            if (root == before).all():
                break
    return root


def near_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b), b < a, that join all fingerprints within ``distance`` bits.

    ``fps(fp long)`` holds distinct fingerprints.  The links are enough to
    reach everything reachable, not all pairs.  ``distance`` must be even:
    only then do the halves meet exactly.
    """
    if distance % 2 or not 0 <= distance <= 8:
        raise ValueError("distance must be even and at most 8")
    radius, n = distance // 2, fps.count()
    bits = 6
    while bits < 40 and n * _n_masks(bits, radius) / 2 ** bits > REGION_ROWS:
        bits += 2
    flips = F.array(*[F.lit(int(m)) for m in _masks(bits, radius)])
    prefix = F.shiftrightunsigned("fp", 64 - bits)
    rows = fps.select("fp", F.explode(F.transform(flips, lambda m: prefix.bitwiseXOR(m))).alias("region"))

    def run(t: pa.Table) -> pa.Table:
        fp = np.sort(t.column("fp").to_numpy().view(np.uint64))
        region = np.uint64(t.column("region")[0].as_py())
        rec = np.zeros(len(fp), [("fp", np.uint64), ("at", np.int64)])
        rec["fp"], rec["at"] = fp, np.arange(len(fp))
        used = np.bitwise_count((fp >> np.uint64(64 - bits)) ^ region).astype(np.int64)
        root = _forest(len(fp), _region_links(rec, used, bits, radius, distance))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

    return rows.groupBy("region").applyInArrow(run, "a long, b long").distinct()


def _n_masks(width: int, flips: int) -> int:
    n, term = 1, 1
    for k in range(1, flips + 1):
        term = term * (width - k + 1) // k
        n += term
    return n


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, fp, component_id.

    ``component_id`` is the smallest id reachable over fingerprints at most
    ``distance`` bits apart.  NULL texts count as empty (fingerprint 0); NULL
    ids are never the smallest unless nothing else is reachable (then NULL).
    Repeated rows give repeated results, an empty table an empty one; other
    columns are not read, whatever their names.
    """
    rows = store(fingerprints(docs, id_col, text_col, shingle))
    fps = store(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(near_links(fps.select("fp"), distance))
    classes = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = classes.join(least, "root").select("fp", "component_id", "root")
    return rows.join(known, "fp").select("id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: its smallest id.

    Of equal ids with different texts the smaller text hash stays; of exactly
    repeated rows one.  All columns are returned as they came.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, distance)
    kept = groups.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("k"))
    kept = kept.select("k.id", "k.text_hash").distinct()
    # the document stays in one piece: its columns may be called anything
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"))
    near = rows["own_id"].eqNullSafe(kept["id"]) & (rows["own_hash"] == kept["text_hash"])
    return rows.join(kept, near, "left_semi").dropDuplicates(["own_id", "own_hash"]).select("doc.*")


def hex_fingerprint(fp="fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
