"""Exact substring dedup by run-compressed Burrows-Wheeler indexes.

Every string of ``least`` bytes has an anchor, the place in it whose hash of
32 bytes is smallest, so equal strings have equal anchors at equal places.
Consecutive strings with one anchor form a segment.  Segments meet only those
of the same anchor hash: those of an anchor found once are unique, equal
segments are repeated as a whole, and what differs around a shared anchor is
indexed together (see ``rlbwt``), which shows the repeated part to the byte.
An anchor with very many different segments is split, by narrower and
narrower ranges of places, before it is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, schema, store, utf8
from logpipe.llm.rlbwt import _words, repeats

#: Bytes hashed at an anchor.
GRAM = 32
#: Bytes of text searched for anchors together.
ANCHOR_BYTES = 1 << 18
#: Mean bytes of segments indexed together.
INDEX_BYTES = 1 << 20
#: Different segments of one anchor beyond which it is split.
HOT_SEGMENTS = 4096
#: Rows (of 16 bytes) up to which a side of a join is broadcast.
BROADCAST_ROWS = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ROW = ("anchor long", "digest long", "key long", "size integer", "start integer", "last integer", "place integer",
        "n long")


def _gram_hashes(raw: bytes) -> np.ndarray:
    w = _words(raw)
    m = len(raw) - GRAM + 1
    h = w[:m] * _MIX[0]
    for j in (1, 2, 3):
        h += w[8 * j:8 * j + m] * _MIX[j]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    filled = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    filled[:n] = v
    blocks = filled.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def segments(texts: list[bytes], least: int):
    """(text number, anchor hash, anchor place, first start, last start) of all segments, as arrays.

    ``ANCHOR_BYTES`` (< 2**24) of texts are searched together; longer texts in overlapping parts.
    """
    parts = []  # (text, offset in it, bytes)
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - least + 1), ANCHOR_BYTES):
            parts.append((i, at, t[at:at + ANCHOR_BYTES + least - 1]))
    k = 0
    while k < len(parts):
        upto, size = k, 0
        while upto < len(parts) and (upto == k or size + len(parts[upto][2]) <= 2 * ANCHOR_BYTES):
            size += len(parts[upto][2])
            upto += 1
        group = parts[k:upto]
        k = upto
        raw = b"".join(p[2] for p in group)
        lengths = np.array([len(p[2]) for p in group], np.int64)
        ends = np.cumsum(lengths)
        h = _gram_hashes(raw)
        keyed = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_min(keyed, least - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        own_end = np.repeat(ends, lengths)[:len(anchor)]
        starts = np.flatnonzero(np.arange(len(anchor)) + least <= own_end)
        a = anchor[starts]
        change = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        first, last = starts[change], starts[np.r_[change[1:], len(starts)] - 1]
        owner = np.searchsorted(ends, first, "right")
        shift = np.array([p[1] for p in group], np.int64)[owner] - np.r_[0, ends[:-1]][owner]
        text = np.array([p[0] for p in group], np.int64)[owner]
        yield text, h[a[change]].view(np.int64), a[change] + shift, first + shift, last + shift


def _segment_rows(least: int):
    def run(batches):
        for b in batches:
            keys, sizes, n, texts = _distinct(b)
            cols = [[] for _ in _ROW]
            for text, anchor, place, first, last in segments(texts, least):
                digest = np.fromiter(
                    (xxhash.xxh64_intdigest(texts[t][a:z], 1) for t, a, z in
                     zip(text.tolist(), first.tolist(), (last + least).tolist())), np.uint64, len(text)).view(np.int64)
                for c, v in zip(cols, (anchor, digest, keys[text], sizes[text], first, last, place - first, n[text])):
                    c.append(v)
            yield _table(cols)

    def _distinct(b):
        seen: dict[int, int] = {}
        rows, n = [], []
        for i, key in enumerate(b.column("key").to_pylist()):
            at = seen.setdefault(key, len(rows))
            if at == len(rows):
                rows.append(i)
                n.append(0)
            n[at] += 1
        b = b.take(pa.array(rows, pa.int64()))
        return (b.column("key").to_numpy(), b.column("size").to_numpy(), np.array(n, np.int64),
                b.column("t").to_pylist())

    def _table(cols):
        kinds = [pa.int64() if f.endswith("long") else pa.int32() for f in _ROW]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c) if c else np.array([], np.int64)).cast(k) for c, k in zip(cols, kinds)],
            [f.split()[0] for f in _ROW])

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_BODY = ("anchor long", "key long", "size integer", "start integer", "last integer", "place integer", "n long",
         "body binary")


def _bodies(least: int):
    """Bytes of the wanted segments of each text, once per text and task."""
    def run(batches):
        done = set()
        for b in batches:
            out = [[] for _ in _BODY]
            for key, size, text, wanted in zip(*(b.column(c).to_pylist() for c in ("key", "size", "t", "wanted"))):
                if (key, size) in done:
                    continue
                done.add((key, size))
                for w in wanted:
                    row = (w["anchor"], key, size, w["start"], w["last"], w["place"], w["n"],
                           text[w["start"]:w["last"] + least])
                    for c, v in zip(out, row):
                        c.append(v)
            yield _body_batch(out)
    return run


def _body_batch(cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "integer": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, _BODY)],
                                      [f.split()[0] for f in _BODY])


def _index(least: int):
    """Covered spans, in their texts, of the single segments that are indexed together."""
    def run(t: pa.Table) -> pa.Table:
        seen, rows = set(), []
        for i, k in enumerate(zip(*(t.column(c).to_pylist() for c in ("key", "size", "start", "anchor")))):
            if k not in seen:
                seen.add(k)
                rows.append(i)
        t = t.take(pa.array(rows, pa.int64()))
        found = repeats(t.column("body").to_pylist(), least)
        out = [(key, size, start + a, start + z) for key, size, start, n, spans in zip(
            *(t.column(c).to_pylist() for c in ("key", "size", "start", "n")), found) if n == 1 for a, z in spans]
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(
            (("key", pa.int64()), ("size", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())))})
    return run


def _narrow(least: int, step: int):
    """Each row cut at multiples of ``step`` places before its anchor, keyed by the bytes its strings share."""
    def run(batches):
        for b in batches:
            out = [[] for _ in _BODY]
            for anchor, key, size, start, last, place, n, body in zip(*(b.column(f.split()[0]).to_pylist()
                                                                         for f in _BODY)):
                back = place  # how far before the anchor the current string starts
                at = start
                while at <= last:
                    low = back // step * step
                    upto = min(last, at + back - low)
                    high = low + step - 1
                    core = body[place - low:place - high + least]
                    group = xxhash.xxh64_intdigest(core, (step << 32) + low) ^ (anchor & (1 << 64) - 1)
                    row = (group - (1 << 63), key, size, at, upto, back, n, body[at - start:upto - start + least])
                    for c, v in zip(out, row):
                        c.append(v)
                    back -= upto + 1 - at
                    at = upto + 1
            yield _body_batch(out)
    return run


def _split_hot(rows: DataFrame, least: int, hot_segments: int):
    """(rows to index, spans settled) of the segments of hot anchors."""
    spark = rows.sparkSession
    # the strings of a range share more than half their bytes
    step, ready, settled = 1 << (least // 2).bit_length() - 1, [], []
    while step:
        cut = store(rows.mapInArrow(_narrow(least, step), schema(*_BODY)).withColumn("digest", F.xxhash64("body")))
        counts = cut.groupBy("anchor", "digest").agg(
            F.sum("n").alias("n_all"), F.min(F.struct("key", "size", "start")).alias("one"))
        counts = store(counts)
        groups = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n_all").alias("least_n"))
        marked = cut.join(counts, ["anchor", "digest"]).join(groups, "anchor")
        settled.append(marked.where("n = 1 and n_all > 1").select(
            "key", "size", "start", (F.col("last") + least).cast("int").alias("stop")))
        left = marked.where((F.col("kinds") > 1) & (F.col("least_n") == 1)
                            & (F.col("one") == F.struct("key", "size", "start")))
        left = left.withColumn("n", F.col("n_all"))
        names = [f.split()[0] for f in _BODY]
        ready.append(left.where(F.col("kinds") <= hot_segments).select(*names))
        rows = store(left.where(F.col("kinds") > hot_segments).select(*names))
        if not rows.take(1):
            break
        step //= 2
    return ready, settled


def repeated_spans(docs: DataFrame, text_col: str = "text", least: int = 400,
                   hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(key, size, spans): per different text, spans (start << 32 | stop) that cover its repeated bytes.

    ``key`` and ``size`` are the text's hash and bytes; texts without repeated bytes have no row.
    """
    prepare(docs.sparkSession)
    if least < 64 or least > 4096:
        raise ValueError("least must be from 64 to 4096 bytes")
    texts = _keyed(docs, text_col).where(F.col("size") >= least)
    segs = store(texts.mapInArrow(_segment_rows(least), schema(*_ROW)))
    kinds = store(segs.groupBy("anchor", "digest").agg(
        F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("key", "size", "start", "last", "place"))))
    twice = kinds.where("n > 1").select("anchor", "digest")
    whole = segs.join(_small(twice), ["anchor", "digest"]).select(
        "key", "size", "start", (F.col("last") + least).cast("int").alias("stop"))
    mixed = store(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least_n"))
                  .where("kinds > 1 and least_n = 1").select("anchor", "kinds"))
    wanted = (kinds.join(_small(mixed), "anchor").groupBy("key", "size")
              .agg(F.collect_list(F.struct("anchor", "start", "last", "place", "n")).alias("wanted")))
    sizes = mixed.agg(F.sum("kinds"), F.max("kinds")).first()
    rows = texts.join(store(wanted), ["key", "size"]).select("key", "size", "t", "wanted")
    rows = rows.mapInArrow(_bodies(least), schema(*_BODY))
    settled = [whole]
    if (sizes[1] or 0) > hot_segments:
        rows = store(rows)
        hot = _small(mixed.where(F.col("kinds") > hot_segments).select("anchor"))
        ready, more = _split_hot(rows.join(hot, "anchor", "left_semi"), least, hot_segments)
        settled += more
        rows = rows.join(hot, "anchor", "left_anti")
        for r in ready:
            rows = rows.unionByName(r)
    buckets = int((sizes[0] or 0) * 1.3 * least // INDEX_BYTES) + 1
    found = (rows.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket")
             .applyInArrow(_index(least), "key long, size int, start int, stop int"))
    spans = store(found)
    for s in settled:
        spans = spans.unionByName(s)
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("stop")
    return spans.groupBy("key", "size").agg(F.collect_set(packed).alias("spans"))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(t).alias("key"), F.octet_length(t).alias("size"), utf8(t).alias("t"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400,
                    hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, stop), kept (binary) per row of ``docs``.

    Every byte is removed that a string of ``least`` bytes covers which also
    starts anywhere else in any document, the same one included; overlapping
    occurrences count, matches never cross documents, and all strings are
    judged on the input.  Repeated rows hold each other's strings, so at
    ``least`` bytes or more they are removed as a whole.  NULL texts are
    empty; NULL ids are carried; an empty table gives an empty result; other
    columns are not read.
    """
    # stored, so that the join with many copies of one text can be split
    spans = store(repeated_spans(docs, text_col, least, hot_segments))
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("key"), F.octet_length(t).alias("size"),
                       utf8(t).alias("t"))
    rows = rows.join(spans, ["key", "size"], "left").select("doc_id", "t", "spans")

    def run(batches):
        for b in batches:
            out_spans, kept = [], []
            for text, packed in zip(b.column("t").to_pylist(), b.column("spans").to_pylist()):
                runs, parts, at = [], [], 0
                for p in sorted(packed or ()):
                    start, stop = p >> 32, p & 0xFFFFFFFF
                    if runs and start <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(stop, runs[-1]["stop"])
                    else:
                        runs.append({"start": start, "stop": stop})
                for r in runs:
                    parts.append(text[at:r["start"]])
                    at = r["stop"]
                parts.append(text[at:])
                out_spans.append(runs)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in b.column("t").to_pylist()], pa.int64()),
                 pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, schema(rows.schema["doc_id"], "n_bytes long",
                                       "spans array<struct<start:bigint,stop:bigint>>", "kept binary"))
