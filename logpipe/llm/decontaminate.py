"""Benchmark decontamination by Wu-Manber search for many strings at once.

Texts and test windows are brought to one canonical byte form: words in lower
case with single blanks between and around them.  A shift table over hashed
byte blocks says how far a position can jump without passing the end of any
test string's leading block; where the shift is zero, a bucket of the block's
hash names the test strings to compare byte by byte.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, schema, text_key, utf8

#: Bytes of test text searched for in one pass (and broadcast at once).
BLOCK_BYTES = 8 << 20
#: Bytes of canonical text searched together.
SEARCH_BYTES = 4 << 20
_HASH_BITS = 20
_LANES = 8192
#: Byte to canonical byte: A-Z to lower case; anything but 0-9, a-z and bytes from 128 up to a blank.
CANONICAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
                  for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(CANONICAL).split()


class _Table:
    """Shift table and buckets of the test strings of one length class."""

    def __init__(self, strings: list[tuple[bytes, int]]):
        self.strings = strings
        self.m = min(len(s) for s, _ in strings)
        self.b = min(8, self.m)
        heads = np.frombuffer(b"".join(s[:self.m] for s, _ in strings), np.uint8).reshape(-1, self.m)
        far = self.m - self.b + 1
        self.shift = np.full(1 << _HASH_BITS, far, np.uint16 if far < 65536 else np.uint32)
        for j in range(far):
            at = self._blocks(heads[:, j:j + self.b])
            np.minimum.at(self.shift, at, far - 1 - j)
        self.buckets = defaultdict(list)
        for i, h in enumerate(self._blocks(heads[:, self.m - self.b:]).tolist()):
            self.buckets[h].append(i)

    def _blocks(self, rows: np.ndarray) -> np.ndarray:
        value = np.zeros(len(rows), np.uint64)
        for j in range(self.b):
            value = (value << np.uint64(8)) | rows[:, j].astype(np.uint64)
        return self._hash(value)

    @staticmethod
    def _hash(value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)

    def search(self, text: bytes):
        """(position, string index) of every occurrence, overlapping ones included."""
        data = np.frombuffer(text, np.uint8)
        last = len(data) - self.m  # last possible start
        if last < 0:
            return
        # lanes of the text are searched in step, each from its own start to its own end
        lane = max(256, -(-(last + 1) // _LANES))
        pos = np.arange(0, last + 1, lane)
        stop = np.minimum(pos + lane, last + 1)
        found = []
        while len(pos):
            end = pos + (self.m - self.b)
            value = np.zeros(len(pos), np.uint64)
            for j in range(self.b):
                value = (value << np.uint64(8)) | data[end + j]
            h = self._hash(value)
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                found.append((pos[zero], h[zero]))
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        for at, hs in found:
            for p, h in zip(at.tolist(), hs.tolist()):
                for i in self.buckets.get(h, ()):
                    if text.startswith(self.strings[i][0], p):
                        yield p, i


class Searcher:
    """All windows of some test items, ready to be searched for."""

    def __init__(self, items: list[tuple], window: int):
        by_string: dict[bytes, tuple[int, set]] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                for i in range(max(1, len(words) - window + 1)):
                    part = words[i:i + window]
                    by_string.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item_id)
        self.items = [ids for _, ids in by_string.values()]
        strings = [(s, n) for s, (n, _) in by_string.items()]
        classes = defaultdict(list)  # short strings would shorten everybody's jumps
        for i, (s, n) in enumerate(strings):
            classes[min(6, len(s).bit_length())].append((s, n, i))
        self.tables = [(_Table([(s, n) for s, n, _ in c]), [i for _, _, i in c]) for c in classes.values()]

    def find(self, texts: list[bytes | None]):
        """Per text: number of words, sorted hit word numbers, ids of the items found."""
        canon = [b" " + b" ".join(words_of(t)) + b" " for t in texts]
        out = []
        at = 0
        while at < len(canon):
            upto, size = at, 0
            while upto < len(canon) and (upto == at or size + len(canon[upto]) <= SEARCH_BYTES):
                size += len(canon[upto]) + 1
                upto += 1
            out += self._together(canon[at:upto])
            at = upto
        return out

    def _together(self, canon: list[bytes]):
        text = b"\n".join(canon)
        starts = np.cumsum([0, *(len(c) + 1 for c in canon)])[:-1]
        n_words = [max(0, c.count(b" ") - 1) if len(c) > 2 else 0 for c in canon]
        hits, items = defaultdict(list), defaultdict(set)
        for table, numbers in self.tables:
            for p, i in table.search(text):
                d = int(np.searchsorted(starts, p, "right")) - 1
                hits[d].append((p - int(starts[d]), table.strings[i][1]))
                items[d] |= self.items[numbers[i]]
        out = []
        for d, c in enumerate(canon):
            words = np.array([], np.int64)
            if d in hits:
                blanks = np.flatnonzero(np.frombuffer(c, np.uint8) == 32)
                first = np.searchsorted(blanks, [p for p, _ in hits[d]])
                words = np.unique(np.concatenate([np.arange(f, f + n) for f, (_, n) in zip(first, hits[d])]))
            out.append((n_words[d], words, items.get(d, set())))
        return out


def _verdict(n_words: int, n_hit: int, items: set) -> tuple:
    ids = sorted(str(i) for i in items if i is not None)
    return (n_words, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
            n_hit > 0 and 20 * n_hit >= n_words)


_FIELDS = ("n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 13, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``docs`` (default: all) in a struct ``doc``, and
    n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or a shorter item's
    words.  Words inside any occurrence of a window are hit.  NULL texts have
    no words; an item with a NULL id hits words but is not listed; repeated
    ids list once; rows repeat as they come; an empty benchmark hits nothing.
    Test strings are broadcast in blocks of at most ``BLOCK_BYTES`` (plus one
    item), as many passes over ``docs`` as the benchmark needs.
    """
    spark = prepare(docs.sparkSession)
    size = benchmark.agg(F.sum(F.octet_length(item_text_col))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    ids = benchmark.select(F.col(item_col).alias("i"), utf8(item_text_col).alias("t"))
    dealt = ids.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    own = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text_col).alias("t"))
    if blocks == 1:
        searcher = _block(spark, dealt, 0)

        def run(batches):
            s = Searcher(searcher.value, window)
            for b in batches:
                rows = [_verdict(n, len(w), i) for n, w, i in s.find(_texts(b))]
                yield _batch(b.column("doc"), rows)

        return own.mapInArrow(run, schema(own.schema["doc"], *_FIELDS))
    # many blocks: what each pass finds is a matter of the text alone and is merged under its key
    keyed = own.withColumn("key", text_key("t"))
    passes = None
    for k in range(blocks):
        one = keyed.select("key", "t").mapInArrow(
            _finds(_block(spark, dealt, k), window),
            "key struct<a:bigint,b:bigint>, n long, hit array<long>, items array<string>")
        passes = one if passes is None else passes.union(one)
    merged = passes.groupBy("key").agg(
        F.max("n").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = merged.select(
        "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
    return keyed.drop("t").join(merged, "key").drop("key")


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("t").cast(pa.large_binary()).to_pylist()


def _block(spark, dealt: DataFrame, k: int):
    return spark.sparkContext.broadcast(
        [(r["i"], bytes(r["t"] or b"")) for r in dealt.where(F.col("block") == k).collect()])


def _batch(doc, rows: list[tuple]) -> pa.RecordBatch:
    n, hit, items, sha, bad = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [doc, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.int64()),
         pa.array(sha, pa.string()), pa.array(bad, pa.bool_())],
        ["doc", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _finds(items, window: int):
    def run(batches):
        s = Searcher(items.value, window)
        for b in batches:
            found = s.find(_texts(b))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([n for n, _, _ in found], pa.int64()),
                 pa.array([w.tolist() for _, w, _ in found], pa.list_(pa.int64())),
                 pa.array([[str(x) for x in i if x is not None] for _, _, i in found], pa.list_(pa.string()))],
                ["key", "n", "hit", "items"])
    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs``, unchanged, that are not contaminated."""
    return contamination(docs, benchmark, **names).where("not contaminated").select("doc.*")
