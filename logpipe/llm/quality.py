"""Quality scores by Bradley-Terry pairwise ranking.

Documents of label 1 are preferred to documents of label 0.  The chance that
one document beats another is the logistic of the difference of their scores,
and a score is linear in features of the text, so the weights are learned
from feature differences of preference pairs.  The score where a document
counts as good is the quantile that leaves label 1's share above it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, schema, store
from logpipe.llm.langid import held_out

#: Bounds of what is learned from: labelled documents, and pairs each takes part in.
TRAIN_DOCS = 20_000
PAIRS_EACH = 8
#: Labels (of 12 bytes) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Weight of the squared norm in the loss, and Newton steps.
RIDGE = 1e-3
#: Scores between which a quantile is looked for, at most this many on the driver at a time.
AT_ONCE = 20_000
STEPS = 25
_WORD = re.compile(r"\S+")
_CLASSES = np.zeros(256, np.uint8)
for _i, _members in enumerate((b" \t\r\x0b\x0c", b"\n", b"0123456789", bytes(range(97, 123)),
                               bytes(range(65, 91)), b".,;:?", b"!", b"#$%&*+/<=>@\\^_`{|}~", b"'\"()-[]",
                               bytes(range(128, 256))), 1):
    _CLASSES[list(_members)] = _i
_N_CLASSES = 11


def features(text: str | None) -> np.ndarray:
    """Shape, repetition and length of a whole text; all zero but the constant for none."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float64)
    if not raw:
        return out
    share = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=_N_CLASSES) / len(raw)
    out[:_N_CLASSES] = share
    words = text.split()
    n = len(words)
    if not n:
        return out
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    top = seen.most_common(3)
    # how fast new words come, given the length: what a text of few words repeated lacks
    letters = [len(w) for w in seen]
    out[_N_CLASSES:] = (
        np.log1p(n) / 10,
        len(seen) / n,
        np.log(len(seen)) / np.log(n + 1.0),
        pairs / max(1, n - 1),
        top[0][1] / n,
        sum(c for _, c in top) / n,
        sum(map(len, words)) / n / 20,
        min(3.0, max(letters) / 40),
        len(set(lines)) / max(1, len(lines)),
        min(3.0, n / max(1, len(lines)) / 60),
        sum(w.isupper() for w in words) / n,
        sum(w[-1] in ".!?" for w in words) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?!)\"'" for w in words) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        min(1.0, n / 50),
    )
    return out


N_FEATURES = _N_CLASSES + 15


@dataclass
class Ranker:
    """score = logistic(scale * ((x - mean) / spread . weights - threshold))"""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (_expand(x) - self.mean) / self.spread @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.raw(x) - self.threshold), -50, 50)))


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.square(x), np.sqrt(np.abs(x))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH, seed: int = 7) -> Ranker:
    """Weights from preference pairs (each document in about ``pairs_each``) by Newton steps.

    With one label only, or none, every text scores that label's side: 1 - or
    0.5 without labels at all.
    """
    wide = _expand(x) if len(x) else np.zeros((0, 3 * N_FEATURES))
    mean = wide.mean(axis=0) if len(x) else np.zeros(wide.shape[1])
    spread = np.maximum(wide.std(axis=0), 1e-6) if len(x) else np.ones(wide.shape[1])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        side = 0.0 if not len(y) else (-1.0 if len(good) else 1.0)
        return Ranker(mean, spread, np.zeros(wide.shape[1]), side, 1.0)
    z = (wide - mean) / spread
    rng = np.random.default_rng(seed)
    n = pairs_each * max(len(good), len(bad))
    d = z[np.resize(rng.permutation(good), n)] - z[np.resize(rng.permutation(bad), n)[rng.permutation(n)]]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / n + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # between the scores around the quantile that leaves label 1's share above
    ranked = np.sort(raw)
    cut = len(bad)
    threshold = float((ranked[cut - 1] + ranked[min(cut, len(ranked) - 1)]) / 2)
    return Ranker(mean, spread, w, threshold, 1.0)


def kth(values: DataFrame, k: int, at_once: int = AT_ONCE) -> float:
    """The ``k``-th smallest (from 0) of the column ``raw``, exactly: the range that holds it is cut until it is small."""
    n, low, high = values.agg(F.count("raw"), F.min("raw"), F.max("raw")).first()
    while n > at_once and low < high:
        part = values.where(F.col("raw").between(low, high))
        cell = F.floor((F.col("raw") - low) / F.lit(high - low) * 4096)
        for r in part.groupBy(cell.alias("cell")).agg(F.count("raw").alias("n"), F.min("raw").alias("low"),
                                                      F.max("raw").alias("high")).orderBy("cell").collect():
            if k < r["n"]:
                n, low, high = r["n"], r["low"], r["high"]
                break
            k -= r["n"]
    if low == high:
        return low
    return sorted(r["raw"] for r in values.where(F.col("raw").between(low, high)).collect())[k]


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) per row of ``docs``."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column("t").to_pylist()]
            flat = pa.array(np.concatenate(x) if x else np.array([]))
            sizes = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(sizes, flat)], ["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, schema(rows.schema["id"], "x array<double>"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", modulus: int = 3, remainder: int = 1,
                   train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``.

    Learns from at most about ``train_docs`` labelled documents that are not
    held out, picked by a hash of the id; labels other than 0 and 1 teach
    nothing, several labels of one id count by their majority (a draw as 1).
    The score where a document counts as good is the quantile over all
    labelled documents that are not held out, sampled or not.
    NULL and empty texts get a score like any other; NULL ids and repeated
    rows are carried as they are; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    aside = held_out("id", modulus, remainder)
    rows = store(feature_rows(docs, id_col, text_col))
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
             .where("id is not null and y in (0, 1)").where(~aside)
             .groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    known = store(known)
    n = known.count()

    def one_each(known):
        """One text per id: repeated rows of an id teach once."""
        return (rows.join(F.broadcast(known) if n <= BROADCAST_ROWS else known, "id").groupBy("id")
                .agg(F.min(F.struct("x", "y")).alias("s")).select("id", "s.x", "s.y"))

    picked = known
    if n > train_docs:
        picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * train_docs / n))
    sample = one_each(picked).orderBy("id").collect()
    fitted = fit(np.array([r["x"] for r in sample]).reshape(-1, N_FEATURES),
                 np.array([r["y"] for r in sample], np.int64))
    if n > train_docs and fitted.weights.any():
        ranker = spark.sparkContext.broadcast(fitted)

        def raw_scores(batches):
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([pa.array(ranker.value.raw(x)), b.column("y")], ["raw", "y"])

        scores = store(one_each(known).select("x", "y").mapInArrow(raw_scores, "raw double, y integer"))
        total, good = scores.agg(F.count("raw"), F.sum("y")).first()
        cut = total - good
        fitted.threshold = (kth(scores, max(cut - 1, 0)) + kth(scores, min(cut, total - 1))) / 2
    model = spark.sparkContext.broadcast(fitted)

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    id_field = rows.schema["id"]
    scored = rows.mapInArrow(run, schema(type(id_field)("doc_id", id_field.dataType), "score double", "predicted integer"))
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted")
