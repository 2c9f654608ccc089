"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, schema, store

#: Bounds of what is learned from: documents, and words kept per language (most frequent first).
TRAIN_DOCS = 20_000
MODEL_WORDS = 40_000
#: Longest n-gram that an unseen word falls back to; the shortest is one character.
NGRAM = 5
#: n-grams kept per length and language, most frequent first.
MODEL_GRAMS = 40_000
#: Entries of the table of words, and of n-grams of one length; beyond fifty languages each keeps its even share.
MODEL_ENTRIES = 2_000_000
UNKNOWN = "und"
#: Distinct words whose scores a worker remembers before it starts afresh.
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str, k: int) -> list[str]:
    """The word's ``k`` characters in a row, its ends marked by blanks (but for single characters)."""
    if k > 1:
        word = f" {word} "
    return [word[i:i + k] for i in range(len(word) - k + 1)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id's text leaves ``remainder``; false for a NULL id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder,
                      F.lit(False))


def _count_words(batches):
    seen: defaultdict[str, Counter] = defaultdict(Counter)
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("t").to_pylist()):
            seen[lang].update(words_of(text))
        if sum(map(len, seen.values())) > 300_000:
            yield from _count_batches(seen)
            seen.clear()
    yield from _count_batches(seen)


def _count_batches(seen: dict[str, Counter]):
    for lang, words in seen.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()),
                                          "word": pa.array(list(words), pa.string()),
                                          "n": pa.array(list(words.values()), pa.int64())})


def _count_grams(batches):
    """(lang, k, gram, n) of (lang, word, n)."""
    for b in batches:
        seen: Counter = Counter()
        for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for k in range(1, NGRAM + 1):
                for gram in _grams(word, k):
                    seen[lang, k, gram] += n
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.int32()),
             pa.array([x[2] for x in keys], pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["lang", "k", "gram", "n"])


def _most_frequent(counted: DataFrame, groups: list[str], name: str, most: int) -> DataFrame:
    """About the ``most`` most frequent rows of each group; of the least count kept, those picked by a hash of ``name``.

    Counts of counts tell where each group is cut, so no task ranks a whole group.
    """
    sizes = counted.groupBy(*groups, "n").agg(F.count(F.lit(1)).alias("rows")).orderBy(*groups, F.desc("n")).collect()
    cuts: dict[tuple, tuple[int, int]] = {}
    room: dict[tuple, int] = {}
    for r in sizes:
        group = tuple(r[g] for g in groups)
        left = room.get(group, most)
        if left > 0:
            cuts[group] = (r["n"], min(1 << 20, (left << 20) // r["rows"]))
        room[group] = left - r["rows"]
    if not cuts:
        return counted
    cut = counted.sparkSession.createDataFrame(
        [(*g, *c) for g, c in cuts.items()],
        ", ".join([*(f"{g} {counted.schema[g].dataType.simpleString()}" for g in groups), "cut long", "share long"]))
    ties = (F.col("n") == F.col("cut")) & (F.pmod(F.xxhash64(name), F.lit(1 << 20)) < F.col("share"))
    return counted.join(F.broadcast(cut), groups).where((F.col("n") > F.col("cut")) | ties).drop("cut", "share")


class Table:
    """Log frequencies of names by language, each name with the few languages that have it.

    A count of half stands for none, so a name's row is a common base and, for
    its own languages, what lies above that.
    """

    def __init__(self, by_lang: list[Counter]):
        names = sorted(set().union(*by_lang)) if by_lang else []
        self.at = dict(zip(names, range(len(names))))
        self.base = np.log(0.5 / np.array([sum(c.values()) + 0.5 * max(1, len(names)) for c in by_lang]))
        row = np.array([self.at[x] for c in by_lang for x in c], np.int64)
        lang = np.array([i for i, c in enumerate(by_lang) for _ in c], np.int32)
        above = np.log(np.array([n for c in by_lang for n in c.values()], np.float64) * 2 + 1)
        order = np.argsort(row, kind="stable")
        self.lang, self.above = lang[order], above[order]
        self.first = np.r_[0, np.cumsum(np.bincount(row, minlength=len(names)))].astype(np.int64)

    def add(self, rows: np.ndarray, owner: np.ndarray, share: np.ndarray, out: np.ndarray) -> None:
        """Add to the rows ``owner`` of ``out`` what the names at ``rows`` have above the base, times ``share``."""
        sizes = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        np.add.at(out, (np.repeat(owner, sizes), self.lang[at]), self.above[at] * np.repeat(share, sizes))


class Model:
    """Log frequencies per language of words and of n-grams inside padded words.

    ``gram_counts`` are (language, length, n-gram, count); without them the words' own are counted.
    """

    def __init__(self, counts: list[tuple[str, str, int]], totals: dict[str, int],
                 gram_counts: list[tuple[str, int, str, int]] | None = None):
        self.langs = sorted(totals)
        at = {lang: i for i, lang in enumerate(self.langs)}
        words: list[Counter] = [Counter() for _ in self.langs]
        grams: dict[int, list[Counter]] = {k: [Counter() for _ in self.langs] for k in range(1, NGRAM + 1)}
        for lang, word, n in counts:
            words[at[lang]][word] += n
            if gram_counts is None:
                for k, by_lang in grams.items():
                    own = by_lang[at[lang]]
                    for gram in _grams(word, k):
                        own[gram] += n
        for lang, k, gram, n in gram_counts or ():
            grams[k][at[lang]][gram] += n
        self.words = Table(words)
        self.grams = {k: Table(g) for k, g in grams.items()}
        self.memory = Memory()  # a worker's; it lasts from task to task

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word: its log frequencies if known, else the mean over its longest n-grams known."""
        out = np.zeros((len(words), len(self.langs)))
        at = np.array([self.words.at.get(w, -1) for w in words], np.int64)
        known = np.flatnonzero(at >= 0)
        out[known] = self.words.base
        self.words.add(at[known], known, np.ones(len(known)), out)
        rest = np.flatnonzero(at < 0).tolist()
        for k in range(NGRAM, 0, -1):
            names = self.grams[k].at
            hits, sizes, found, missed = [], [], [], []
            for i in rest:
                own = [x for x in map(names.get, _grams(words[i], k)) if x is not None]
                if own:
                    hits += own
                    sizes.append(len(own))
                    found.append(i)
                else:
                    missed.append(i)
            if found:
                n = np.array(sizes)
                out[found] = self.grams[k].base
                self.grams[k].add(np.array(hits), np.repeat(np.array(found), n), np.repeat(1 / n, n), out)
            rest = missed
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        return [self._predict(words_of(t)) for t in texts]

    def _predict(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.langs:
            return UNKNOWN, 0.0
        memory = self.memory
        at = list(map(memory.rows.get, words))
        if None in at:
            memory.learn(sorted({w for w, a in zip(words, at) if a is None}), words, self)
            at = list(map(memory.rows.__getitem__, words))
        total = memory.scores[at].sum(axis=0)
        total -= total.max()
        return self.langs[int(np.argmax(total))], float(1 / np.exp(total).sum())


class Memory:
    """Scores of words that a worker has seen; starts afresh beyond ``REMEMBERED``."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, 0))

    def learn(self, new: list[str], all_words: list[str], model: Model) -> None:
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, new = {}, sorted(set(all_words))
        need, size = len(self.rows) + len(new), len(model.langs)
        if need > len(self.scores) or self.scores.shape[1] != size:
            grown = np.zeros((max(2 * need, 1024), size))
            if len(self.rows):
                grown[:len(self.rows)] = self.scores[:len(self.rows)]
            self.scores = grown
        self.scores[len(self.rows):need] = model.word_scores(new)
        self.rows.update(zip(new, range(len(self.rows), need)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = TRAIN_DOCS, model_words: int = MODEL_WORDS) -> Model:
    """Learn from about ``train_docs`` documents with a language, picked by a hash of id and text.

    A language with less than its even share of those is sampled up to that
    share, so at most about twice as many are read and none is left out.  The
    model holds at most ``model_words`` words and ``MODEL_GRAMS`` n-grams of
    each length per language (its even share of ``MODEL_ENTRIES`` with very
    many languages), so it can be broadcast whatever the size of the corpus.
    Rows without text or language teach nothing.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                       F.col(text_col).alias("t")).where("lang is not null")
    known = rows.where("t is not null")
    per_lang = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    n = sum(per_lang.values())
    if n > train_docs:
        even = -(-train_docs // len(per_lang))
        share = docs.sparkSession.createDataFrame(
            [(lang, math.ceil((1 << 20) * max(train_docs / n, even / own))) for lang, own in per_lang.items()],
            "lang string, share long")
        known = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id", "t"), F.lit(1 << 20)) < F.col("share"))
    counted = known.select("lang", "t").mapInArrow(_count_words, "lang string, word string, n long")
    counted = store(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    entries = MODEL_ENTRIES // max(1, len(per_lang)) + 1
    top = _most_frequent(counted, ["lang"], "word", min(model_words, entries)).toArrow()
    grams = counted.mapInArrow(_count_grams, "lang string, k int, gram string, n long")
    grams = store(grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")))
    grams = _most_frequent(grams, ["lang", "k"], "gram", min(MODEL_GRAMS, entries)).toArrow()
    counts, gram_counts = (list(zip(*(t.column(c).to_pylist() for c in names)))
                           for t, names in ((top, ("lang", "word", "n")), (grams, ("lang", "k", "gram", "n"))))
    totals: Counter = Counter()
    for lang, _, times in counts:
        totals[lang] += times
    return Model(counts, dict(totals), gram_counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all) in a struct ``doc``, lang_pred and score per row.

    ``lang_pred`` is a learned language, or ``und`` with score 0 for a text
    that is NULL or has no letter (and for every text if nothing was
    learned).  ``score`` is the predicted language's share of the likelihood;
    ties go to the alphabetically first language.  Whole texts are read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    own = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text_col).alias("t"))

    def run(batches):
        m = shared.value
        for b in batches:
            found = m.predict(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc", "lang_pred", "score"])

    return own.mapInArrow(run, schema(own.schema["doc"], "lang_pred string", "score double"))


def identify_with_own_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             lang_col: str = "lang", modulus: int = 4, remainder: int = 2,
                             carry: list[str] | None = None) -> DataFrame:
    """``identify`` with a model of the labelled rows that are not held out; adds ``held_out``."""
    aside = held_out(id_col, modulus, remainder)
    model = train(docs.where(~aside), id_col, text_col, lang_col)
    rows = docs.withColumn("_held_out", aside)
    out = identify(rows, model, text_col, [*(carry or docs.columns), "_held_out"])
    return out.select(*(F.col("doc").getField(c).alias(c) for c in (carry or docs.columns)),
                      F.col("doc._held_out").alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least_score: float = 0.5, **names) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is found with at least ``least_score``."""
    aside = held_out(names.get("id_col", "doc_id"), 4, 2)
    model = train(docs.where(~aside), **names)
    found = identify(docs, model, names.get("text_col", "text"))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("doc.*")
