"""Spelling variants of words: exact pairs one edit apart by PartEnum signatures.

A word's letters, each with its running number within the word, are the ones
of a long binary vector.  One replaced letter changes two of its places, one
inserted or deleted letter a single place.  The places are dealt to parts; of
``k + 1`` parts or more, two vectors at most ``k`` places apart agree in all
but ``k`` at least.  So every choice of all but ``k`` parts is enumerated as a
signature, equal signatures are joined, and the pairs that meet are verified.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import discard, store

#: Parts of the letter vectors for pairs of one length (two places apart) and of neighbouring lengths (one place).
SAME_PARTS, NEXT_PARTS = 4, 3
#: Rows (of at most 100 bytes) up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def _places(word: Column) -> Column:
    """The word's letters in order, each with the number of equal letters before it and a hash that deals it."""
    letters = F.array_sort(F.array_remove(F.split(word, ""), ""))
    named = F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c) + 1).cast("string")))
    return F.transform(named, lambda p: F.struct(p.alias("p"), F.crc32(p).alias("h")))


def _parts(places: Column, number: int) -> Column:
    """What each of ``number`` parts holds of the word's places, as text."""
    return F.array(*(F.array_join(F.transform(F.filter(places, lambda x: x["h"] % number == k), lambda x: x["p"]), " ")
                     for k in range(number)))


def _signatures(parts: Column, number: int, apart: int, shorter: Column) -> Column:
    """Keys of all choices of all but ``apart`` parts, each once with either half of the word.

    One edit leaves the first or the last half of the shorter word as it is:
    with n letters, its first n // 2 or its last n - n // 2.  With that half in
    the key, a signature that very many words share falls into small groups.
    """
    word, half = F.col("word"), F.floor(shorter / 2).cast("int")
    ends = (F.left(word, half), F.right(word, shorter - half))
    return F.array(*(F.xxhash64(F.lit(number), F.lit(i), F.lit(end), shorter, text, *(parts[k] for k in chosen))
                     for i, chosen in enumerate(combinations(range(number), number - apart))
                     for end, text in enumerate(ends)))


def near_words(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: the pairs of ``words(word, n)``, each in both orders, that one edit turns into each other.

    An edit inserts, deletes or replaces one code point.  Words are taken to
    be distinct and not NULL.
    """
    length = F.char_length("word")
    split = store(words.select("word", "n", length.alias("length"), _places(F.col("word")).alias("places")))
    split = store(split.select("word", "n", "length", _parts(F.col("places"), SAME_PARTS).alias("same"),
                               _parts(F.col("places"), NEXT_PARTS).alias("next")))

    def rows(parts: str, number: int, apart: int, shorter: Column, name: str) -> DataFrame:
        keys = _signatures(F.col(parts), number, apart, shorter)
        return split.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.explode(keys).alias("key"))

    own = F.col("length")
    one_edit = F.levenshtein("a", "b", 1) == 1
    # both sides have several rows a word, which Spark does not count in: it would broadcast far more than it believes
    same = rows("same", SAME_PARTS, 2, own, "a").join(rows("same", SAME_PARTS, 2, own, "b").hint("merge"), "key").where(
        (F.col("a") < F.col("b")) & one_edit)
    longer = rows("next", NEXT_PARTS, 1, own, "a").join(rows("next", NEXT_PARTS, 1, own - 1, "b").hint("merge"), "key").where(
        (F.char_length("a") < F.char_length("b")) & one_edit)
    order = ("a", "b", "a_n", "b_n")
    pairs = store(same.select(*order).union(longer.select(*order)).distinct())
    return pairs.union(pairs.select("b", "a", "b_n", "a_n"))


def variant_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words(word string, n long)``.

    A word's near words are one edit away (see ``near_words``), ``n_near`` in
    number.  Its form is the most frequent of them (ties: the smallest in
    code-point order) if that is at least ``factor`` (above 1) times as
    frequent as the word itself; ``root`` is where its forms lead.  NULL words
    are left out; words that repeat are one word with all their occurrences.
    An empty table gives an empty result; other columns are not read.
    """
    words = store(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(words)
    best = near.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best.hint("merge"), "word", "left")
    is_form = -F.col("best.less") >= factor * F.col("n")
    formed = store(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(_small(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) with all steps (word, root) followed to their ends.

    Each round doubles the steps taken.  Forms grow more frequent by a factor
    each time, so there are no circles and few rounds.
    """
    now = store(steps)
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = store(now.join(_small(ahead), "root", "left")
                      .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(now)
        now = after.drop("moved")
        now.stored_path = after.stored_path
        if after.where("moved").isEmpty():
            return now


def _small(df: DataFrame) -> DataFrame:
    """Broadcast by its rows, or not at all: files of words are much smaller than their rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")
