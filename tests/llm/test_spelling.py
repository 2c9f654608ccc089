"""Spelling variants against all pairs of words."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from logpipe.llm import queries, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_groups(counts, factor=5):
    out = {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], [ord(c) for c in x]), default=None)
        out[w] = (best if best is not None and counts[best] >= factor * n else None, n, len(near[w]))
    rows = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, counts.get(form)))
    return rows


@pytest.mark.parametrize("parts,small", [((4, 3), 200_000), ((3, 2), 0), ((6, 4), 10)])
def test_variant_groups(spark, monkeypatch, parts, small):
    monkeypatch.setattr(spelling, "SAME_PARTS", parts[0])
    monkeypatch.setattr(spelling, "NEXT_PARTS", parts[1])
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", small)
    rng = random.Random(parts[0])
    # few letters: many anagrams, ties, chains of forms and words that differ in one place
    counts = {"".join(rng.choices("abcé", k=rng.randint(1, 6))): rng.choice([1, 1, 5, 25, 125]) for _ in range(250)}
    counts |= {"\U0001F600x": 3, "x": 20, "": 4, "ÿ" * 500: 7, "ÿ" * 499: 70, "÷" + "ÿ" * 499: 700}
    rows = [(w, n, "clash") for w, n in counts.items()]
    df = spark.createDataFrame([*rows, (None, 9, "clash")], "word string, n long, form string")
    for c in ("root", "key", "a", "b", "length", "same", "next", "less"):
        df = df.withColumn(c, F.lit("clash"))
    got = spelling.variant_groups(df.repartition(3)).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == slow_groups(counts)


def test_repeated_words_add_up_and_empty(spark):
    df = spark.createDataFrame([("abc", 1), ("abd", 3), ("abc", 1), ("abd", 7)], "word string, n long")
    assert {tuple(r) for r in spelling.variant_groups(df).collect()} == slow_groups({"abc": 2, "abd": 10})
    assert spelling.variant_groups(df.where("false")).count() == 0


def test_only_counted_rows_are_broadcast(spark, monkeypatch):
    """Signatures and pairs, of which Spark believes too little, are shuffled; counted rows are broadcast up to the limit."""
    plans, store = [], spelling.store

    def planned(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return store(df)

    monkeypatch.setattr(spelling, "store", planned)
    df = spark.createDataFrame([(w, 5 ** i) for i, w in enumerate(["abcdef", "abcdeg", "abcde", "xyzxyz"])], "word string, n long")
    for small, broadcasts in ((0, 0), (200_000, 1)):
        monkeypatch.setattr(spelling, "BROADCAST_ROWS", small)
        plans.clear()
        out = spelling.variant_groups(df)
        plans.append(out._jdf.queryExecution().sparkPlan().toString())
        assert sum("SortMergeJoin" in p for p in plans) >= 2
        assert all("Broadcast" not in p for p in plans[:5]) and ("Broadcast" in plans[-1]) == bool(broadcasts)


def slow_words(docs):
    counts = {}
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run
                if len(word) >= 6:
                    counts[word] = counts.get(word, 0) + 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 5}


def test_words_with_misspellings(spark, docs_of):
    rng = random.Random(8)
    vocabulary = ["Éclairs", "éclairs", "banana", "bananas", "x×y÷zzz", "Straßenbahn", "short", "abcdef́gh", "œuvres"]
    texts = [rng.choice([" ", ", ", "1", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(120)]
    docs = [(i % 90, t) for i, t in enumerate(texts)] + [(None, " bananas" * 40), (7, None), (8, ""), (9, "banana " * 30000)]
    got = {r["word"]: r["n"] for r in queries.words_with_misspellings(docs_of(docs)).collect()}
    assert got == slow_words(docs) and len(got) > 7
    assert queries.words_with_misspellings(docs_of([])).count() == 0
