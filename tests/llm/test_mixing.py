"""Mixing against brute force: targets by resharing, subset sums by exhaustion."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from logpipe.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Resharing round by round, as it is described."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, target = share * sum(sizes.values()), list(names), {}
    while free:
        w = sum(weight[s] for s in free)
        level = {s: rest * weight[s] / w for s in free}
        full = [s for s in free if level[s] > most * sizes[s]]
        if not full:
            return target | level
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


def best_below(sizes, budget):
    """The largest sum of none, one or two copies of each that fits the budget."""
    sums = 1
    for x in sizes:
        sums |= sums << x | sums << 2 * x
        sums &= (1 << budget + 1) - 1
    return sums.bit_length() - 1


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot", "\U0001F600", "￿"])
        k = rng.choice([0, 1, 2, 7, 7, 7, 30, rng.randint(1, 300)])
        rows.append((i, rng.choice([" ", "\n\t", " x "]).join(f"w{rng.randint(0, 9)}" for _ in range(k)), "l", source, 1))
    return rows + [(900, None, None, "a", 0), (901, "", "l", "empty", 0), (901, "", "l", "empty", 0), (None, "x y", "l", "a", 3),
                   (5, rows[5][1], "l", rows[5][3], 1), (902, "w " * 20000, "l", "b", 0)]


def make(spark, rows, partitions=3):
    clash = ["src", "none", "size", "h", "row", "n", "same", "target", "extra", "settled", "bucket", "edge", "part", "weight"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in clash}).repartition(partitions)


@pytest.mark.parametrize("rank_rows,buckets", [(200, 1024), (5, 3)])
def test_mix(spark, monkeypatch, rank_rows, buckets):
    monkeypatch.setattr(mixing, "RANK_ROWS", rank_rows)
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rows = corpus(1)
    got = [r.asDict() for r in mixing.mix(make(spark, rows)).collect()]
    assert sorted((r["doc_id"] or -1, r["source"] or "", r["size"]) for r in got) == sorted(
        (i or -1 if i is not None else -1, s or "", size_of(t)) for i, t, _, s, _ in rows)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    targets = slow_targets(sizes)
    taken, copies = dict.fromkeys(sizes, 0), {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
        copies.setdefault(s, set()).add(r["copies"])
    for s in sizes:
        if s == "b":  # nearly all its words are in one document
            assert taken[s] == best_below([size_of(t) for _, t, _, x, _ in rows if x == s], round(targets[s]))
        else:  # the budgets are met to the word
            assert taken[s] == round(targets[s]) and max(copies[s]) - min(copies[s]) <= 1, s
    again = mixing.mix(make(spark, rows, 7)).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.mix(make(spark, rows)).collect())


def test_seed_matters_and_selects_within_a_length(spark):
    rows = [(i, "a b c", "l", s, 5) for i in range(50) for s in ("x", "y", "z")]
    one, two = ({(r["doc_id"], r["source"], r["copies"]) for r in mixing.mix(make(spark, rows), seed=s).collect()} for s in (1, 2))
    assert one != two
    # 675 words for weights 3, 1, 2: x stops at 300, the others share 375 as 125 and 250
    assert {s: sum(c * 3 for _, t, c in one if t == s) for s in "xyz"} == {"x": 300, "y": 126, "z": 249}


def test_large_groups_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 10)
    rows = [(7, "same text here", "l", "x", 1)] * 300 + [(8, "other", "l", "y", 1)] * 100
    got = mixing.mix(make(spark, rows)).groupBy("source", "copies").count().collect()
    totals = {}
    for r in got:
        totals[r["source"]] = totals.get(r["source"], 0) + r["copies"] * r["count"] * (3 if r["source"] == "x" else 1)
    want = slow_targets({"x": 900, "y": 100})
    assert totals["y"] == want["y"] == 200 and abs(totals["x"] - want["x"]) < 3


def test_empty_and_wordless(spark):
    assert mixing.mix(make(spark, [])).count() == 0
    got = mixing.mix(make(spark, [(1, None, None, None, None), (2, " ", "l", "s", 1)])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_fit_against_all_subsets():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(0, 40), rng.randint(1, 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, sum(x * n for x, n in zip(lengths, counts)))
        items = [(i, x, n) for i, (x, n) in enumerate(zip(lengths, counts)) if x]
        used = mixing._reach(items, budget)
        best = max((s for t in itertools.product(*(range(n + 1) for n in counts))
                    if (s := sum(x * n for x, n in zip(lengths, t))) <= budget))
        assert sum(lengths[i] * n for i, n in used) == best
        number = dict.fromkeys(range(len(lengths)), 0)
        for i, n in used:
            number[i] += n
        assert all(number[i] <= counts[i] for i in number)
        taken = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(taken, counts))
        assert abs(budget - sum(x * n for x, n in zip(lengths, taken))) < 40


def test_fit_by_second_copies_and_nearest():
    assert mixing.fit([20000, 100], [1, 10], 2000, 2) == [0, 20]
    assert mixing.fit([20000], [1], 15000, 2) == [1]
    assert mixing.fit([20000], [1], 9000, 2) == [0]


def test_fit_of_large_budgets(monkeypatch):
    monkeypatch.setattr(mixing, "FIT_WORDS", 500)
    lengths, counts = list(range(1, 900)), [1 + i % 7 for i in range(899)]
    for budget in (0, 1, 12345, 999_999):
        assert sum(x * n for x, n in zip(lengths, mixing.fit(lengths, counts, budget))) == budget
