"""SimHash fingerprints and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from logpipe.llm import simhash
from logpipe.llm.graph import components


UPPER = {i: i - 32 for i in range(ord("a"), ord("z") + 1)}


def slow_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c
                                for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "ÄÖ Straße x", "a b c d", "A b C d e f g a b c d e",
                                  "x\x0by\x0cz\rw v u", "nb sp a b c d \x1c e"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_fingerprint_of_many_shingles(words, monkeypatch):
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    text = " ".join(words(200, 3))
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(7, i) for i in range(300, 340)]
    pairs += [(i, i + 1) for i in range(1000, 1030)]
    df = spark.createDataFrame(pairs + [(5, 5), (None, 3), pairs[0]], "a long, b long")
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in components(df).collect()} == slow_components(pairs, nodes)
    assert components(df.where("false")).count() == 0


@pytest.mark.parametrize("at_once", [1 << 21, 300])
def test_links_reach_every_fingerprint_within_the_distance(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "VALUES_AT_ONCE", at_once)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for fp in list(fps)[:12]:
        for _ in range(8):  # balls around some of them, out to beyond the distance
            for b in rng.sample(range(64), rng.randint(1, 6)):
                fp ^= 1 << b
            fps.add(fp)
    fps |= {0, (1 << 64) - 1, 1 << 63}
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(df, 4).collect()]
    near = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    assert slow_components(links, signed) == slow_components(near, signed)
    with pytest.raises(ValueError):
        simhash.near_links(df, 3)


def test_groups_and_kept_rows(docs_of, words):
    base = words(120, 5)
    copies = [" ".join(base), " ".join(base), " ".join(base).translate(UPPER), "  ".join(base)]
    near = " ".join(base[:60] + ["changed"] + base[61:])
    texts = [*copies, near, None, "", " \n", " ".join(words(90, 6)), " ".join(words(20_000, 7))]
    df = docs_of([*enumerate(texts), (3, copies[3]), (None, copies[0]), (None, "alone here now yes")])
    rows = simhash.simhash_groups(df).collect()
    fps = {slow_fingerprint(t) for t in texts} | {slow_fingerprint("alone here now yes")}
    signed = {int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps}
    assert {r["fp"] for r in rows} == signed and len(rows) == 13
    by_id = {}
    for r in rows:
        by_id.setdefault(r["id"], set()).add(r["component_id"])
    assert by_id[0] == by_id[1] == by_id[2] == by_id[3] == {0}
    assert by_id[5] == by_id[6] == by_id[7] == {5} and by_id[8] == {8} and by_id[9] == {9}
    assert by_id[None] == {0, None}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    distance = bin(slow_fingerprint(near) ^ slow_fingerprint(copies[0])).count("1")
    assert ids == [0, *([4] if distance > 4 else []), 5, 8, 9, None]
    assert simhash.simhash_groups(df.where("false")).count() == 0
    assert simhash.keep_one(df.where("false")).count() == 0


def test_hex(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(simhash.hex_fingerprint(F.lit(-1)).alias("a"),
                              simhash.hex_fingerprint(F.lit(255).cast("long")).alias("b")).first()
    assert (r["a"], r["b"]) == ("f" * 16, "00000000000000ff")
