"""Exact substring dedup against brute force."""

import random

import pytest

from logpipe.llm import substrings
from logpipe.llm.rlbwt import borders, repeats, suffix_array


def slow_spans(texts, least):
    seen = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            seen[t[i:i + least]] = seen.get(t[i:i + least], 0) + 1
    out = []
    for t in texts:
        marks = bytearray(len(t) + 1)
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                marks[i:i + least] = b"\1" * least
        spans, start = [], None
        for i, m in enumerate(marks):
            if m and start is None:
                start = i
            if not m and start is not None:
                spans.append((start, i))
                start = None
        out.append(spans)
    return out


def test_repeats_of_small_alphabets():
    rng = random.Random(3)
    for trial in range(200):
        least = rng.randint(2, 8)
        alphabet = b"ab\0"[:rng.randint(1, 3)]
        texts = [bytes(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        assert repeats(texts, least) == slow_spans(texts, least), (texts, least)


def test_suffixes_are_sorted_and_runs_are_fewer_than_bytes():
    import numpy as np
    texts = [b"banana" * 30, b"bananas" * 20, b""]
    raw, rest, x, y = borders(texts)
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    symbols[rest == 0] = 0
    sa = suffix_array(symbols, rest)
    order = [(raw[p:p + rest[p]], p) for p in sa.tolist()]
    assert order == sorted(order) and len(x) < len(raw) / 4


def spans_of(df, **kw):
    return sorted(((r["doc_id"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"]), r["n_bytes"])
                   for r in substrings.substring_dedup(df, **kw).collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("hot_segments", [4096, 2])
def test_against_brute_force(docs_of, words, hot_segments, monkeypatch):
    monkeypatch.setattr(substrings, "ANCHOR_BYTES", 700)
    rng = random.Random(4)
    shared = [" ".join(words(40, s)) for s in range(4)]
    texts = []
    for i in range(24):
        parts = [" ".join(words(rng.randint(0, 60), 100 + i)), rng.choice(shared), " ".join(words(rng.randint(0, 30), 200 + i))]
        texts.append("é".join(parts[:rng.randint(1, 3)]))
    long = " ".join(words(900, 9))
    edited = long.split(" ")
    edited[300], edited[600] = "edit", "ed\0it"
    texts += [long, " ".join(edited), "x" * 1500, "ab" * 700, shared[0] + shared[0], "", "short"]
    raw = [t.encode() for t in texts]
    least = 120
    want = slow_spans(raw, least)
    got = spans_of(docs_of(texts), least=least, hot_segments=hot_segments)
    assert [g[1] for g in got] == want
    for (_, spans, kept, n), t in zip(got, raw):
        cuts = [0, *(p for s in spans for p in s), len(t)]
        assert kept == b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2])) and n == len(t)


def test_nulls_repeated_rows_and_empty_tables(docs_of, words):
    text, other = " ".join(words(100, 1)), " ".join(words(30, 2))
    df = docs_of([(1, text), (1, text), (None, text), (2, None), (3, ""), (None, other), (4, other)])
    n, m = len(text.encode()), len(other.encode())
    assert n > 400 > m
    assert [(r[0], r[1], r[3]) for r in spans_of(df)] == [
        (1, [(0, n)], n), (1, [(0, n)], n), (2, [], 0), (3, [], 0), (4, [], m), (None, [], m), (None, [(0, n)], n)]
    assert spans_of(df.where("false")) == []
    with pytest.raises(ValueError):
        substrings.substring_dedup(df, least=10)
