"""Token counts and packing against the library."""

import random
import zlib

import numpy as np
import pytest

from logpipe.llm import pack, tokencount, vocabulary
from logpipe.llm.queries import tokenizer

BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
STRANGE = ["", " ", "  \n\n x", "don't we'll I'M 'tis ''s", "a<|endoftext|>b <|startoftext|>", "x" * 5000,
           "tab\tand\r\nlines\x0b\x0c\x1c\x85 \xa0nb", "ᎠᏣ 𝒳 漢字 かな ไทย ́é é", "ﬁ ½ ² ٣ Ⅷ ৵ 1234",
           "€!!!...???--- a_b __x", "​᠎ z", "\U0001F600 ok ퟿", "ß İstanbul ŉ ſ Σς ǅ", "\x00\x01 nul",
           "a  b   c\n d\n\ne \n f", "naïve façade Ünïcödé 3.14 v2"]


def library_ids(path, text):
    return vocabulary.library(path).encode(text, add_special_tokens=False).ids


def mixed_texts(n):
    rng = random.Random(8)
    pool = [*"abcdefgh ÄéñçßžŁ  \n\t.,'!?0123²½ªº_-", "the", " ing", "'ll", "\r\n", " ", "漢", "\U0001F600"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 80))) for _ in range(n)]


def test_files_are_usable_as_ranked_merges():
    assert vocabulary.merges(BYTES).usable and vocabulary.merges(WORDS).usable
    proved = tokencount.proved(BYTES)
    assert len(proved) > 30_000 and " the" in proved and "don't" not in proved


def test_counts_equal_the_library(monkeypatch):
    texts = STRANGE + mixed_texts(600)
    want = [len(library_ids(BYTES, t)) for t in texts]
    assert tokencount.count_tokens(texts, BYTES) == want
    monkeypatch.setattr(tokencount, "REMEMBERED", len(tokencount.proved(BYTES)) + 5)
    monkeypatch.setattr(tokencount, "SPAN", 20)
    tokencount._memory.cache_clear()
    assert tokencount.count_tokens(texts, BYTES) == want
    tokencount._memory.cache_clear()


def test_every_settled_character_is_split_as_the_library_does():
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c} {c}1" for c in chars]
    assert tokencount.count_tokens(texts, BYTES) == [len(library_ids(BYTES, t)) for t in texts]


def test_ids_equal_the_library(monkeypatch):
    texts = STRANGE + mixed_texts(600) + [f"a{chr(c)}b {chr(c)}1" for c in range(1, 0x250)]
    for bound in (400_000, 3):
        monkeypatch.setattr(pack, "REMEMBERED", bound)
        for t in texts:
            assert np.frombuffer(pack.token_ids(t, WORDS), "<u4").tolist() == library_ids(WORDS, t), repr(t)


def test_token_counts_table(docs_of, words):
    long = " ".join(words(30_000, 1))
    df = docs_of([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "é"), (4, long)])
    rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])
            for r in tokencount.token_counts(df, BYTES).collect()}
    n = len(library_ids(BYTES, long))
    assert rows == {(1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, False), (None, 2, 1, False),
                    (4, len(long.encode()), n, True)}
    assert tokencount.token_counts(df, BYTES).count() == 6
    assert tokencount.token_counts(df.where("false"), BYTES).count() == 0


def best_fill(counts, capacity):
    """Brute force: the fullest combination with the largest length."""
    items = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    first, rest = items[0], items[1:]
    sums = {0}
    for x in rest:
        sums |= {s + x for s in sums if s + x + first <= capacity}
    return first + max(sums)


def test_fullest_combination_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.randint(10, 60)
        counts = {}
        for _ in range(rng.randint(1, 12)):
            x = rng.randint(1, capacity)
            counts[x] = counts.get(x, 0) + rng.randint(1, 3)
        used = pack.fullest(counts, capacity)
        assert all(n <= counts[x] for x, n in used.items()) and max(counts) in used
        assert sum(x * n for x, n in used.items()) == best_fill(counts, capacity)


def best_fit_decreasing(counts, capacity):
    rooms = [0] * (capacity + 1)  # open bins by what they still hold
    bins = 0
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        room = next((r for r in range(x, capacity + 1) if rooms[r]), None)
        if room is None:
            bins, room = bins + 1, capacity
        else:
            rooms[room] -= 1
        rooms[room - x] += 1
    return bins


def test_plan_uses_every_piece_once():
    rng = random.Random(10)
    counts = {rng.randint(1, 4096): rng.randint(1, 50) for _ in range(300)}
    spent, bins = {}, 0
    for used, n in pack.plan(counts):
        assert sum(x * k for x, k in used.items()) <= 4096
        bins += n
        for x, k in used.items():
            spent[x] = spent.get(x, 0) + n * k
    assert spent == counts
    assert bins <= best_fit_decreasing(counts, 4096)


@pytest.mark.parametrize("rank_rows", [500, 2])
def test_packed_table(docs_of, words, monkeypatch, rank_rows):
    monkeypatch.setattr(pack, "RANK_ROWS", rank_rows)
    texts = [(i, " ".join(words(20 + i % 7, i))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, " ".join(words(9000, 5))), (None, "x"), (None, "x"), (7, texts[7][1])]
    texts += [(200 + i, "same old text") for i in range(30)]
    rows = pack.pack(docs_of(texts), WORDS).collect()
    want = {}
    for i, t in texts:
        ids = np.array([*library_ids(WORDS, t or ""), 1], "<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            key = (i, p, at, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    got, sequences = {}, {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(sequences) == -(-total // 4096)
    assert pack.pack(docs_of(texts).where("false"), WORDS).count() == 0
