"""A run-compressed Burrows-Wheeler index of byte strings, and the long repeats it shows.

The suffixes of all strings are sorted together; the transform is the byte
before each of them.  Of the sorted order only the borders of the transform's
runs are kept, with the text positions sampled there (a run's first row and
the row above it, which is the last of the run before).

The matching statistics of the collection against itself follow from these
samples alone.  Let l(x) be the longest match of the suffix at x with the one
sorted just above it.  Where the transform does not change, l falls by one
from a position to the next, and so does the partner move along; so l has to
be worked out at run borders only, and a border match of l bytes stands for
all positions inside it.  A string of a given length that starts anywhere
else, too, lies in the match of one border or in the partner of one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sorted suffixes of strings in a row; ``rest`` counts the symbols up to each one's end (symbol 0).

    Suffixes end with their string; equal ones are sorted by position.
    """
    n = len(text)
    used = np.unique(text)
    bits = max(1, int(len(used) - 1).bit_length())
    code = np.searchsorted(used, text).astype(np.int64)
    h = 62 // bits
    key = np.zeros(n, np.int64)
    for j in range(h):
        key <<= bits
        if j < n:
            key[:n - j] |= np.where(rest[:n - j] >= j, code[j:], 0)
    sa = np.argsort(key)
    key = key[sa]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(slots):
        pos = sa[slots]
        # a suffix that has ended comes before longer ones, by its position
        after = np.where(rest[pos] >= h, rank[np.minimum(pos + h, n - 1)] + n, pos)
        key = rank[pos] * (2 * n) + after
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[slots] = pos
        head = np.r_[True, key[1:] != key[:-1]]
        rank[pos] = slots[np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))]
        slots = slots[~(head & np.r_[head[1:], True])]
        h *= 2
    return sa


def _words(raw: bytes) -> np.ndarray:
    """The eight bytes from every position on as one number each (zeros past the end)."""
    out = np.empty(len(raw), np.uint64)
    padded = raw + bytes(16)
    for o in range(min(8, len(raw))):
        out[o::8] = np.frombuffer(padded, "<u8", (len(raw) - o + 7) // 8, o)
    return out


def _match(words: np.ndarray, rest: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of the suffixes at x and y; 0 where it is shorter than ``least``."""
    out = np.zeros(len(x), np.int64)
    room = np.minimum(rest[x], rest[y])
    live = np.flatnonzero(room >= least)
    done = 0
    while len(live):
        diff = words[x[live] + done] ^ words[y[live] + done]
        # bytes equal before the lowest differing one, no further than either string goes
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        length = np.minimum(done + same, room[live])
        ends = (same < 8) | (length < done + 8)
        out[live[ends]] = length[ends]
        live = live[~ends]
        done += 8
    return np.where(out >= least, out, 0)


def borders(bodies: list[bytes]):
    """(raw, rest, x, y): all strings in a row, and the samples on both sides of every run border."""
    raw = b"\0".join(bodies) + b"\0"
    sizes = np.array([len(b) for b in bodies], np.int64) + 1
    ends = np.cumsum(sizes) - 1
    n = len(raw)
    rest = np.repeat(ends, sizes) - np.arange(n)
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    sa = suffix_array(symbols, rest)
    before = symbols[sa - 1]  # the first string's start wraps round to the last end
    border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0))
    return raw, rest, sa[border + 1], sa[border]


def repeats(bodies: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """Per string the maximal (start, stop) covered by substrings of ``least`` bytes that also start elsewhere."""
    raw, rest, x, y = borders(bodies)
    length = _match(_words(raw), rest, x, y, least)
    hit = length > 0
    change = np.zeros(len(raw) + 1, np.int64)
    for at in (x[hit], y[hit]):
        np.add.at(change, at, 1)
        np.add.at(change, at + length[hit], -1)
    # strings are kept apart by their ends, which nothing covers
    covered = np.diff(np.r_[0, np.cumsum(change[:-1]) > 0, 0].astype(np.int8))
    starts, stops = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    base = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    owner = np.searchsorted(base, starts, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for o, a, b in zip(owner.tolist(), (starts - base[owner]).tolist(), (stops - base[owner]).tolist()):
        out[o].append((a, b))
    return out
