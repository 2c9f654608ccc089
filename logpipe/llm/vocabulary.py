"""Public tokenizer files: the library's tokenizer and its merges alone.

Splitting texts is cheap; what costs time in a tokenizer is building its
result objects.  Where a file's merges are in the order of their ids, the same
merges can be run by rank alone, which gives the same ids several times
faster; where they are not, the library does all the work.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already

#: Stands for the end of a word inside the ranked merges; no such character may be in a word.
_END = "\x01"


#: Characters of plain Latin text, which every Unicode version puts into the classes below.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_plain = re.compile(f"[\\t\\n\\r -~\u00a1-\u00ac\u00ae-\u00bf\u00d7\u00f7{_LETTERS}]*")


def is_plain(text: str) -> bool:
    return _plain.fullmatch(text) is not None


def plain_splitter(pattern: str):
    """``findall`` of a splitting pattern with its Unicode classes narrowed to plain Latin text."""
    for name, members in ((r"[\p{L}]", f"[{_LETTERS}]"), (r"[\p{N}]", f"[{_NUMBERS}]"),
                          (r"\s\p{L}\p{N}", rf"\s{_LETTERS}{_NUMBERS}"),
                          (r"\p{L}", f"[{_LETTERS}]"), (r"\p{N}", f"[{_NUMBERS}]")):
        pattern = pattern.replace(name, members)
    return re.compile(pattern).findall


@lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer without truncation and padding."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """Strings that the library takes out of a text before it splits the rest."""
    return tuple(sorted((a["content"] for a in _file(path)["added_tokens"]), key=len, reverse=True))


def _byte_of() -> dict[str, int]:
    """Which byte a printable stand-in character of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merges of a byte-level file, run by rank; ``usable`` says whether that is sure to be right."""

    def __init__(self, path: str):
        import tiktoken
        model, special = _file(path)["model"], set(special_strings(path))
        suffix = model.get("end_of_word_suffix") or ""
        byte_of, ranks = _byte_of(), {}
        for token, i in model["vocab"].items():
            if token not in special:
                end = bool(suffix) and token.endswith(suffix)
                body = token[:-len(suffix)] if end else token
                ranks[bytes(byte_of[c] for c in body) + _END.encode() * end] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = 512 if suffix else 256
        self.usable = len(ranks) == len(merges) + first and all(
            model["vocab"].get(a + b) == first + i for i, (a, b) in enumerate(merges))
        self.suffix = suffix
        self._encoding = tiktoken.Encoding(
            "merges", pat_str=f"[^{_END}]+{_END}" if suffix else "(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self._ends = np.zeros(max(ranks.values()) + 1, bool)
        self._ends[[i for token, i in ranks.items() if token.endswith(_END.encode())]] = True

    def count(self, piece: str) -> int:
        """Tokens of one pre-token (vocabularies without word ends)."""
        return len(self._encoding.encode_ordinary(piece))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and where each word's ids end (vocabularies with word ends)."""
        ids = np.array(self._encoding.encode_ordinary(_END.join(words) + _END), "<u4")
        return ids, np.flatnonzero(self._ends[ids]) + 1


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)
