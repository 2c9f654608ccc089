"""Token counts by a whole-token shortcut.

Many pre-tokens of ordinary text are themselves vocabulary strings that the
merges build as one token.  Which ones is proved once per vocabulary: a string
counts as proved when it is split off as one pre-token and the library encodes
it alone as one id.  Proved pre-tokens are counted directly; only the rest go
through the merges, each different one once per worker and memory span.
Texts that hold a character whose class the
splitting pattern may see differently from the library are encoded by the
library as a whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.llm.common import prepare, schema
from logpipe.llm.vocabulary import is_plain, library, merges, plain_splitter, special_strings

#: Fixed value: the splitting pattern of byte-level vocabularies of this family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker before it starts afresh.
REMEMBERED = 400_000
#: Characters of a text whose pre-tokens are held at once.
SPAN = 1 << 20
_split, _split_plain = regex.compile(PRE_TOKEN).findall, plain_splitter(PRE_TOKEN)


@lru_cache(maxsize=4)
def proved(path: str) -> frozenset[str]:
    """Vocabulary strings that stand alone as one pre-token and encode as one token."""
    t = library(path)
    texts = {t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())}
    texts = sorted(x for x in texts - set(special_strings(path)) if "\ufffd" not in x and _split(x) == [x])
    codes = t.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(x for x, c in zip(texts, codes) if len(c.ids) == 1)


#: Characters that are blanks to some and not to others.
_UNSURE = "\x1c\x1d\x1e\x1f\x85\u180e\u200b"


@lru_cache(maxsize=1 << 16)
def settled(ch: str) -> bool:
    """Whether the character has been in the same class since Unicode 3.2."""
    now, then = unicodedata.category(ch), unicodedata.ucd_3_2_0.category(ch)
    return then != "Cn" and now[0] == then[0] and ch not in "\x85᠎​"


@lru_cache(maxsize=4)
def _memory(path: str) -> dict[str, int]:
    """Tokens of pre-tokens a worker knows; it lasts from task to task."""
    return dict.fromkeys(proved(path), 1)


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text."""
    special = special_strings(path)
    cut = regex.compile("|".join(map(regex.escape, special))) if special else None
    return [_count(t, path, special, cut) if t else 0 for t in texts]


def _count(text: str, path: str, special: tuple[str, ...], cut) -> int:
    plain = is_plain(text)
    if not merges(path).usable or not plain and not all(map(settled, set(text))):
        return len(library(path).encode(text, add_special_tokens=False).ids)
    n, pieces = 0, [text]
    if any(s in text for s in special):
        n, pieces = len(cut.findall(text)), cut.split(text)
    split, memory = _split_plain if plain else _split, _memory(path)
    for piece in pieces:
        for span in _spans(piece):
            words = split(span)
            got = list(map(memory.get, words))
            if None in got:
                new = {w for w, g in zip(words, got) if g is None}
                if len(memory) + len(new) > REMEMBERED:
                    memory.clear()
                    memory.update(dict.fromkeys(proved(path), 1))
                    new = set(words) - memory.keys()
                count = merges(path).count
                memory.update((w, count(w)) for w in new)
                got = map(memory.__getitem__, words)
            n += sum(got)
    return n


def _spans(text: str):
    """The text in bounded spans, each but the first from a blank after a non-blank on."""
    start = 0
    while len(text) - start > SPAN:
        end = text.find(" ", start + SPAN)
        while end > 0 and (text[end - 1].isspace() or text[end:end + 2].isspace()):
            end = text.find(" ", end + 1)
        if end <= 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``.

    Counts equal the library's for the whole text without added tokens.  NULL
    and empty texts have 0 bytes and 0 tokens; NULL ids and repeated rows are
    carried as they are; an empty table gives an empty one; other columns are
    not read.  One map stage, no shuffle.  ``tokenizer_path`` must be readable
    on every executor.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            n = np.array(count_tokens(b.column("t").to_pylist(), tokenizer_path), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("t"))
    return rows.mapInArrow(run, schema(rows.schema["doc_id"], "n_bytes long", "n_tokens long",
                                       "over_limit boolean"))
