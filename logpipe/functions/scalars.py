"""Small scalar helpers shared by the parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(s: Column) -> Column:
    """Integer or 0 (ANSI-safe: ``try_cast`` never raises)."""
    return F.coalesce(s.try_cast("bigint"), F.lit(0).cast("bigint"))


def to_size(s: Column) -> Column:
    """Byte count; ``-`` or empty -> 0."""
    return F.coalesce(F.trim(s).try_cast("bigint"), F.lit(0).cast("bigint"))


def looks_like_json(raw: Column) -> Column:
    """First non-blank character is ``{``."""
    return F.ltrim(raw).startswith("{")


def quote_count_at_least_two(raw: Column) -> Column:
    """Two ``"`` anywhere, found with two scans and no allocation."""
    first = F.instr(raw, '"')
    return (first > 0) & (F.call_function("locate", F.lit('"'), raw, first + 1) > 0)


def contains_any(raw: Column, words: tuple[str, ...]) -> Column:
    cond = None
    for w in words:
        c = raw.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def source_or_empty(source: Column) -> Column:
    """The source label, ``""`` when absent."""
    return F.coalesce(source, F.lit(""))
