"""Log levels: ranks for threshold filters and syslog name tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from logpipe.functions.memo import jvm_cached

# Fixed values that must equal the reference for identical results.
# Level ranks used by the level threshold (higher = more severe); a missing,
# unknown or non-string level ranks 0.
LEVEL_RANKS: dict[str, int] = {
    "debug": 0, "trace": 0,
    "info": 1, "information": 1, "informational": 1,
    "notice": 2,
    "warn": 3, "warning": 3,
    "error": 4, "err": 4,
    "critical": 5, "crit": 5, "fatal": 5, "severe": 5,
    "panic": 6, "emergency": 6, "emerg": 6, "alert": 6,
}
# Syslog severity number -> level name (index = severity).
SEVERITY_LEVELS: tuple[str, ...] = ("emerg", "alert", "crit", "err", "warn", "notice", "info", "debug")
# Syslog severity and facility names -> numbers.
SEVERITY_CODES: dict[str, int] = {
    "emerg": 0, "emergency": 0, "panic": 0,
    "alert": 1,
    "crit": 2, "critical": 2,
    "err": 3, "error": 3,
    "warn": 4, "warning": 4,
    "notice": 5,
    "info": 6, "information": 6, "informational": 6,
    "debug": 7,
}
FACILITY_CODES: dict[str, int] = {
    "kern": 0, "kernel": 0,
    "user": 1,
    "mail": 2,
    "daemon": 3,
    "auth": 4, "security": 4,
    "syslog": 9,
    "local0": 16, "local1": 17, "local2": 18, "local3": 19,
    "local4": 20, "local5": 21, "local6": 22, "local7": 23,
}
# Canonical name of each rank (the filter table is authoritative).
RANK_NAMES: tuple[str, ...] = ("debug", "info", "notice", "warn", "error", "critical", "emergency")


def _literal_map(d: dict) -> Column:
    key = "map:" + repr(sorted(d.items()))
    return jvm_cached(key, lambda: F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())]))


def _literal_array(items: tuple) -> Column:
    return jvm_cached("array:" + repr(items), lambda: F.array(*[F.lit(n) for n in items]))


def threshold_rank(min_level: str | None) -> int:
    """Rank of a configured threshold; empty or unknown means accept all."""
    if not min_level:
        return 0
    return LEVEL_RANKS.get(min_level.lower(), 0)


def level_rank(level: Column) -> Column:
    """Rank of a level column; NULL/unknown -> 0."""
    return F.coalesce(F.try_element_at(_literal_map(LEVEL_RANKS), F.lower(level)), F.lit(0))


def level_name(rank: Column) -> Column:
    """Canonical level name of a rank (0..6), NULL outside."""
    return F.try_element_at(_literal_array(RANK_NAMES), rank + 1)


def severity_level(severity: Column) -> Column:
    """Syslog severity (0..7) -> level name."""
    return F.try_element_at(_literal_array(SEVERITY_LEVELS), severity + 1)


def severity_code(name: Column) -> Column:
    return F.try_element_at(_literal_map(SEVERITY_CODES), F.lower(name))


def facility_code(name: Column) -> Column:
    return F.try_element_at(_literal_map(FACILITY_CODES), F.lower(name))


def facility_name(facility: Column) -> Column:
    """First listed name of a facility number (NULL for unnamed numbers)."""
    first: dict[int, str] = {}
    for name, code in FACILITY_CODES.items():
        first.setdefault(code, name)
    return F.try_element_at(_literal_map(first), facility.try_cast("int"))
