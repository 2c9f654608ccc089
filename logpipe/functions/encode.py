"""Event rendering: compact/pretty JSON, RFC 3339 strings, index names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logpipe.functions.timestamps import format_rfc3339
from logpipe.schema import ATTRS, EVENT_COLUMNS

PROMOTED_NAMES = {n for n, _ in EVENT_COLUMNS}


def _as_variant(name: str, dtype: str) -> Column:
    col = F.col(name)
    if dtype == "timestamp":
        col = format_rfc3339(col)  # a timestamp cast to VARIANT renders in Spark's own form
    return col.cast("variant")


def event_json(extra: dict[str, Column] | None = None) -> Column:
    """Compact JSON of the whole event with sorted keys, without lambda functions.

    The promoted columns form a struct whose fields are in key order, so
    ``to_json`` (which drops NULL fields) writes them sorted.  A key present in
    both places holds the same value by construction (the parser copies
    strings verbatim and every transform writes or removes both), except a
    JSON ``timestamp``, whose original text is kept; so ``attrs`` wins and
    the promoted copy is left out.  Non-JSON events (empty ``attrs``) are that
    struct alone; for the others it joins ``attrs`` in one VARIANT object,
    which writes its keys sorted at every depth.  ``extra`` entries are added
    only where the key is absent.
    """
    attrs = F.col(ATTRS)

    def has(k: str) -> Column:
        return F.map_contains_key(attrs, k)

    fields = {}
    for n, t in EVENT_COLUMNS:
        col = format_rfc3339(F.col(n)) if t == "timestamp" else F.col(n)
        fields[n] = F.when(has(n), F.lit(None).cast("string" if t == "timestamp" else t)).otherwise(col)
    for k, v in (extra or {}).items():
        taken = has(k) if k not in PROMOTED_NAMES else (has(k) | F.col(k).isNotNull())
        fields[k] = F.when(taken, F.lit(None)).otherwise(v)
    struct_json = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    promoted = F.parse_json(struct_json).cast("map<string,variant>")
    merged = F.to_json(F.to_variant_object(F.map_concat(promoted, attrs)))
    return F.when(F.size(attrs) > 0, merged).otherwise(struct_json)


def event_json_pretty() -> Column:
    """Indented JSON (Jackson's spacing, not Go's)."""
    return F.to_json(F.try_variant_get(F.try_parse_json(event_json()), "$", "map<string,variant>"),
                     {"pretty": "true"})


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD"}


def strftime_to_datetime_pattern(pattern: str) -> str:
    """Translate the strftime subset into a ``date_format`` pattern."""
    out: list[str] = []
    literal: list[str] = []

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append("'" + text + "'")
            literal.clear()

    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "%" and i + 1 < len(pattern):
            code = pattern[i + 1]
            if code == "%":
                literal.append("%")
            elif code in _STRFTIME:
                flush()
                out.append(_STRFTIME[code])
            else:
                raise ValueError(f"unsupported strftime code %{code}")
            i += 2
            continue
        literal.append(ch)
        i += 1
    flush()
    return "".join(out)


def index_name(pattern: str | None, ts: Column | None = None) -> Column:
    """Index of an event: pattern applied to its timestamp (processing time as fallback)."""
    if not pattern:
        return F.lit("logs")
    if not re.search(r"%[^%]", pattern.replace("%%", "")):
        return F.lit(pattern.replace("%%", "%"))
    when = F.coalesce(ts if ts is not None else F.col("timestamp"), F.current_timestamp())
    return F.date_format(when, strftime_to_datetime_pattern(pattern))
