"""The event table: promoted typed columns plus an open ``attrs`` map.

The value of a key is its promoted column when that is non-NULL, else
``attrs[key]`` (any JSON value, kept verbatim as VARIANT).  JSON events keep
the whole object in ``attrs``; the well-known keys are also promoted when
their value has the column's type.  ``{"level": 30}`` therefore has
``level`` NULL and ``attrs['level'] = 30``; ``{"level": "warn"}`` has
``level = 'warn'`` (and the same text in ``attrs``).  Presence of a key is
``col IS NOT NULL OR map_contains_key(attrs, key)``; every transform that
writes or removes a key updates both places.  Parsing uses no lambda
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Promoted columns, in output order.
EVENT_COLUMNS: tuple[tuple[str, str], ...] = (
    ("timestamp", "timestamp"),
    ("level", "string"),
    ("message", "string"),
    ("source", "string"),
    ("host", "string"),
    ("raw", "string"),
    # syslog
    ("program", "string"),
    ("pid", "bigint"),
    ("facility", "bigint"),
    ("severity", "int"),
    ("msgid", "string"),
    ("structured_data", "string"),
    # access log
    ("ident", "string"),
    ("user", "string"),
    ("method", "string"),
    ("uri", "string"),
    ("proto", "string"),
    ("status", "bigint"),
    ("size", "bigint"),
    ("referer", "string"),
    ("user_agent", "string"),
)
PROMOTED: dict[str, str] = dict(EVENT_COLUMNS)
ATTRS = "attrs"
ATTRS_TYPE = "map<string,variant>"
FORMAT = "format"
EVENT_NAMES = tuple(n for n, _ in EVENT_COLUMNS) + (ATTRS, FORMAT)

# Columns of a line table (input of every parser).
LINE_RAW = "raw"
LINE_SOURCE = "source"
LINE_FILE = "file_path"

# Values of the ``format`` column.
FORMATS = ("json", "rfc5424", "rfc3164", "access", "error", "raw", "unparsed")


def empty_attrs() -> Column:
    from logpipe.functions.memo import jvm_cached
    return jvm_cached("empty_attrs", lambda: F.create_map().cast(ATTRS_TYPE))


def typed_null(name: str) -> Column:
    from logpipe.functions.memo import jvm_cached
    return jvm_cached("null:" + PROMOTED[name], lambda: F.lit(None).cast(PROMOTED[name]))


def carry_columns(df: DataFrame) -> list[str]:
    """Input columns passed through a parser untouched (ids, file path, flags)."""
    reserved = set(EVENT_NAMES)
    return [c for c in df.columns if c not in reserved]


def event_select(df: DataFrame, values: dict[str, Column], carry: list[str]) -> DataFrame:
    """Project ``df`` onto the canonical event schema.

    Promoted columns missing from ``values`` become typed NULLs (Catalyst
    prunes them when a job does not read them).
    """
    cols = [F.col(c) for c in carry]
    for name, dtype in EVENT_COLUMNS:
        expr = values.get(name)
        cols.append((expr.cast(dtype) if expr is not None else typed_null(name)).alias(name))
    cols.append(values.get(ATTRS, empty_attrs()).alias(ATTRS))
    cols.append(values[FORMAT].alias(FORMAT))
    return df.select(*cols)


def stage(df: DataFrame, keep: list[str], exprs: dict[str, Column]) -> DataFrame:
    """Compute costly per-line intermediates exactly once.

    Catalyst pushes filters below projections by substituting aliases, so a
    filter on a parsed field would re-run the JSON parse or regex it depends
    on.  Computing the intermediates inside a one-row ``inline`` generator
    keeps them in a codegen'd ``Generate`` node that filters on its output
    cannot cross, while filters on the untouched input columns still can.
    """
    struct = F.struct(*[e.alias(k) for k, e in exprs.items()])
    return df.select(*keep, F.inline(F.array(struct)))
