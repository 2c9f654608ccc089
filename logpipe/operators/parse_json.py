"""Strict JSON Lines.

A line is an event iff it is exactly one JSON object (Go ``json.Unmarshal``
semantics): no trailing text, no single quotes, no NaN, duplicate keys keep
the last value.  Spark's JSON readers ignore trailing text, so the line is
parsed wrapped as ``[line]``: the object must be element 0 and there must be
no element 1.  ``[line]`` can still be closed early by a ``]`` inside the
line (``{"a":1}] x``); only lines containing ``]`` pay for a second parse as
``{"x":line}``, which fails on any such early close.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logpipe.functions.timestamps import parse_timestamp
from logpipe.operators.plan import ParsePlan
from logpipe.schema import ATTRS, FORMAT, LINE_RAW, LINE_SOURCE, empty_attrs

# Alias keys copied to the well-known keys when absent (first present wins).
ALIASES: dict[str, tuple[str, ...]] = {
    "message": ("msg", "log"),
    "level": ("lvl",),
    "timestamp": ("ts", "time"),
    "source": ("logger",),
}
PROMOTED_JSON_KEYS = ("timestamp", "level", "message", "source", "raw", "host")
_STAGED = {k: f"_j_{k}" for k in PROMOTED_JSON_KEYS}
_TS_TEXT = "_j_ts_text"


def json_gate(strict_first_byte: bool) -> Column:
    raw = F.col(LINE_RAW)
    if strict_first_byte:
        return raw.startswith("{")
    return raw.startswith("{") | raw.rlike(r"^[ \t\r\n]+\{")


def json_object(raw: Column, gate: Column | None = None) -> tuple[Column, Column]:
    """(stage-1 array parse, stage-2 ``map<string,variant>`` or NULL)."""
    arr = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    if gate is not None:
        arr = F.when(gate, arr)
    ja = F.col("_j_arr")
    closed_at_end = (~raw.contains("]")) | F.try_parse_json(
        F.concat(F.lit('{"x":'), raw, F.lit("}"))).isNotNull()
    obj = F.when(ja.isNotNull() & F.try_variant_get(ja, "$[1]", "variant").isNull() & closed_at_end,
                 F.try_variant_get(ja, "$[0]", "map<string,variant>"))
    return arr, obj


def string_value(v: Column) -> Column:
    """The text of a VARIANT string; NULL for any other JSON type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_plan(strict_first_byte: bool = False, implied_year=None) -> ParsePlan:
    raw = F.col(LINE_RAW)
    arr, obj = json_object(raw, json_gate(strict_first_byte))
    m = F.col("_j_map")

    def pres(k: str) -> Column:
        return F.map_contains_key(m, k)

    def get(k: str) -> Column:
        return F.try_element_at(m, F.lit(k))

    def pick(dst: str) -> Column:
        expr = F.when(pres(dst), get(dst))
        for a in ALIASES.get(dst, ()):
            expr = expr.when(pres(a), get(a))
        return expr

    def any_present(dst: str) -> Column:
        cond = pres(dst)
        for a in ALIASES.get(dst, ()):
            cond = cond | pres(a)
        return cond

    # Alias resolution first (VARIANT values), then the typed conversions read
    # those columns: each stage stays small enough for the JIT, and the
    # timestamp text gets its own stage because the layout chain reads it many
    # times inside CASE branches, where Spark does not share subexpressions.
    picked = {f"_jv_{k}": (pick(k) if k in ALIASES else get(k)) for k in PROMOTED_JSON_KEYS}
    pv = {k: F.col(f"_jv_{k}") for k in PROMOTED_JSON_KEYS}
    typed = {
        _TS_TEXT: string_value(pv["timestamp"]),
        _STAGED["level"]: string_value(pv["level"]),
        _STAGED["message"]: string_value(pv["message"]),
        _STAGED["source"]: F.when(any_present("source"), string_value(pv["source"]))
                            .otherwise(F.col(LINE_SOURCE)),
        _STAGED["raw"]: F.when(pres("raw"), string_value(pv["raw"])).otherwise(raw),
        _STAGED["host"]: string_value(pv["host"]),
    }

    # attrs: the object verbatim, plus alias copies the promoted column could not hold
    # (``{"ts": 17}`` gets ``timestamp: 17`` as in the reference).
    extras, any_extra = [], None
    for dst, aliases in ALIASES.items():
        alias_present = None
        for a in aliases:
            alias_present = pres(a) if alias_present is None else (alias_present | pres(a))
        promoted = F.col("_v_timestamp") if dst == "timestamp" else F.col(_STAGED[dst])
        cond = (~pres(dst)) & alias_present & promoted.isNull()
        extras.append(F.when(cond, F.create_map(F.lit(dst), pv[dst])).otherwise(empty_attrs()))
        any_extra = cond if any_extra is None else (any_extra | cond)
    attrs = F.when(any_extra, F.map_concat(m, *extras)).otherwise(m)

    values = {k: F.col(v) for k, v in _STAGED.items() if k != "timestamp"}
    # the layout chain is a value of its own, computed after the light values
    # (and read by attrs above as the event's ``_v_timestamp``)
    values["timestamp"] = parse_timestamp(F.col(_TS_TEXT), implied_year)
    values[ATTRS] = attrs
    values[FORMAT] = F.lit("json")
    return ParsePlan(stages=[{"_j_arr": arr}, {"_j_map": obj}, picked, typed],
                     ok=m.isNotNull(), values=values)
