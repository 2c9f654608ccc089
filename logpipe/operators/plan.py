"""Parse plans: staged intermediates + per-column values, and how to run them.

A plan holds a list of *stages* (dicts of costly intermediate columns; a
later stage may read an earlier one), an ``ok`` condition and the event
values.  A value is either a Column or the name of an input line column
passed through unchanged — pass-through columns stay plain attributes, so
filters on ``raw`` still reach below the parse (and down to the scan).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpipe.schema import (
    ATTRS, EVENT_COLUMNS, FORMAT, LINE_RAW, LINE_SOURCE, PROMOTED, carry_columns, empty_attrs,
    event_select, stage, typed_null,
)

Value = Column | str


@dataclass
class ParsePlan:
    stages: list[dict[str, Column]] = field(default_factory=list)
    ok: Column | None = None
    values: dict[str, Value] = field(default_factory=dict)


def _as_col(name: str, v: Value | None) -> Column:
    if v is None:
        if name == ATTRS:
            return empty_attrs()
        return typed_null(name) if name in PROMOTED else F.lit(None).cast("string")
    if isinstance(v, str):
        return F.col(v)
    return v


def unparsed_values() -> dict[str, Value]:
    """A line no parser accepted keeps only ``raw`` and ``source``."""
    return {"raw": LINE_RAW, "source": LINE_SOURCE, FORMAT: F.lit("unparsed")}


def merge_stages(plans: list[ParsePlan]) -> list[dict[str, Column]]:
    depth = max((len(p.stages) for p in plans), default=0)
    merged: list[dict[str, Column]] = []
    for i in range(depth):
        d: dict[str, Column] = {}
        for p in plans:
            if i < len(p.stages):
                d.update(p.stages[i])
        merged.append(d)
    return merged


def choose(branches: list[tuple[Column, dict[str, Value]]], default: dict[str, Value]) -> dict[str, Value]:
    """Per column: value of the first branch whose condition holds, else ``default``."""
    names = [n for n, _ in EVENT_COLUMNS] + [ATTRS, FORMAT]
    out: dict[str, Value] = {}
    for name in names:
        vals = [b.get(name) for _, b in branches] + [default.get(name)]
        if all(isinstance(v, str) for v in vals) and len(set(vals)) == 1:
            out[name] = vals[0]
            continue
        if all(v is None for v in vals):
            continue
        expr = None
        for (cond, b) in branches:
            v = _as_col(name, b.get(name))
            expr = F.when(cond, v) if expr is None else expr.when(cond, v)
        out[name] = expr.otherwise(_as_col(name, default.get(name)))
    return out


# Heavy values, computed last and in this order (a value may read an earlier one:
# the JSON attrs reads the parsed timestamp).
HEAVY = ("_v_timestamp", "_v_attrs")
CHUNK = 4


def _chunks(computed: dict[str, Column]) -> list[dict[str, Column]]:
    """Split the value projection so each generated method stays JIT-sized.

    Whole-stage codegen gives each operator's row handling its own method;
    small groups of light values (four per stage measured best), then one stage per heavy value (timestamp
    layouts, attrs), keep every method under the JIT's huge-method limit.
    Light values come first, so a filter on level, message or raw is placed
    by Catalyst before the heavy stages and dropped lines never pay for them.
    """
    rest = [k for k in computed if k not in HEAVY]
    out = [{k: computed[k] for k in rest[i:i + CHUNK]} for i in range(0, len(rest), CHUNK)]
    out += [{k: computed[k]} for k in HEAVY if k in computed]
    return out


def run(df: DataFrame, plan: ParsePlan) -> DataFrame:
    """Lines -> events: stages as Generate nodes, then one projection."""
    carry = carry_columns(df)
    keep = carry + [LINE_RAW, LINE_SOURCE]
    cur = df
    staged: list[str] = []
    for st in plan.stages:
        if st:
            cur = stage(cur, keep + staged, st)
            staged += list(st)
    computed = {f"_v_{k}": v for k, v in plan.values.items() if isinstance(v, Column)}
    done: list[str] = []
    for chunk in _chunks(computed):
        # earlier intermediates stay visible until the last chunk is computed
        cur = stage(cur, keep + staged + done, chunk)
        done += list(chunk)
    cur = cur.select(*keep, *done)
    values = {k: (F.col(f"_v_{k}") if isinstance(v, Column) else F.col(v))
              for k, v in plan.values.items()}
    return event_select(cur, values, carry)
