"""Ordered field transforms (add / set / rename / remove / expression)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpipe.functions.regexes import names_matching, user_regex
from logpipe.operators import fields
from logpipe.schema import ATTRS, PROMOTED, empty_attrs

ACTIONS = ("add", "set", "rename", "remove")


@dataclass(frozen=True)
class Transform:
    action: str
    field: str
    to: str | None = None
    value: str | None = None
    expr: str | None = None  # T8: Spark SQL expression instead of a static value

    def validate(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"transform: unknown action {self.action!r} (valid: {'|'.join(ACTIONS)})")
        if not self.field:
            raise ValueError(f"transform {self.action}: missing field")
        if self.action == "rename" and not self.to:
            raise ValueError("transform rename: missing 'to'")
        if self.field.startswith(".") and self.action != "remove":
            raise ValueError(f"transform {self.action}: regex fields only for remove")


class _Keys:
    """What a run of transforms makes of top-level keys, worked out before any map is rebuilt.

    Each touched key is held as (present, value) over the event as it came;
    ``None`` for present means absent for sure, ``True`` present for sure.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.state: dict[str, tuple] = {}

    def get(self, key: str) -> tuple:
        return self.state.get(key) or (fields.present(key), fields.top_variant(key))

    def add(self, key: str, value) -> None:
        self.state[key] = (True, value)

    def remove(self, key: str) -> None:
        self.state[key] = (None, None)

    def rename(self, key: str, to: str) -> None:
        """Move a key when present (JSON null moves too), overwriting the target."""
        if key == to:
            return
        (there, value), (before, old) = self.get(key), self.get(to)
        if there is None:
            return
        if there is True or before is None:
            self.state[to] = (there, value)
        else:
            self.state[to] = (True if before is True else there | before, F.when(there, value).otherwise(old))
        self.remove(key)

    def apply(self) -> DataFrame:
        """One projection: promoted columns by type, one rebuild of ``attrs`` for everything else."""
        updates, maps = {}, []
        for key, (there, value) in self.state.items():
            entry = None if there is None else F.create_map(F.lit(key), value)
            here = F.lit(True) if there is True else there
            if key in PROMOTED:
                null = F.lit(None).cast(PROMOTED[key])
                typed = null if there is None else fields.strict_typed(value, PROMOTED[key])
                updates[key] = null if there is None else F.when(here, typed)
                here = None if there is None else here & typed.isNull()
            if entry is not None:
                maps.append(entry if there is True and key not in PROMOTED else
                            F.when(here, entry).otherwise(empty_attrs()))
        rest = fields.without_keys(F.col(ATTRS), list(self.state))
        updates[ATTRS] = F.map_concat(rest, *maps) if maps else rest
        return self.df.withColumns(updates) if self.state else self.df


def _literal_name(pattern: str) -> str | None:
    """The one name that an anchored pattern without special characters matches."""
    m = re.fullmatch(r"\^(\w+)\$", pattern, re.ASCII)
    return m.group(1) if m else None


def _plain(t: Transform) -> bool:
    """Whether a transform concerns whole top-level keys only."""
    if t.action == "remove" and t.field.startswith("."):
        return _literal_name(t.field[1:]) is not None
    return "." not in t.field and "." not in (t.to or "") and t.expr is None


def _fold(df: DataFrame, run: list[Transform]) -> DataFrame:
    """A run of transforms of top-level keys."""
    keys = _Keys(df)
    for t in run:
        if t.action in ("add", "set"):
            keys.add(t.field, fields.literal(t.value or ""))
        elif t.action == "rename":
            keys.rename(t.field, t.to)
        else:
            keys.remove(_literal_name(t.field[1:]) if t.field.startswith(".") else t.field)
    return keys.apply()


def _single(df: DataFrame, t: Transform) -> DataFrame:
    """A transform of nested keys, by expression or by regex."""
    if t.action in ("add", "set"):
        value = F.expr(t.expr).cast("variant") if t.expr is not None else fields.literal(t.value or "")
        return df.withColumns(fields.put(t.field, value))
    if t.action == "rename":
        df = df.withColumns({"_mv_value": fields.get_variant(t.field), "_mv_present": fields.present(t.field)})
        df = df.withColumns(fields.delete(t.field, F.col("_mv_present")))
        df = df.withColumns(fields.put(t.to, F.col("_mv_value"), F.col("_mv_present")))
        return df.drop("_mv_value", "_mv_present")
    if not t.field.startswith("."):
        return df.withColumns(fields.delete(t.field))
    # a leading "." makes the rest a regex on top-level keys
    java = user_regex(df.sparkSession, t.field[1:], "transform.remove")
    names = names_matching(df.sparkSession, java, [n for n in PROMOTED if n in df.columns])
    updates = {name: F.lit(None).cast(PROMOTED[name]) for name in names}
    updates[ATTRS] = F.map_filter(F.col(ATTRS), lambda k, v: ~k.rlike(java))
    return df.withColumns(updates)


def apply_transforms(df: DataFrame, transforms: list[Transform]) -> DataFrame:
    """Apply in list order; consecutive ones of top-level keys rebuild ``attrs`` once."""
    run: list[Transform] = []
    for t in transforms:
        t.validate()
        if _plain(t):
            run.append(t)
            continue
        df, run = _single(_fold(df, run), t), []
    return _fold(df, run)
