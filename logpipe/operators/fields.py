"""Reading and writing event keys across promoted columns and ``attrs``.

Field names are build-time constants, so every accessor resolves to a fixed
column expression.  A dotted name ``a.b.c`` addresses nested JSON objects
under the top-level key ``a`` (T6/T7); a name without dots is a flat key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logpipe.functions.encode import _as_variant
from logpipe.schema import ATTRS, ATTRS_TYPE, PROMOTED, empty_attrs

OBJ_TYPE = ATTRS_TYPE


def split_path(field: str) -> list[str]:
    if not field:
        raise ValueError("empty field name")
    parts = field.split(".")
    if any(p == "" for p in parts):
        raise ValueError(f"bad field path {field!r}")
    return parts


def _json_path(keys: list[str]) -> str:
    return "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)


def attr(key: str) -> Column:
    return F.try_element_at(F.col(ATTRS), F.lit(key))


def has_attr(key: str) -> Column:
    return F.map_contains_key(F.col(ATTRS), key)


def present(field: str) -> Column:
    """True when the event has the key (JSON null counts as present)."""
    parts = split_path(field)
    top = parts[0]
    if len(parts) == 1:
        if top in PROMOTED:
            return F.col(top).isNotNull() | has_attr(top)
        return has_attr(top)
    node = F.try_variant_get(top_variant(top), _json_path(parts[1:-1]), OBJ_TYPE)
    return F.coalesce(F.map_contains_key(node, parts[-1]), F.lit(False))


def top_variant(key: str) -> Column:
    """Value of a top-level key as VARIANT (promoted column wins)."""
    if key in PROMOTED:
        return F.when(F.col(key).isNotNull(), _as_variant(key, PROMOTED[key])).otherwise(attr(key))
    return attr(key)


def get_variant(field: str) -> Column:
    """Value at a (dotted) field as VARIANT, NULL when absent."""
    parts = split_path(field)
    v = top_variant(parts[0])
    if len(parts) == 1:
        return v
    return F.try_variant_get(v, _json_path(parts[1:]), "variant")


def get_string(field: str) -> Column:
    """Value when it is a string, else NULL (the reference's ``.(string)`` test)."""
    parts = split_path(field)
    if len(parts) == 1 and parts[0] in PROMOTED and PROMOTED[parts[0]] == "string":
        # A string value of a promoted string key always lives in its column
        # (parse promotes strings; put/rename keep them there), so attrs can
        # only hold a non-string for it.  Reading the column alone also lets
        # filters on level/message/raw run before the attrs stage.
        return F.col(parts[0])
    if len(parts) == 1 and parts[0] in PROMOTED:
        return _variant_string(attr(parts[0])) if parts[0] != "timestamp" else F.when(
            F.col(parts[0]).isNull(), _variant_string(attr(parts[0])))
    return _variant_string(get_variant(field))


def _variant_string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def strict_typed(v: Column, dtype: str) -> Column:
    """VARIANT -> promoted column type, NULL unless the JSON type matches exactly."""
    kind = F.schema_of_variant(v)
    if dtype == "string":
        return F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    if dtype in ("int", "bigint"):
        return F.when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), F.try_variant_get(v, "$", dtype))
    if dtype == "timestamp":
        return F.when(kind == "TIMESTAMP", F.try_variant_get(v, "$", "timestamp"))
    raise ValueError(dtype)


def without_key(m: Column, key: str) -> Column:
    """``m`` minus one key, with array functions only (lambdas run interpreted)."""
    keys, vals = F.map_keys(m), F.map_values(m)
    pos = F.array_position(keys, F.lit(key)).cast("int")
    n = F.size(m)

    def cut(arr: Column) -> Column:
        return F.concat(F.slice(arr, F.lit(1), pos - 1), F.slice(arr, pos + 1, n - pos))
    return F.when(pos == 0, m).otherwise(F.map_from_arrays(cut(keys), cut(vals)))


def without_keys(attrs: Column, keys: list[str]) -> Column:
    """``attrs`` minus some keys: array functions for one or two, one filtering pass for more."""
    keys = list(dict.fromkeys(keys))
    if len(keys) > 2:
        return F.map_filter(attrs, lambda k, v: ~k.isin(keys))
    for k in keys:
        attrs = without_key(attrs, k)
    return attrs


def put(field: str, value: Column, when: Column | None = None) -> dict[str, Column]:
    """Column updates that set ``field`` to VARIANT ``value`` (where ``when`` holds).

    A promoted column takes the value when its JSON type matches the column
    type; otherwise the column is cleared and the value goes to ``attrs``.
    """
    parts = split_path(field)
    top = parts[0]
    cond = F.lit(True) if when is None else when
    attrs = F.col(ATTRS)
    if len(parts) > 1:
        value = set_path(top_variant(top), parts[1:], value)
    updates: dict[str, Column] = {}
    if top in PROMOTED:
        typed = strict_typed(value, PROMOTED[top])
        updates[top] = F.when(cond, typed).otherwise(F.col(top))
        new_attrs = F.when(typed.isNull(), F.map_concat(attrs, F.create_map(F.lit(top), value))) \
            .otherwise(without_key(attrs, top))
    else:
        # the session's LAST_WIN key policy makes this a replace
        new_attrs = F.map_concat(attrs, F.create_map(F.lit(top), value))
    updates[ATTRS] = F.when(cond, new_attrs).otherwise(attrs)
    return updates


def delete(field: str, when: Column | None = None) -> dict[str, Column]:
    parts = split_path(field)
    top = parts[0]
    cond = F.lit(True) if when is None else when
    if len(parts) > 1:
        parent = top_variant(top)
        return put(top, delete_path(parent, parts[1:]), cond & present(field))
    updates: dict[str, Column] = {}
    if top in PROMOTED:
        updates[top] = F.when(cond, F.lit(None).cast(PROMOTED[top])).otherwise(F.col(top))
    updates[ATTRS] = F.when(cond, without_keys(F.col(ATTRS), [top])).otherwise(F.col(ATTRS))
    return updates


def _as_object(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", OBJ_TYPE), empty_attrs())


def set_path(obj: Column, keys: list[str], value: Column) -> Column:
    """``obj`` with ``keys`` set to ``value``; missing or non-object parents become objects."""
    m = _as_object(obj)
    k = keys[0]
    inner = value if len(keys) == 1 else set_path(F.try_element_at(m, F.lit(k)), keys[1:], value)
    return F.to_variant_object(F.map_concat(m, F.create_map(F.lit(k), inner)))


def delete_path(obj: Column, keys: list[str]) -> Column:
    m = _as_object(obj)
    k = keys[0]
    rest = without_key(m, k)
    if len(keys) == 1:
        return F.to_variant_object(rest)
    child = F.try_element_at(m, F.lit(k))
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(k), delete_path(child, keys[1:]))))


def literal(value: str) -> Column:
    return F.lit(value).cast("variant")
