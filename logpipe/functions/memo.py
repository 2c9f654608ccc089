"""Reuse immutable literal Columns (lookup tables, typed NULLs) within one driver JVM.

Building a literal map of twenty entries is some forty driver-to-JVM calls;
the resulting Column is immutable, so it is built once per SparkContext.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column

_CACHE: dict[tuple, Column] = {}


def jvm_cached(key: str, build: Callable[[], Column]) -> Column:
    sc = SparkContext._active_spark_context
    if sc is None:
        return build()
    k = (sc.applicationId, key)
    col = _CACHE.get(k)
    if col is None:
        col = _CACHE[k] = build()
    return col
