"""Include / exclude regex, level threshold, drop rule, expression.

All conditions form one conjunction evaluated in one ``df.filter``.
Conditions that read only ``raw`` are pushed by Catalyst below the parse
for formats whose ``raw`` is the line itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logpipe.functions.levels import level_rank, threshold_rank
from logpipe.functions.regexes import user_regex
from logpipe.operators import fields


@dataclass(frozen=True)
class DropRule:
    field: str
    value: str


@dataclass(frozen=True)
class FilterSpec:
    include_regex: str | None = None
    exclude_regex: str | None = None
    min_level: str | None = None
    drop: DropRule | None = None
    expr: str | None = None  # any Spark SQL predicate over event columns

    def is_empty(self) -> bool:
        return not (self.include_regex or self.exclude_regex or threshold_rank(self.min_level) > 0
                    or (self.drop and self.drop.field) or self.expr)


def _raw_text() -> Column:
    # Missing or non-string raw is matched as "".
    return F.coalesce(F.col("raw"), F.lit(""))


def include(spark: SparkSession | None, pattern: str) -> Column:
    """unanchored match on ``raw``."""
    return _raw_text().rlike(user_regex(spark, pattern, "filter.includeRegex"))


def exclude(spark: SparkSession | None, pattern: str) -> Column:
    """drop when ``raw`` matches."""
    return ~_raw_text().rlike(user_regex(spark, pattern, "filter.excludeRegex"))


def min_level(level: str | None) -> Column | None:
    """rank(level) >= rank(threshold); no threshold above debug means no test."""
    rank = threshold_rank(level)
    if rank <= 0:
        return None
    return level_rank(fields.get_string("level")) >= F.lit(rank)


def drop_rule(rule: DropRule | None) -> Column | None:
    """drop when the field is a string equal to ``value``."""
    if rule is None or not rule.field:
        return None
    return ~F.coalesce(fields.get_string(rule.field) == F.lit(rule.value), F.lit(False))


def expression(expr: str | None) -> Column | None:
    """arbitrary predicate; NULL counts as false."""
    if not expr:
        return None
    return F.coalesce(F.expr(expr).cast("boolean"), F.lit(False))


def condition(spec: FilterSpec, spark: SparkSession | None = None) -> Column:
    """the conjunction (``TRUE`` for an empty spec). Bad regexes raise here."""
    parts = []
    if spec.include_regex:
        parts.append(include(spark, spec.include_regex))
    if spec.exclude_regex:
        parts.append(exclude(spark, spec.exclude_regex))
    for c in (min_level(spec.min_level), drop_rule(spec.drop), expression(spec.expr)):
        if c is not None:
            parts.append(c)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def apply_filter(df: DataFrame, spec: FilterSpec) -> DataFrame:
    if spec.is_empty():
        return df
    return df.filter(condition(spec, df.sparkSession))
