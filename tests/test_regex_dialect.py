"""User patterns mean what RE2 means, on data and on key names alike."""

import pytest
from helpers import lines_df
from pyspark.sql import functions as F

from logpipe.functions.regexes import re2_to_java, user_regex
from logpipe.operators.parse import parse
from logpipe.operators.transforms import Transform, apply_transforms


@pytest.mark.parametrize("pattern,hits,misses", [
    (r"[a&&b]", ["a", "&", "b"], ["c"]),
    (r"[[]", ["["], ["]"]),
    (r"[]a]", ["]", "a"], ["b"]),
    (r"(?i)ét", ["Ét", "ét"], ["et"]),
    (r"^\s$", ["\t"], ["\x0b"]),
    (r"^[\s]$", ["\f"], ["\x0b"]),
    (r"^[\S]+$", ["\x0b"], ["a b"]),
    (r"x$", ["x"], ["x\n"]),
    (r"(?m)x$", ["x\ny"], ["xy"]),
    (r"[[:alpha:]]+", ["a"], ["1"]),
    (r"[[:^alpha:]]", ["1"], ["a"]),
    (r"^\pL+$", ["é"], ["1"]),
    (r"\p{Greek}", ["α"], ["a"]),
    (r"\P{^Greek}", ["α"], ["a"]),
    (r"(?P<a_b>x)(?P<ab>y)", ["xy"], ["x"]),
    (r"a{,2}", ["a{,2}"], ["aa"]),
    (r"\Qa.b\E+", ["a.b"], ["axb"]),
    (r"\x{e9}\051", ["é)"], ["e)"]),
    (r"a\vb", ["a\x0bb"], ["a\nb"]),
])
def test_patterns(spark, pattern, hits, misses):
    java = user_regex(spark, pattern, "t")
    df = spark.createDataFrame([(x, True) for x in hits] + [(x, False) for x in misses], "x string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", F.col("x").rlike(java).alias("got")).collect())


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"a++", r"\1", r"(?U)a", r"\Z", r"[[:word:", r"a{1001}",
                                     r"[[:nope:]]"])
def test_rejected(pattern):
    with pytest.raises(ValueError):
        re2_to_java(pattern)


def test_remove_uses_the_same_dialect_for_columns_and_attributes(spark):
    events = parse(lines_df(spark, ['{"msg":"x","lvl":"warn","n1":1,"2":2}'], "svc"), "json")
    out = apply_transforms(events, [Transform("remove", ".[[:alpha:]]+")])
    r = out.select("level", "message", "source", F.map_keys("attrs").alias("k")).first()
    assert (r["level"], r["message"], r["source"], r["k"]) == (None, None, None, ["2"])
    r = apply_transforms(events, [Transform("remove", r".^\pL+$")]).select("level", F.map_keys("attrs").alias("k")).first()
    assert r["level"] is None and sorted(r["k"]) == ["2", "n1"]
