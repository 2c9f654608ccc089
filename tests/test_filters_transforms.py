"""F0-F5 and T0-T8 on small event tables."""

import pytest
from helpers import events_as_dicts, lines_df

from logpipe.operators.filters import DropRule, FilterSpec, apply_filter, condition
from logpipe.operators.parse import parse
from logpipe.operators.transforms import Transform, apply_transforms

LINES = [
    '{"msg":"hello","lvl":"warn","user":"a","env":"x","envoy":"y","n":5,"nested":{"a":{"b":1}}}',
    '{"msg":"healthcheck ok","lvl":"info"}',
    '{"msg":"boom","level":"ERROR"}',
    '{"msg":"num","level":30}',
    "<11>Feb  3 01:02:03 h app[1]: syslog err",
    "plain text line",
]


@pytest.fixture
def events(spark):
    return parse(lines_df(spark, LINES), "auto", implied_year=2026)


def kept_ids(df):
    return sorted(r["line_id"] for r in df.select("line_id").collect())


def test_include_exclude(spark, events):
    assert kept_ids(apply_filter(events, FilterSpec(include_regex="^\\{"))) == [0, 1, 2, 3]
    assert kept_ids(apply_filter(events, FilterSpec(exclude_regex="healthcheck|pulse"))) == [0, 2, 3, 4, 5]


def test_min_level_and_unknown_levels(spark, events):
    # ranks: warn 3, info 1, ERROR 4 (case folded), 30 -> 0, err 4, none -> 0
    assert kept_ids(apply_filter(events, FilterSpec(min_level="warn"))) == [0, 2, 4]
    assert kept_ids(apply_filter(events, FilterSpec(min_level="debug"))) == [0, 1, 2, 3, 4, 5]
    assert kept_ids(apply_filter(events, FilterSpec(min_level="bogus"))) == [0, 1, 2, 3, 4, 5]
    assert kept_ids(apply_filter(events, FilterSpec(min_level="FATAL"))) == []


def test_drop_rule_string_only(spark, events):
    assert kept_ids(apply_filter(events, FilterSpec(drop=DropRule("lvl", "info")))) == [0, 2, 3, 4, 5]
    # a number never equals a string value
    assert kept_ids(apply_filter(events, FilterSpec(drop=DropRule("level", "30")))) == [0, 1, 2, 3, 4, 5]
    assert kept_ids(apply_filter(events, FilterSpec(drop=DropRule("program", "app")))) == [0, 1, 2, 3, 5]


def test_expression_filter(spark, events):
    spec = FilterSpec(expr="try_variant_get(attrs['n'], '$', 'int') = 5 OR format = 'rfc3164'")
    assert kept_ids(apply_filter(events, spec)) == [0, 4]


def test_bad_regex_fails_at_build_time(spark):
    with pytest.raises(ValueError, match="^filter.includeRegex: "):
        condition(FilterSpec(include_regex="(unclosed"), spark)
    with pytest.raises(ValueError, match="^filter.excludeRegex: "):
        condition(FilterSpec(exclude_regex="[z-a]"), spark)


def test_filters_conjunction(spark, events):
    spec = FilterSpec(include_regex="e", exclude_regex="boom", min_level="info")
    assert kept_ids(apply_filter(events, spec)) == [0, 1, 4]


def test_add_set_rename_remove(spark, events):
    out = apply_transforms(events, [
        Transform("add", "service", value="myapp"),
        Transform("set", "level", value="notice"),
        Transform("rename", "user", to="account"),
        Transform("rename", "missing", to="other"),
        Transform("remove", "envoy"),
        Transform("rename", "host", to="hostname"),
    ])
    docs = events_as_dicts(out)
    assert docs[0]["service"] == "myapp" and docs[5]["service"] == "myapp"
    assert all(d["level"] == "notice" for d in docs.values())
    assert docs[0]["account"] == "a" and "user" not in docs[0]
    assert "other" not in docs[0] and "envoy" not in docs[0] and docs[0]["env"] == "x"
    assert docs[4]["hostname"] == "h" and "host" not in docs[4]


def test_rename_moves_json_null_and_overwrites(spark):
    ev = parse(lines_df(spark, ['{"a":null,"b":1}', '{"b":2}']), "json")
    docs = events_as_dicts(apply_transforms(ev, [Transform("rename", "a", to="b")]))
    assert docs[0] == {"b": None, "raw": '{"a":null,"b":1}', "source": "src"}
    assert docs[1]["b"] == 2


def test_remove_regex_prefix(spark, events):
    docs = events_as_dicts(apply_transforms(events, [Transform("remove", ".^env")]))
    assert "env" not in docs[0] and "envoy" not in docs[0] and "msg" in docs[0]


def test_dot_paths(spark, events):
    out = apply_transforms(events, [
        Transform("set", "nested.a.c", value="new"),
        Transform("add", "meta.env.name", value="prod"),
        Transform("remove", "nested.a.b"),
    ])
    docs = events_as_dicts(out)
    assert docs[0]["nested"] == {"a": {"c": "new"}}
    assert docs[0]["meta"] == {"env": {"name": "prod"}}
    assert docs[5]["meta"] == {"env": {"name": "prod"}}


def test_expression_transform(spark, events):
    docs = events_as_dicts(apply_transforms(events, [Transform("set", "len", expr="length(raw)")]))
    assert docs[5]["len"] == len("plain text line")


def test_unknown_action_raises(spark, events):
    with pytest.raises(ValueError, match="unknown action"):
        apply_transforms(events, [Transform("upsert", "x", value="1")])
    with pytest.raises(ValueError, match="missing 'to'"):
        apply_transforms(events, [Transform("rename", "x")])


def test_set_typed_promoted_keeps_string(spark, events):
    # a string written to a typed promoted key stays a string (in attrs)
    docs = events_as_dicts(apply_transforms(events, [Transform("set", "pid", value="abc")]))
    assert docs[4]["pid"] == "abc"
