"""Plan-shape regressions: where filters land, what shuffles, determinism of batching."""

from helpers import lines_df
from pyspark.sql import functions as F

from logpipe.operators.batching import assign_global_batches
from logpipe.plans.pipeline import build_from_lines
from logpipe.plans.spec import PipelineSpec


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def line_of(text: str, needle: str) -> int:
    for i, line in enumerate(text.split("\n")):
        if needle in line:
            return i
    raise AssertionError(f"{needle!r} not in plan:\n{text}")


def test_raw_regex_runs_below_the_syslog_parse(spark):
    lines = lines_df(spark, ["<13>Feb  3 01:02:03 h p: healthcheck", "<13>Feb  3 01:02:03 h p: ok"])
    plan = build_from_lines([(lines, None)], PipelineSpec(parse="syslog", exclude_regex="healthcheck"))
    text = plan_text(plan.events)
    # deeper in the tree = later in the text: the regex filter sits under the first parse stage
    assert line_of(text, "RLIKE(coalesce(") > line_of(text, "Generate inline(array(struct(_s5")
    assert [r["message"] for r in plan.events.collect()] == ["ok"]


def test_json_level_filter_runs_before_heavy_stages(spark):
    lines = lines_df(spark, ['{"lvl":"error","ts":"2026-04-26T12:00:00Z"}', '{"lvl":"info"}'])
    plan = build_from_lines([(lines, None)], PipelineSpec(parse="json", min_level="warn"))
    text = plan_text(plan.events)
    level_filter = line_of(text, "Filter (coalesce(element_at(map(keys: [debug")
    assert level_filter > line_of(text, "struct(_v_timestamp")
    assert level_filter > line_of(text, "struct(_v_attrs")
    assert plan.events.count() == 1


def test_parse_filter_transform_has_no_shuffle(spark):
    lines = lines_df(spark, ['{"lvl":"error"}', "<11>Feb  3 01:02:03 h p: x", "plain"])
    from logpipe.operators.transforms import Transform
    plan = build_from_lines([(lines, None)], PipelineSpec(
        min_level="warn", transforms=(Transform("add", "a", value="b"), Transform("rename", "host", to="h"))))
    assert "Exchange" not in plan_text(plan.events)


def test_global_batches_are_deterministic(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    a = assign_global_batches(df, 50, ["k"], partitions=6)
    b = assign_global_batches(df, 50, ["k"], partitions=6)
    ra = sorted((r["k"], r["_batch"], r["_seq"]) for r in a.collect())
    rb = sorted((r["k"], r["_batch"], r["_seq"]) for r in b.collect())
    assert ra == rb
    assert all(batch == k // 50 and seq == k % 50 for k, batch, seq in ra)


def test_global_webhook_batches_parse_once_and_shuffle_rows_once(spark):
    from logpipe.operators.parse import parse
    from logpipe.sinks.payloads import webhook_batches
    events = parse(lines_df(spark, ['{"msg":"m%d"}' % i for i in range(500)], "svc"), "json")
    batches = webhook_batches(events, 50, order_by=["line_id"], global_order=True)
    text = plan_text(batches)
    # the events were rendered into a file before; ranges of the key are the only exchange
    assert "Generate" not in text and "FileScan parquet" in text and text.count("Exchange") == 1
    assert sorted(r["batch"] for r in batches.collect()) == list(range(10))
