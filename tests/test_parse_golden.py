"""Golden lines (FIXTURES §2): one line per behaviour, expected by intent."""

from datetime import datetime

from helpers import events_as_dicts, lines_df

from logpipe.operators.parse import parse, parse_mode


def parse_one(spark, fmt, lines, year=2026):
    df = parse(lines_df(spark, lines), fmt, implied_year=year)
    rows = {r["line_id"]: r for r in df.collect()}
    return [rows[i] for i in range(len(lines))], events_as_dicts(df)


def test_json_aliases_and_original_keys(spark):
    rows, docs = parse_one(
        spark, "json", ['{"ts":"2026-04-26T12:00:00Z","lvl":"warn","msg":"m","logger":"db"}'])
    r, d = rows[0], docs[0]
    assert r["format"] == "json"
    assert r["timestamp"] == datetime(2026, 4, 26, 12, 0, 0)
    assert (r["level"], r["message"], r["source"]) == ("warn", "m", "db")
    for k in ("ts", "lvl", "msg", "logger"):
        assert k in d


def test_json_presence_semantics(spark):
    rows, docs = parse_one(spark, "json", [
        '{"message":null,"msg":"x"}', '{"msg":"a","log":"b"}', '{"a":1,"a":2}',
        '{"source":"own","raw":"r"}', '{"level":30}'])
    assert rows[0]["message"] is None and docs[0]["message"] is None and docs[0]["msg"] == "x"
    assert rows[1]["message"] == "a"
    assert docs[2]["a"] == 2
    assert (rows[3]["source"], rows[3]["raw"]) == ("own", "r")
    assert rows[4]["level"] is None and docs[4]["level"] == 30


def test_json_rejections_keep_raw_and_source_only(spark):
    bad = ['{"a":1} xyz', "[1]", "null", "{'a':1}", '{"a":NaN}', '{"a":1}]', '{"a":1},null', '{"a":1}] x]']
    rows, docs = parse_one(spark, "json", bad)
    for line, r, d in zip(bad, rows, docs.values()):
        assert r["format"] == "unparsed", line
        assert d == {"raw": line, "source": "src"}


def test_json_leading_whitespace_accepted_when_forced(spark):
    rows, _ = parse_one(spark, "json", ['  {"msg":"x"}'])
    assert rows[0]["format"] == "json" and rows[0]["message"] == "x"


def test_rfc3164(spark):
    rows, docs = parse_one(spark, "syslog", ["<13>Feb  3 01:02:03 h sshd[42]: ok",
                                             "<13>Feb 30 01:02:03 h p: x",
                                             "<34>Oct 11 22:14:15 mymachine su: 'su root' failed"])
    r = rows[0]
    assert (r["facility"], r["severity"], r["level"], r["pid"], r["program"], r["host"], r["message"]) == \
        (1, 5, "notice", 42, "sshd", "h", "ok")
    assert r["timestamp"] == datetime(2026, 2, 3, 1, 2, 3)
    assert rows[1]["format"] == "rfc3164" and rows[1]["timestamp"] is None
    assert rows[2]["message"] == "'su root' failed" and rows[2]["level"] == "crit"
    assert "pid" not in docs[2]


def test_rfc5424(spark):
    rows, _ = parse_one(spark, "syslog", ['<165>1 2026-04-26T12:00:00Z h app 1 ID47 [a b="c"][d] hello',
                                          "<165>1 2026-04-26T12:00:00Z h app - ID47 - m",
                                          "<165>1 2026-04-26T12:00:00.000Z myhost app 12345 - message"])
    r = rows[0]
    assert (r["msgid"], r["structured_data"], r["message"], r["host"], r["program"], r["pid"]) == \
        ("ID47", 'a b="c"][d', "hello", "h", "app", 1)
    assert (r["facility"], r["severity"], r["level"]) == (20, 5, "notice")
    assert rows[1]["format"] == "unparsed"  # pid must be numeric
    assert rows[2]["message"] == "message" and rows[2]["pid"] == 12345


def test_access_log(spark):
    rows, _ = parse_one(spark, "nginx", [
        '10.0.0.1 - bob [26/Apr/2026:12:00:00 +0700] "GET /a HTTP/1.1" 404 - "-" "curl/8"',
        '10.0.0.1 - - [26/Apr/2026:12:00:00 +0000] "-" 400 0 "-" "-"'])
    r = rows[0]
    assert r["timestamp"] == datetime(2026, 4, 26, 5, 0, 0)
    assert (r["status"], r["size"], r["level"], r["message"], r["user"], r["user_agent"]) == \
        (404, 0, "warn", "GET /a", "bob", "curl/8")
    assert rows[1]["format"] == "unparsed"


def test_error_log(spark):
    rows, _ = parse_one(spark, "nginx", ["2026/04/26 12:00:00 [error] 123#0: *1 open() failed",
                                         "2026/04/26 12:00:00 [crit] 1#0: disk full"])
    r = rows[0]
    assert (r["level"], r["pid"], r["message"], r["format"]) == ("err", 123, "*1 open() failed", "error")
    assert r["timestamp"] == datetime(2026, 4, 26, 12, 0, 0)
    assert rows[1]["format"] == "unparsed"  # no gate word


def test_auto_fallbacks(spark):
    rows, docs = parse_one(spark, "auto", ["plain text", "{broken", "<13>Feb  3 01:02:03 h p: ok",
                                           '{"msg":"j"}'])
    assert docs[0] == {"message": "plain text", "raw": "plain text", "source": "src"}
    assert docs[1]["message"] == "{broken" and rows[1]["format"] == "raw"
    assert rows[2]["format"] == "rfc3164"
    assert rows[3]["format"] == "json"


def test_raw_mode_has_no_message(spark):
    rows, docs = parse_one(spark, "raw", ["anything"])
    assert docs[0] == {"raw": "anything", "source": "src"} and rows[0]["format"] == "raw"


def test_control_characters_stay_in_one_line(spark):
    lines = ["a\rb", "c\u0085d", "e\u0001f <13>", "<13>Feb  3 01:02:03 h p\u0001: x\u0001y"]
    rows, _ = parse_one(spark, "auto", lines)
    assert [r["raw"] for r in rows] == lines
    # a line holding the extraction separator takes the per-group path
    assert rows[3]["format"] == "rfc3164" and rows[3]["message"] == "x\u0001y"


def test_parse_mode_normalisation():
    assert parse_mode("JSON") == "json"
    assert parse_mode("nginx") == "nginx"
    assert parse_mode("weird") == "auto"
    assert parse_mode(None) == "auto"


def test_extra_columns_are_carried(spark):
    from pyspark.sql import functions as F
    df = lines_df(spark, ["plain"]).withColumn("file_path", F.lit("/x"))
    out = parse(df, "auto")
    assert {"line_id", "file_path"} <= set(out.columns)
    assert out.first()["file_path"] == "/x"
