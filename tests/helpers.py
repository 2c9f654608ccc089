import json
import os

from logpipe.functions.encode import event_json


def events_as_dicts(df):
    """line_id -> rendered event (Python dict)."""
    rows = df.select("line_id", event_json().alias("j")).collect()
    return {r["line_id"]: json.loads(r["j"]) for r in rows}


def lines_df(spark, lines, source="src"):
    return spark.createDataFrame([(i, line, source) for i, line in enumerate(lines)],
                                 "line_id long, raw string, source string")


class FakeTransport:
    """Picklable stand-in for HTTP: records bodies to a folder, fails on demand."""

    def __init__(self, folder, fail_first=0, status=500, reply=""):
        self.folder, self.fail_first, self.status, self.reply = folder, fail_first, status, reply

    def __call__(self, method, url, body, headers, timeout):
        os.makedirs(self.folder, exist_ok=True)
        n = len(os.listdir(self.folder))
        with open(os.path.join(self.folder, f"{n:05d}-{os.getpid()}-{id(body)}"), "wb") as f:
            f.write(body)
        if n < self.fail_first:
            return self.status, "nope"
        return 200, self.reply
