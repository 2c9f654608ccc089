import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)
# Python workers are started by the JVM and inherit this environment.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [REPO, TESTS] + ([os.environ["PYTHONPATH"]] if os.environ.get("PYTHONPATH") else []))


@pytest.fixture(scope="session")
def spark():
    from logpipe.session import checkpoint_root, get_spark

    scratch = tempfile.mkdtemp(prefix="logpipe-test-")
    s = get_spark("local[4]", "logpipe-tests", shuffle_partitions=8,
                  extra_conf={"spark.driver.memory": "4g",
                              "spark.sql.warehouse.dir": os.path.join(scratch, "wh")})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_root(s, fallback=os.path.join(scratch, "ckpt"))
    yield s
    s.stop()


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)


def lines_df(spark, lines, source="src"):
    return spark.createDataFrame([(i, line, source) for i, line in enumerate(lines)],
                                 "line_id long, raw string, source string")


def by_id(df, *cols):
    return {r["line_id"]: (r if not cols else tuple(r[c] for c in cols))
            for r in df.collect()}
