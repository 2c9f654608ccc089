"""Spark session settings the engine relies on.

Two SQL settings change results and are therefore set by ``configure``:

* ``spark.sql.session.timeZone=UTC`` — rendering of event timestamps
  (``date_format``) follows the session zone; parsing never does, every
  parser appends an explicit zone before converting.
* ``spark.sql.variant.allowDuplicateKeys=true`` — a JSON object with a
  repeated key keeps the last value instead of being rejected.
* ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` — writing a key that ``attrs``
  already holds replaces it (Go map assignment) in one ``map_concat``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the parsers and encoders depend on."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_spark(master: str | None = None, app_name: str = "logpipe",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with sane defaults for log pipelines.

    On a cluster the master and most resources come from ``spark-submit``;
    only the settings that affect results or plan quality are fixed here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        **REQUIRED_CONF,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # checkpoints written by cut_lineage are removed once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return configure(spark)


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints and lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``; a caller-provided
    ``fallback`` (tests use a temporary folder) is only used when unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect has no SparkContext
            root = None
    if not root and fallback is None and _is_local(spark):
        # a single-machine session may keep its checkpoints on this machine
        fallback = tempfile.mkdtemp(prefix="logpipe-ckpt-")
    if not root:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
        root = fallback
        spark.conf.set("spark.checkpoint.dir", root)
        try:
            spark.sparkContext.setCheckpointDir(root)
        except Exception:
            pass
    return root.rstrip("/")


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:
        return False


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once into the shared checkpoint folder.

    Used where one costly input feeds several branches of a plan; the
    checkpoint survives executor loss (unlike a local checkpoint).
    """
    spark = df.sparkSession
    root = checkpoint_root(spark)
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
    except Exception:
        pass
    return df.checkpoint(eager=True)


def write_once(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back.

    For results that later steps read in part (single columns) or more than
    once.  The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/logpipe/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logpipe`` importable by Python workers (the programmatic ``--py-files``).

    Only HTTP delivery runs Python on executors.  The package is zipped once
    per application on the driver and served to executors by Spark.
    """
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # Spark Connect: ship with the session's artifacts instead
        return
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="logpipe-pkg-"), "logpipe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def subdir(root: str, *parts: str) -> str:
    return os.path.join(root, *parts)
