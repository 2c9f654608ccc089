"""Helpers shared by the operators: session set-up, stored tables, byte texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from logpipe.session import checkpoint_root, ship_package

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to Python workers and bound their batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The files go when the application ends, or earlier through ``discard``;
    the shuffle files behind them are of no more use, and Spark's cleaner
    removes them once the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath, fs = _hadoop(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    spark._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    jpath, fs = _hadoop(df.sparkSession, df.stored_path)
    fs.delete(jpath, True)


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def utf8(text: str | Column) -> Column:
    """A text column as its UTF-8 bytes (NULL stays NULL)."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def text_key(text: str | Column) -> Column:
    """128 bits that stand for a whole text: two seeded 64-bit hashes.

    What an operator finds out about a document often depends on its text
    alone; such findings are carried under this key, so repeated rows and
    repeated or NULL ids need no special care.  NULL has a key of its own.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c).alias("a"),
                    F.xxhash64(F.lit("second"), F.length(c), c).alias("b"))


def schema(*fields: StructField | str) -> StructType:
    """A schema of existing fields and of "name type" strings."""
    out = StructType()
    for f in fields:
        if isinstance(f, StructField):
            out = out.add(StructField(f.name, f.dataType, True))
        else:
            name, kind = f.split(" ", 1)
            out = out.add(name, DataType.fromDDL(kind), True)
    return out
