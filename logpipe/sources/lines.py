"""Line tables: ``(raw STRING, source STRING, file_path STRING, ...)``.

S1 text scan, S2 recursive glob, S4 normalisation, S5 length limit,
S6 source label, S7 fan-in.  Streaming (S3) uses the same functions on a
``readStream`` DataFrame (see ``logpipe.streaming``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logpipe.schema import LINE_FILE, LINE_RAW, LINE_SOURCE

DEFAULT_MAX_LINE_LENGTH = 65536
TOO_LONG = "_too_long"


def _reader(spark: SparkSession, stream: bool, recursive: bool, path_glob: str | None,
            max_files_per_trigger: int | None):
    reader = spark.readStream if stream else spark.read
    # "\n" only: the default separator also splits on a bare "\r".
    reader = reader.format("text").option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader


def source_label(name: str | None, clean: bool = False) -> Column:
    """Configured name, else the file's basename (S6b: trimmed of ``.``/``_``)."""
    if name:
        return F.lit(name)
    base = F.col("_metadata.file_name")
    return F.btrim(base, F.lit("._")) if clean else base


def split_glob(path: str) -> tuple[str, str | None, str | None]:
    """``base/**/rest`` as (base, glob of the file name, regex of the path below base).

    ``**`` stands for any number of folders, none included.  A path without it
    is returned whole.
    """
    base, star, rest = path.partition("**")
    if not star:
        return path, None, None
    rest = rest.lstrip("/") or "*"
    base = base.rstrip("/") or ("/" if path.startswith("/") else ".")
    return base, rest.rsplit("/", 1)[-1].replace("**", "*"), f"/(.*/)?{glob_regex(rest)}\\z"


def glob_regex(glob: str) -> str:
    """A path glob as a Java regex."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif ch == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(" + "|".join(glob_regex(x) for x in glob[i + 1:end].split(",")) + ")", end + 1
        elif ch == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1:end].replace("!", "^", 1) + "]", end + 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(ch) or re.escape(ch)
            i += 1
    return out


def read_lines(spark: SparkSession, paths, name: str | None = None, *, recursive: bool = False,
               path_glob: str | None = None, stream: bool = False, clean_name: bool = False,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """One row per line of every matching file, normalised.

    A stream reads each file once, as a whole; ``follow_lines`` reads what is
    appended to them, too.
    """
    if isinstance(paths, str):
        paths = [paths]
    deep = [p for p in paths if "**" in p]
    if stream and len(paths) != 1:
        raise ValueError("a streaming source watches one directory")
    if deep and len(paths) > 1:
        return fan_in([read_lines(spark, p, name, recursive=recursive, path_glob=path_glob, clean_name=clean_name)
                       for p in paths])
    below = None
    if deep:
        base, glob, below = split_glob(paths[0])
        recursive, path_glob, paths = True, path_glob or glob, [base]
    reader = _reader(spark, stream, recursive, path_glob, max_files_per_trigger)
    df = reader.load(paths[0] if stream else paths)
    if below:
        df = df.where(F.col("_metadata.file_path").rlike(below))
    df = df.select(F.col("value").alias(LINE_RAW),
                   source_label(name, clean_name).alias(LINE_SOURCE),
                   F.col("_metadata.file_path").alias(LINE_FILE))
    # text files split by size already; a small file stays one task, in line order
    return normalise(df)


def follow_lines(spark: SparkSession, path: str, name: str | None = None, *, clean_name: bool = False,
                 starting_position: str = "earliest", max_line_length: int | None = None,
                 max_bytes_per_trigger: int | None = None, state: str | None = None) -> DataFrame:
    """S3: a streaming line table of growing files (see ``logpipe.sources.tail``), normalised."""
    from logpipe.sources import tail

    tail.register(spark)
    options = {"path": path, "startingPosition": starting_position, "maxBytesPerTrigger": max_bytes_per_trigger,
               "maxLineLength": max_line_length, "stateLocation": state}
    df = spark.readStream.format(tail.NAME).options(**{k: v for k, v in options.items() if v}).load()
    if name:
        label = F.lit(name)
    else:
        label = F.element_at(F.split("file_path", "/"), -1)
        label = F.btrim(label, F.lit("._")) if clean_name else label
    return normalise(df.select(F.col("value").alias(LINE_RAW), label.alias(LINE_SOURCE),
                               F.col("file_path").alias(LINE_FILE)))


def strip_newlines(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[\r\n]+\z", "")


def normalise(df: DataFrame) -> DataFrame:
    """Strip trailing ``\\r``/``\\n`` and skip empty lines (not counted)."""
    return (df.withColumn(LINE_RAW, strip_newlines(F.col(LINE_RAW)))
              .filter(F.col(LINE_RAW) != ""))


def mark_too_long(df: DataFrame, max_length: int | None = DEFAULT_MAX_LINE_LENGTH) -> DataFrame:
    """S5 (flag form): ``_too_long`` is true for lines over ``max_length`` bytes."""
    if not max_length or max_length <= 0:
        max_length = DEFAULT_MAX_LINE_LENGTH
    return df.withColumn(TOO_LONG, F.octet_length(LINE_RAW) > F.lit(max_length))


def limit_length(df: DataFrame, max_length: int | None = DEFAULT_MAX_LINE_LENGTH) -> DataFrame:
    """Drop lines longer than ``max_length`` bytes."""
    if not max_length or max_length <= 0:
        max_length = DEFAULT_MAX_LINE_LENGTH
    return df.filter(F.octet_length(LINE_RAW) <= F.lit(max_length))


def text_lines(df: DataFrame, text_col: str, source: Column | str, keep: list[str] = ()) -> DataFrame:
    """Split a text column on ``\\n`` into a line table (``line_no`` from 0)."""
    src = F.lit(source) if isinstance(source, str) else source
    exploded = df.select(*keep, src.alias(LINE_SOURCE),
                         F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", LINE_RAW))
    return normalise(exploded.withColumn(LINE_FILE, F.lit(None).cast("string")))


def fan_in(frames: list[DataFrame]) -> DataFrame:
    """Bag union of several sources (columns matched by name)."""
    if not frames:
        raise ValueError("no sources")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
