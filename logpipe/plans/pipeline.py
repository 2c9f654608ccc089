"""Lines -> parse -> filter -> transform, as one lazy DataFrame plan.

``flagged`` keeps every line with ``_too_long`` and ``_keep`` for the
counters (A1/A2); ``events`` is the filtered, transformed output.  Neither
contains a shuffle: a parse + filter + transform job is a single map stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logpipe.operators.filters import condition
from logpipe.operators.filters import min_level as level_condition
from logpipe.operators.parse import parse
from logpipe.operators.stats import KEEP
from logpipe.operators.transforms import apply_transforms
from logpipe.plans.spec import JobSpec, PipelineSpec, SourceSpec
from logpipe.schema import LINE_RAW
from logpipe.sources.lines import TOO_LONG, fan_in, follow_lines, mark_too_long, read_lines


@dataclass
class Plan:
    flagged: DataFrame
    events: DataFrame


def flag(lines: DataFrame, pipeline: PipelineSpec, fmt: str | None = None,
         priority: str | None = None, max_line_length: int | None = None) -> DataFrame:
    """Parse and mark each line: ``_too_long`` (S5) and ``_keep``."""
    # a too-long line reaches the parser as NULL: it is counted, never parsed
    lines = mark_too_long(lines, max_line_length)
    lines = lines.withColumn(LINE_RAW, F.when(~F.col(TOO_LONG), F.col(LINE_RAW)))
    events = parse(lines, fmt or pipeline.parse, implied_year=pipeline.reference_year,
                   tz=pipeline.time_zone)
    keep = ~F.col(TOO_LONG) & condition(pipeline.filter_spec(), lines.sparkSession)
    prio = level_condition(priority)
    if prio is not None:
        keep = keep & prio
    return events.withColumn(KEEP, keep)


def output_events(flagged: DataFrame, pipeline: PipelineSpec) -> DataFrame:
    kept = flagged.filter(F.col(KEEP)).drop(KEEP, TOO_LONG)
    return apply_transforms(kept, list(pipeline.transforms))


def build_from_lines(lines_by_source: list[tuple[DataFrame, SourceSpec | None]],
                     pipeline: PipelineSpec) -> Plan:
    """Each source parsed with its own format and threshold (S8, S9), then unioned."""
    flagged = fan_in([
        flag(lines, pipeline, src.parse if src else None, src.priority if src else None,
             src.max_line_length if src else None)
        for lines, src in lines_by_source])
    return Plan(flagged, output_events(flagged, pipeline))


def source_lines(spark: SparkSession, src: SourceSpec, stream: bool = False,
                 max_files_per_trigger: int | None = None, state: str | None = None) -> DataFrame:
    if stream and src.follow:
        path = src.path if not src.path_glob else f"{src.path.rstrip('/')}/{'**/' if src.recursive else ''}{src.path_glob}"
        return follow_lines(spark, path, src.name, clean_name=src.clean_name, starting_position=src.starting_position,
                            max_line_length=src.max_line_length, max_bytes_per_trigger=src.max_bytes_per_trigger,
                            state=state)
    return read_lines(spark, src.path, src.name, recursive=src.recursive, path_glob=src.path_glob,
                      stream=stream, clean_name=src.clean_name, max_files_per_trigger=max_files_per_trigger)


def build(spark: SparkSession, job: JobSpec, stream: bool = False,
          max_files_per_trigger: int | None = None, state: str | None = None) -> Plan:
    """The job's plan; ``state`` is a shared folder where followed sources (S3) note what they follow."""
    job.validate()
    if not job.sources:
        raise ValueError("no sources: pass a lines DataFrame to build_from_lines instead")
    return build_from_lines(
        [(source_lines(spark, s, stream, max_files_per_trigger, state and f"{state}/{i}"), s)
         for i, s in enumerate(job.sources)], job.pipeline)


def run_pipeline(lines: DataFrame, pipeline: PipelineSpec) -> DataFrame:
    """Convenience: the output events of one lines DataFrame."""
    return build_from_lines([(lines, None)], pipeline).events
