"""Job specifications and the composed pipeline plan."""

from logpipe.plans.pipeline import Plan, build, build_from_lines, run_pipeline
from logpipe.plans.spec import JobSpec, OutputSpec, PipelineSpec, SourceSpec, from_dict

__all__ = ["Plan", "build", "build_from_lines", "run_pipeline",
           "JobSpec", "OutputSpec", "PipelineSpec", "SourceSpec", "from_dict"]
