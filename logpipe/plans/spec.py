"""Job specification (sources, pipeline, outputs) with defaults and validation.

Specs are plain dataclasses resolved on the driver when the plan is built, so
every field name and pattern is a literal to Catalyst.  ``from_dict``
accepts the reference's configuration keys (``minLevel``, ``includeRegex``,
``maxLineLength``, ``bufferSize`` ...); reading YAML files is left to the
caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from logpipe.operators.filters import DropRule, FilterSpec
from logpipe.operators.parse import parse_mode
from logpipe.operators.transforms import Transform
from logpipe.sinks.outputs import OUTPUT_TYPES, OutputSpec
from logpipe.sources.lines import DEFAULT_MAX_LINE_LENGTH


@dataclass(frozen=True)
class SourceSpec:
    path: str
    name: str | None = None
    parse: str | None = None           # S8: per-source format, else the pipeline's
    max_line_length: int = DEFAULT_MAX_LINE_LENGTH
    priority: str | None = None        # S9: per-source level threshold
    recursive: bool = False            # S2
    path_glob: str | None = None       # S2: e.g. "*.log"
    clean_name: bool = False           # S6b: label trimmed of "." and "_"
    follow: bool = False               # S3: on a stream, read appended lines, through rotation
    starting_position: str = "earliest"     # follow: "latest" skips what is there at the first start
    max_bytes_per_trigger: int | None = None    # follow: bytes of one micro-batch


@dataclass(frozen=True)
class PipelineSpec:
    parse: str = "auto"
    min_level: str | None = None
    include_regex: str | None = None
    exclude_regex: str | None = None
    drop: DropRule | None = None
    expr: str | None = None
    transforms: tuple[Transform, ...] = ()
    reference_year: int | None = None  # RFC 3164 and "MMM d" timestamps
    time_zone: str = "UTC"

    def filter_spec(self) -> FilterSpec:
        return FilterSpec(self.include_regex, self.exclude_regex, self.min_level, self.drop, self.expr)


@dataclass(frozen=True)
class JobSpec:
    sources: tuple[SourceSpec, ...] = ()
    pipeline: PipelineSpec = field(default_factory=PipelineSpec)
    outputs: tuple[OutputSpec, ...] = (OutputSpec(type="stdout"),)
    counts_only: bool = False          # no outputs: only totals and intervals

    def validate(self) -> "JobSpec":
        seen = set()
        for src in self.sources:
            if not src.path:
                raise ValueError("every source needs a path")
            if src.starting_position not in ("earliest", "latest"):
                raise ValueError(f"unknown starting position {src.starting_position!r}; known are earliest, latest")
            if src.name:
                if src.name in seen:
                    raise ValueError(f"two sources are called {src.name!r}")
                seen.add(src.name)
        if not self.outputs and not self.counts_only:
            raise ValueError("a job needs an output")
        for i, out in enumerate(self.outputs):
            if out.order_by and out.type != "webhook":
                raise ValueError(f"output {i} ({out.type}) cannot be ordered; only webhook requests can")
            if not out.type:
                raise ValueError(f"output {i} has no type")
            if out.type not in OUTPUT_TYPES:
                raise ValueError(f"output {i} has the unknown type {out.type!r}; "
                                 f"known are {', '.join(OUTPUT_TYPES)}")
            if out.type in ("file", "elasticsearch", "kafka", "webhook") and not out.url:
                raise ValueError(f"output {i} ({out.type}) needs a url")
        for t in self.pipeline.transforms:
            t.validate()
        return self


    def with_outputs(self, outputs: tuple[OutputSpec, ...]) -> "JobSpec":
        return JobSpec(self.sources, self.pipeline, outputs, counts_only=not outputs)


def _get(d: dict, *keys, default=None):
    for k in keys:
        if k in d and d[k] is not None:
            return d[k]
    return default


# Keys that a configuration may have; "color" concerns a terminal only.
_KEYS = {
    "configuration": {"sources", "pipeline", "outputs"},
    "source": {"path", "name", "parse", "maxLineLength", "max_line_length", "priority", "recursive",
               "pathGlob", "path_glob", "cleanName", "clean_name", "follow", "startingPosition",
               "starting_position", "maxBytesPerTrigger", "max_bytes_per_trigger"},
    "pipeline": {"parse", "minLevel", "min_level", "includeRegex", "include_regex", "excludeRegex",
                 "exclude_regex", "drop", "expr", "transforms", "referenceYear", "reference_year",
                 "timeZone", "time_zone"},
    "output": {"type", "url", "index", "topic", "maxRecordsPerFile", "max_records_per_file", "maxSize",
               "max_bytes_per_file", "compress", "bufferSize", "buffer_size", "flushInterval",
               "flush_interval", "batchSize", "batch_size", "headers", "username", "password",
               "compression", "retryMax", "retry_max", "orderBy", "order_by", "color"},
}


def _known(what: str, d: dict) -> None:
    unknown = sorted(set(d) - _KEYS[what])
    if unknown:
        raise ValueError(f"{what}: unsupported key(s) {', '.join(unknown)}")


def from_dict(cfg: dict) -> JobSpec:
    """Build a spec from a configuration mapping (reference key names accepted).

    A key that has no effect here is an error, so nothing is ignored unseen.
    """
    _known("configuration", cfg)
    _known("pipeline", cfg.get("pipeline") or {})
    for what, listed in (("source", cfg.get("sources")), ("output", cfg.get("outputs"))):
        for d in listed or []:
            _known(what, d)
    sources = tuple(
        SourceSpec(path=_get(s, "path", default=""), name=_get(s, "name"), parse=_get(s, "parse"),
                   max_line_length=int(_get(s, "maxLineLength", "max_line_length",
                                            default=DEFAULT_MAX_LINE_LENGTH) or DEFAULT_MAX_LINE_LENGTH),
                   priority=_get(s, "priority"), recursive=bool(_get(s, "recursive", default=False)),
                   path_glob=_get(s, "pathGlob", "path_glob"),
                   clean_name=bool(_get(s, "cleanName", "clean_name", default=False)),
                   follow=bool(_get(s, "follow", default=False)),
                   starting_position=_get(s, "startingPosition", "starting_position", default="earliest"),
                   max_bytes_per_trigger=_get(s, "maxBytesPerTrigger", "max_bytes_per_trigger"))
        for s in cfg.get("sources") or [])
    p = cfg.get("pipeline") or {}
    drop = p.get("drop")
    pipeline = PipelineSpec(
        parse=parse_mode(_get(p, "parse", default="auto")),
        min_level=_get(p, "minLevel", "min_level"),
        include_regex=_get(p, "includeRegex", "include_regex"),
        exclude_regex=_get(p, "excludeRegex", "exclude_regex"),
        drop=DropRule(drop.get("field", ""), str(drop.get("value", ""))) if drop else None,
        expr=_get(p, "expr"),
        transforms=tuple(Transform(t.get("action", ""), t.get("field", ""), t.get("to"),
                                   None if t.get("value") is None else str(t.get("value")), t.get("expr"))
                         for t in p.get("transforms") or []),
        reference_year=_get(p, "referenceYear", "reference_year"),
        time_zone=_get(p, "timeZone", "time_zone", default="UTC"),
    )
    outputs = tuple(
        OutputSpec(type=_get(o, "type", default=""), url=_get(o, "url"), index=_get(o, "index"),
                   topic=_get(o, "topic"),
                   max_records_per_file=_get(o, "maxRecordsPerFile", "max_records_per_file"),
                   max_bytes_per_file=_get(o, "maxSize", "max_bytes_per_file"),
                   compress=bool(_get(o, "compress", default=False)),
                   buffer_size=int(_get(o, "bufferSize", "buffer_size", default=1000) or 1000),
                   flush_interval=str(_get(o, "flushInterval", "flush_interval", default="5 seconds")),
                   batch_size=int(_get(o, "batchSize", "batch_size", default=50) or 50),
                   headers=dict(_get(o, "headers", default={}) or {}),
                   username=_get(o, "username"), password=_get(o, "password"),
                   compression=_get(o, "compression"),
                   retry_max=int(_get(o, "retryMax", "retry_max", default=3) or 3),
                   order_by=_get(o, "orderBy", "order_by"))
        for o in (cfg["outputs"] if "outputs" in cfg else [{"type": "stdout"}]))
    return JobSpec(sources, pipeline, outputs)
