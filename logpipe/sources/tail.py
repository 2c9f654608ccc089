"""S3: follow growing files, line by line, as a streaming data source.

``spark.readStream.format("logpipe_tail")`` reads the bytes appended to all
files that match a glob.  Its offset is, for every file, how far whole lines
have been read; a last line without its newline waits until that is written.
A file is known by its inode and the bytes of its head (by path and head
where a store has no inodes), so it is followed when log rotation renames it,
read from its start when it was truncated or written anew, and never read
twice.  Ranges of bytes are planned on the driver and read by the tasks, a
long range in pieces, each line by the piece in which it starts.

Options: ``path`` (a glob, ``**`` for any folders), ``startingPosition``
(``earliest``, or ``latest`` for only what is appended from now on),
``maxBytesPerTrigger``, ``maxBytesPerPartition``, ``maxLineLength`` (longer
lines come cut to one byte more), ``stateLocation`` (a shared folder where
the last offset is noted, so that files renamed while the query is down are
followed), ``failOnDataLoss`` (whether a range of a file that has gone is an
error, or left out).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logpipe.session import ship_package
from logpipe.sources.lines import DEFAULT_MAX_LINE_LENGTH, glob_regex

NAME = "logpipe_tail"
SCHEMA = "value string, file_path string, position long"
#: Bytes that tell files of one inode apart; a shorter first line is the head.
HEAD = 256
#: Bytes read at once.
CHUNK = 4 << 20
#: Lines of one Arrow batch.
BATCH_LINES = 8192


@dataclass(frozen=True)
class Found:
    """A file as it is now: identity, path and size."""
    key: str
    path: str
    size: int


@dataclass
class Range(InputPartition):
    """Lines that start in [start, end) of the file ``key``; ``first`` is the start of some line, ``last`` the end of one."""
    key: str
    path: str
    start: int
    end: int
    first: int
    last: int

    def __init__(self, key, path, start, end, first, last):
        self.key, self.path, self.start, self.end, self.first, self.last = key, path, start, end, first, last


class Files:
    """The files under a glob's fixed folder, and their identities."""

    def __init__(self, path: str):
        fixed = re.split(r"[*?\[{]", path, maxsplit=1)[0]
        base = fixed.rsplit("/", 1)[0] or "/"
        self.store, self.base = fs.FileSystem.from_uri(base if "://" in base else os.path.abspath(base))
        rest = path[len(base):].lstrip("/")
        self.pattern = re.compile(re.escape(self.base.rstrip("/")) + "/" + glob_regex(rest) + r"\Z")
        self.deep = "/" in rest

    def matches(self, path: str) -> bool:
        return bool(self.pattern.match(path))

    def all(self, wanted=None) -> Iterator[Found]:
        """Every file that has an identity and is matched by the glob or ``wanted`` (by inode)."""
        for info in self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True, recursive=self.deep)):
            if info.type == fs.FileType.File and (self.matches(info.path) or wanted and self._inode(info.path) in wanted):
                found = self.identify(info.path)
                if found is not None:
                    yield found

    def _inode(self, path: str) -> str:
        if not isinstance(self.store, fs.LocalFileSystem):
            return path
        try:
            s = os.stat(path)
        except OSError:
            return ""
        return f"{s.st_dev}:{s.st_ino}"

    def identify(self, path: str) -> Found | None:
        """None while the file has neither a whole first line nor ``HEAD`` bytes, or when it has gone."""
        try:
            inode = self._inode(path)
            with self.store.open_input_file(path) as f:
                head, size = f.read_at(HEAD, 0), f.size()
        except OSError:
            return None
        cut = head.find(b"\n") + 1
        if not inode or not cut and len(head) < HEAD:
            return None
        return Found(f"{inode}#{zlib.crc32(head[:cut or HEAD]):08x}", path, size)

    def open(self, key: str, path: str):
        """The file of this identity, at its path or, renamed meanwhile, elsewhere in the folder."""
        for found in (self.identify(path), *self.all({key.partition("#")[0]})):
            if found is not None and found.key == key:
                return self.store.open_input_file(found.path)
        raise FileNotFoundError(f"{path} is gone before all its lines were read")

    def whole_lines(self, found: Found, start: int, limit: int | None = None) -> int:
        """End of the last whole line of [start, size), or with a limit of what begins in the first ``limit`` bytes."""
        try:
            with self.store.open_input_file(found.path) as f:
                size = f.size()
                end = size if limit is None else min(size, start + max(1, limit))
                at = end
                while at > start:  # backwards to the last newline
                    lo = max(start, at - CHUNK)
                    nl = f.read_at(at - lo, lo).rfind(b"\n")
                    if nl >= 0:
                        return lo + nl + 1
                    at = lo
                while end < size:  # one line longer than the limit is read whole
                    nl = f.read_at(min(CHUNK, size - end), end).find(b"\n")
                    if nl >= 0:
                        return end + nl + 1
                    end += CHUNK
        except OSError:
            pass
        return start


def _read(f, part: Range, limit: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """(lines, positions) of the lines that start in a range; lines are cut to ``limit`` bytes."""
    at = part.start
    if at > part.first:  # the line that runs into the range belongs to the range before
        at = _after_newline(f, at - 1, part.last)
    held, begun = b"", at  # the start of a line whose end is not read yet
    while at < part.last and begun < part.end:
        data = f.read_at(min(CHUNK, part.last - at), at)
        if not data:
            raise EOFError(f"{part.path} is shorter than it was")
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10).tolist()
        lines, places, last = [], [], 0
        for e in ends:
            if begun >= part.end:
                break
            lines.append((held + data[last:e])[:limit])
            places.append(begun)
            held, last = b"", e + 1
            begun = at + last
            if len(lines) == BATCH_LINES:
                yield lines, places
                lines, places = [], []
        if lines:
            yield lines, places
        held = (held + data[last:])[:limit]
        at += len(data)


def _after_newline(f, at: int, last: int) -> int:
    while at < last:
        data = f.read_at(min(CHUNK, last - at), at)
        nl = data.find(b"\n")
        if nl >= 0:
            return at + nl + 1
        at += len(data) or last
    return last


class TailReader(DataSourceStreamReader):
    """Offsets are ``{"files": {identity: [path when first seen, end of the last whole line read]}}``."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("logpipe_tail needs a path")
        self.options = dict(options)
        self.path = options["path"]
        self.latest = options.get("startingposition", options.get("startingPosition", "earliest")).lower() == "latest"
        number = lambda key, default: int(options.get(key.lower(), options.get(key, default)) or default)
        self.per_trigger = number("maxBytesPerTrigger", 0) or None
        self.per_partition = number("maxBytesPerPartition", 64 << 20)
        self.line_limit = number("maxLineLength", DEFAULT_MAX_LINE_LENGTH) + 1
        self.strict = str(options.get("failondataloss", options.get("failOnDataLoss", "true"))).lower() != "false"
        self.state = options.get("statelocation", options.get("stateLocation"))
        self.files = Files(self.path)
        self.known: dict | None = None  # the files of the last offset seen here

    # -------------------------------------------------------------- offsets
    def initialOffset(self) -> dict:
        files = {f.key: [f.path, self.files.whole_lines(f, 0)] for f in self.files.all()} if self.latest else {}
        self.known = dict(files)
        return {"files": files}

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = self._noted()
        known, left, now = self.known, self.per_trigger, {}
        wanted = {key.partition("#")[0] for key in known}
        present = {}
        for f in self.files.all(wanted):
            if f.key in known or self.files.matches(f.path):
                present.setdefault(f.key, f)  # of two hard links one is enough
        # what was begun goes on first, so that a busy new file cannot starve the others
        for key, f in sorted(present.items(), key=lambda kv: (kv[0] not in known, kv[1].path)):
            path, start = known.get(key, (f.path, 0))  # a renamed file keeps the name it was found by
            if f.size < start:  # truncated, with the same first line
                start = 0
            if f.size == start or left is not None and left <= 0:
                if key in known or start:
                    now[key] = [path, start]
                continue
            end = self.files.whole_lines(f, start, left)
            if left is not None:
                left -= end - start
            now[key] = [path, end]
        self.known = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._note(end)
        if self.known is None:
            self.known = dict(end.get("files", {}))
        before, out = start.get("files", {}), []
        for key, (path, stop) in end.get("files", {}).items():
            first = before.get(key, (path, 0))[1]
            if stop < first:
                first = 0
            for at in range(first, stop, self.per_partition):
                out.append(Range(key, path, at, min(stop, at + self.per_partition), first, stop))
        return out

    # -------------------------------------------------------------- rows
    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files = Files(self.path)
        try:
            f = files.open(partition.key, partition.path)
        except FileNotFoundError:
            if self.strict:
                raise
            return
        with f:
            for lines, places in _read(f, partition, self.line_limit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()),
                     pa.array([partition.path] * len(lines), pa.string()), pa.array(places, pa.int64())],
                    ["value", "file_path", "position"])

    # -------------------------------------------------------------- state
    def _state(self):
        store, folder = fs.FileSystem.from_uri(self.state if "://" in self.state else os.path.abspath(self.state))
        return store, folder.rstrip("/")

    def _noted(self) -> dict:
        """The files of the last offset planned before a restart; they need not match the glob any more."""
        if not self.state:
            return {}
        store, folder = self._state()
        try:
            with store.open_input_file(f"{folder}/last.json") as f:
                return json.loads(f.read())["files"]
        except (OSError, ValueError, KeyError):
            return {}

    def _note(self, offset: dict) -> None:
        """Noted before the range is read, so the note is never older than a committed offset."""
        if not self.state:
            return
        store, folder = self._state()
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/next.json") as f:
            f.write(json.dumps(offset).encode())
        store.move(f"{folder}/next.json", f"{folder}/last.json")

    def commit(self, end: dict) -> None:
        pass  # offsets are Spark's


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("logpipe_tail")`` known to a session and its workers."""
    ship_package(spark)
    spark.dataSource.register(TailSource)
