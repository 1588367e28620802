"""S3: a stream of the lines of files that are appended to and rotated, as a Python data source.

An offset says, for each generation of each file, how many bytes are read: {"device:inode:head": bytes}. head is a digest
of the first line, so a file that is truncated and written anew, or an inode that is used again, is a new generation.
Rotated files are found by their inode under the names that start with the file's own, so what was not read before a
rotation is read after it. Only whole lines count: a half-written last line waits for its end.

Offsets hold all that is needed to read a batch again, so a restarted stream repeats and loses nothing, as long as
rotated files are kept, uncompressed, until they are read. The paths are those of a file system that driver and
executors share.
"""

from __future__ import annotations

import fnmatch
import glob
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task, and of what is read at once when the end of the last line is looked for.
PART_BYTES, LOOK_BYTES = 16 << 20, 1 << 16
#: Bytes of the first line that tell generations apart, and lines of an Arrow batch.
HEAD_BYTES, BATCH_LINES = 256, 8192
#: Looks at a folder whose files are being renamed, and generations that are gone but stay in an offset.
MOST_LOOKS, KEPT_GONE = 20, 1000
PACKED = (".gz", ".zst", ".bz2", ".xz")


@dataclass
class Generation:
    """One file as it is now: its name, whose rotation it belongs to, and the bytes of its whole lines."""

    path: str
    live: str
    bytes: int


@dataclass
class Lines(InputPartition):
    """Lines that begin in [start, end) of a generation."""

    id: str
    live: str
    start: int
    end: int
    first: int


def _whole_lines(f, size: int) -> int:
    """Bytes up to the end of the last whole line."""
    while size > 0:
        at = max(0, size - LOOK_BYTES)
        f.seek(at)
        found = f.read(size - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        size = at
    return 0


def _live_name(path: str, pattern: str) -> str:
    """The shortest beginning of a path that the pattern means: the name of the file before it was rotated."""
    return next((path[:n] for n in range(1, len(path)) if fnmatch.fnmatchcase(path[:n], pattern)), path)


def generations(pattern: str) -> tuple[dict[str, Generation], bool]:
    """What is there now, oldest first: the files that match, and those that are named as one of them and more (of which
    none need be there at the moment). And whether some could not be opened."""
    for _ in range(MOST_LOOKS):
        out, refused = [], False
        try:
            for path in sorted({*glob.glob(pattern), *glob.glob(f"{pattern}*")}):
                if path.endswith(PACKED) or os.path.isdir(path):
                    continue
                try:
                    with open(path, "rb") as f:
                        s = os.fstat(f.fileno())
                        head = f.readline(HEAD_BYTES)
                        whole = _whole_lines(f, s.st_size)
                except PermissionError:
                    refused = True
                    continue
                if whole:
                    live = _live_name(path, pattern)
                    out.append((s.st_mtime_ns, path == live, f"{s.st_dev}:{s.st_ino}:{zlib.crc32(head)}", Generation(path, live, whole)))
            return {i: g for _, _, i, g in sorted(out, key=lambda x: x[:3])}, refused
        except FileNotFoundError:
            continue  # a file was renamed just now: look again, or what it holds would be taken for gone
    raise FileNotFoundError(f"the files of {pattern} never stayed for one look")


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.from_start = str(options.get("fromstart", options.get("fromStart", "true"))).lower() == "true"
        self.part = int(options.get("partbytes", options.get("partBytes", PART_BYTES)))
        self.known: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {} if self.from_start else self.latestOffset()

    def latestOffset(self) -> dict:
        """Generations that are gone, or can't be opened for a while, stay in the offset, or they would be read again."""
        now, refused = generations(self.pattern)
        if refused and self.known is None:
            raise PermissionError(f"some files of {self.pattern} can't be opened")
        gone = {i: n for i, n in (self.known or {}).items() if i not in now}
        self.known = {**dict([*gone.items()][-KEPT_GONE:]), **{i: g.bytes for i, g in now.items()}}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        now, _ = generations(self.pattern)
        out = []
        for i, last in end.items():
            first = int(start.get(i, 0))
            if int(last) < first:
                first = 0  # cut, and begun with the same line again
            live = now[i].live if i in now else self.pattern
            for at in range(first, int(last), self.part):
                out.append(Lines(i, live, at, min(at + self.part, int(last)), first))
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        found = generations(self.pattern)[0].get(partition.id)
        if found is None:
            raise FileNotFoundError(f"{partition.live}: a generation of it is gone before bytes {partition.start} to {partition.end} were read")
        places, lines = [], []
        with open(found.path, "rb") as f:
            at = partition.start
            f.seek(at)
            if at > partition.first:
                # the line in which a part begins is the part before's
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    raise OSError(f"{found.path} was cut while it was read")
                places.append(at)
                lines.append(line[:-1].decode("utf-8", "replace"))
                at += len(line)
                if len(lines) == BATCH_LINES:
                    yield self._batch(partition, places, lines)
                    places, lines = [], []
        if lines:
            yield self._batch(partition, places, lines)

    @staticmethod
    def _batch(partition: Lines, places: list, lines: list) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([partition.live] * n), pa.array([partition.id] * n), pa.array(places, pa.int64()), pa.array(lines)], ["file", "generation", "at", "value"])


class RotatingLines(DataSource):
    """spark.readStream.format("rotating_lines"): file, generation, at (byte) and value of each line.

    Options: path (a name or a glob of several), fromStart (false: only what comes after the stream's first start) and
    partBytes (of a task).
    """

    @classmethod
    def name(cls) -> str:
        return "rotating_lines"

    def schema(self) -> str:
        return "file string, generation string, at long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, from_start: bool = True, **options) -> DataFrame:
    """S3: a stream of (file, generation, at, value), one row for each line that is appended to the files of path."""
    spark.dataSource.register(RotatingLines)
    path = path.removeprefix("file://") if path.startswith("file:///") else path
    reader = spark.readStream.format("rotating_lines").option("path", path).option("fromStart", json.dumps(from_start))
    return reader.options(**options).load()
