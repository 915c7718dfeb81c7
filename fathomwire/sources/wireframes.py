"""``wireframes``: files of length-framed records as a batch source and sink and a stream source.

The sink writes one file and one index a task; the index has the offset of every ``every``-th frame, so a file above
``rangebytes`` is read by many tasks.  Paths may be on any file system that pyarrow knows by its address; a bare path is local.  Files that
Spark alone can reach are read through ``framed_files``.

A stream's offset is the size of each file at a listing, so the reader keeps no state and a restart goes on where the last committed
batch ended.  A frame belongs to the batch in which its last byte has come; tasks settle where frames end, the driver only
lists files and reads the indexes of large ones.  A growing file without an index is walked from its start by one task a batch: roll such files over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from fathomwire.functions.wire import uvarint_bytes
from fathomwire.operators.frames import explode_frames

SCHEMA = "file string, ordinal long, offset long, payload binary"
RANGE_BYTES = 32 << 20


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def data_files(path: str) -> list[tuple[str, int]]:
    """(file, size) in order; names that begin with a dot or underscore don't count."""
    from pyarrow import fs

    system, root = file_system(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and not f.base_name.endswith(".idx"))


class Range(InputPartition):
    """Frames of a file from ``start`` (a place between frames, with its ``ordinal``) to ``end`` that end behind ``after``; ``waits``: the last may be cut short."""

    def __init__(self, file: str, start: int, end: int, ordinal: int, after: int = 0, waits: bool = False):
        self.file, self.start, self.end, self.ordinal, self.after, self.waits = file, start, end, ordinal, after, waits


def ranges(system, file: str, size: int, most: int, after: int = 0, waits: bool = False) -> list[Range]:
    """Ranges of about ``most`` bytes, cut where the file's index knows a frame's place; what ends at ``after`` or before is left out."""
    from pyarrow import fs

    marks = [(0, 0)]
    if size - after > most and system.get_file_info(file + ".idx").type == fs.FileType.File:
        with system.open_input_stream(file + ".idx") as f:
            marks = [tuple(m) for m in json.loads(f.read())] or marks
    cuts = [marks[0]]
    for (ordinal, at), (_, end) in zip(marks[1:], [*marks[2:], (0, size)], strict=False):
        if at <= after:
            cuts = [(ordinal, at)]
        elif end - cuts[-1][1] > most:
            cuts.append((ordinal, at))
    return [Range(file, at, end, ordinal, after, waits) for (ordinal, at), (_, end) in zip(cuts, [*cuts[1:], (0, size)], strict=True)]


def frames_in(system, part: Range, limit: int) -> Iterator[tuple[str, int, int, bytes]]:
    """The frames of a range."""
    with system.open_input_file(part.file) as f:
        f.seek(part.start)
        at, ordinal, buffer, base = part.start, part.ordinal, b"", part.start
        while at < part.end:
            size = shift = used = 0
            while True:
                if at - base + used >= len(buffer):
                    buffer, base = buffer[at - base :] + f.read(1 << 20), at
                    if used >= len(buffer):
                        return  # the file ends inside a length
                b = buffer[at - base + used]
                size |= (b & 127) << shift
                used, shift = used + 1, shift + 7
                if b < 128:
                    break
                if used == 10:
                    raise ValueError(f"{part.file}: no length at byte {at}")
            if limit and size > limit:
                raise ValueError(f"{part.file}: a frame of {size} bytes at byte {at}")
            if part.waits and at + used + size > part.end:
                return  # of a later batch
            if at + used + size <= part.after:  # of an earlier batch
                at, ordinal = at + used + size, ordinal + 1
                if at - base > len(buffer):
                    f.seek(at)
                    buffer, base = b"", at
                continue
            while len(buffer) - (at - base) < used + size:
                more = f.read(max(1 << 20, size))
                if not more:
                    if len(buffer) - (at - base) == used:
                        return
                    raise ValueError(f"{part.file}: the frame at byte {at} is cut short")
                buffer, base = buffer[at - base :] + more, at
            begin = at - base + used
            yield part.file, ordinal, at, buffer[begin : begin + size]
            at, ordinal = at + used + size, ordinal + 1


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit, self.skip = options["path"], int(options.get("maxframe", 64 << 20)), int(options.get("skip", 0))
        self.most = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        system, _ = file_system(self.path)
        return [r for file, size in data_files(self.path) for r in ranges(system, file, size, self.most)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            for row in frames_in(file_system(self.path)[0], partition, self.limit):
                if row[1] >= self.skip:
                    yield row


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class FrameWriter(DataSourceWriter):
    """Rows' ``payload`` to hidden files; the commit gives them their names, so a failed or repeated task leaves nothing behind."""

    def __init__(self, options: dict, column: int, overwrite: bool):
        self.path, self.column, self.every, self.overwrite = options["path"], column, int(options.get("every", 10_000)), overwrite

    def write(self, rows: Iterator) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"{root}/.part-{uuid.uuid4().hex}"
        at = n = 0
        marks = []
        with system.open_output_stream(name) as f:
            for row in rows:
                payload = row[self.column]
                if payload is None:
                    continue
                if n % self.every == 0:
                    marks.append((n, at))
                head = uvarint_bytes(len(payload))
                f.write(head)
                f.write(bytes(payload))
                at, n = at + len(head) + len(payload), n + 1
        with system.open_output_stream(name + ".idx") as f:
            f.write(json.dumps(marks).encode())
        return Written([name])

    def commit(self, messages: list) -> None:
        system, root = file_system(self.path)
        old = [f for f, _ in data_files(self.path)] if self.overwrite else []
        for name in [x for m in messages if m for x in m.files]:
            for end in (".idx", ""):
                system.move(name + end, f"{root}/{name.rpartition('/')[2][1:]}{end}")
        for name in old:
            system.delete_file(name)

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for name in [x for m in messages if m for x in m.files]:
            for end in (".idx", ""):
                system.delete_file(name + end)


class FrameStreamReader(DataSourceStreamReader):
    """New whole frames of growing files; an offset is the size of each file."""

    def __init__(self, options: dict):
        self.path, self.limit, self.most = options["path"], int(options.get("maxframe", 64 << 20)), int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(data_files(self.path))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        system, _ = file_system(self.path)
        grown = [(f, size, start.get(f, 0)) for f, size in sorted(end.items()) if size > start.get(f, 0)]
        return [r for f, size, after in grown for r in ranges(system, f, size, self.most, after, True)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.file:
            yield from frames_in(file_system(self.path)[0], partition, self.limit)


class WireFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wireframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(dict(self.options), schema.fieldNames().index("payload"), overwrite)

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WireFrames)


def framed_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, ordinal, offset, payload, error) of files on any store that Spark reads; a file is one task's work."""
    return explode_frames(spark.read.format("binaryFile").load(path).select("path", "content"), "content", **options)
