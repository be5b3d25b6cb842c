"""Mailboxes and line exports as a Spark data source, for batch and streaming reads.

``spark.dataSource.register(Exports)`` once, then ``spark.read.format("lorebase_exports")`` or
``readStream`` with the options

* ``path``: a folder (its files, sorted by name) or a file, on any file system that Arrow opens by
  its address (``file:``, ``hdfs:``, ``s3:``, ``gs:``), the same for the driver and the executors;
* ``kind``: ``mbox`` (a message begins with a line that begins with "From ", which isn't part of
  it) or ``lines`` (a message is a line, such as a chat export with one JSON object a line);
* ``split``: bytes of a partition, 32 MB unless said; a smaller number grows with the input, up to
  32 MB, so that small ranges are not more than about ``RANGES`` and the files.

Rows are (file, start, raw): the file's name, the byte at which the message begins, and its
text.  A large file is several partitions: each reads the messages that begin in its range, to the
end of the last one.  Parsing is left to the columns of :mod:`lorebase.sources.mail` and
:mod:`lorebase.sources.chat`.

A stream's offset is the number of bytes of each file that were read.  What is appended to a
file is new; a message is read once the next one has begun or, at the end of a file, once the
file ends with a line end.  Files that are gone are skipped; a file that has shrunk is an error.

Defined cases: an empty file has no messages; what stands before the first message of a mailbox is
no message; bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start bigint, raw string"
CHUNK = 1 << 20
USUAL, RANGES = 32 << 20, 512


def _opened(path: str):
    from pyarrow import fs

    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> dict[str, int]:
    """Sizes of a path's files by name, hidden ones left out; a path that isn't there has none."""
    from pyarrow import fs

    store, where = _opened(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        return {}
    files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where))
    return {f.base_name: f.size for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


@dataclass
class Range(InputPartition):
    """The messages that begin in a range of a file's bytes; ``end`` is the last byte that may be read at all."""

    file: str
    start: int
    stop: int
    end: int


def lines(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line with its end) of a file from a place on."""
    handle.seek(start)
    at, rest = start, b""
    while at + len(rest) < end:
        got = handle.read(min(CHUNK, end - at - len(rest)))
        if not got:
            break
        rest += got
        whole = rest.split(b"\n")
        for line in whole[:-1]:
            yield at, line + b"\n"
            at += len(line) + 1
        rest = whole[-1]
    if rest:
        yield at, rest


def messages(handle, kind: str, part: Range) -> Iterator[tuple[str, int, str]]:
    """The messages that begin in a range."""
    text = lambda parts: b"".join(parts).decode("utf-8", "replace").removesuffix("\n")
    # A line that begins before the range belongs to the range before: its last byte tells where lines begin.
    first = max(0, part.start - 1)
    current: list[bytes] = []
    begun = -1
    for at, line in lines(handle, first, part.end):
        if at == first and first < part.start:
            continue  # the end of a line that began earlier
        if kind == "lines":
            if at >= part.stop:
                return
            if line.strip():
                yield part.file, at, text([line])
        elif line.startswith(b"From "):
            if begun >= 0:
                yield part.file, begun, text(current)
            if at >= part.stop:
                return
            begun, current = at, []
        elif begun >= 0:
            current.append(line)
    if kind != "lines" and begun >= 0:
        yield part.file, begun, text(current)


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind, self.split = options["path"].rstrip("/"), options.get("kind", "mbox"), int(options.get("split", USUAL))
        if self.kind not in ("mbox", "lines"):
            raise ValueError(f"unknown kind {self.kind!r}: mbox or lines")

    def ranges(self, before: dict[str, int], after: dict[str, int]) -> list[Range]:
        out, new = [], sum(after.values()) - sum(before.get(f, 0) for f in after)
        split = max(self.split, min(USUAL, new // RANGES))
        for file in sorted(after):
            low, high = before.get(file, 0), after[file]
            if high < low:
                raise ValueError(f"{file} has shrunk from {low} to {high} bytes")
            out += [Range(file, a, min(high, a + split), high) for a in range(low, high, split)]
        return out

    def rows(self, part: Range) -> Iterator[tuple[str, int, str]]:
        store, where = _opened(self.path)
        from pyarrow import fs

        whole = where if store.get_file_info(where).type == fs.FileType.File else f"{where}/{part.file}"
        with store.open_input_file(whole) as handle:
            yield from messages(handle, self.kind, part)


class Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, listed(self.path)) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        if partition.file:
            yield from self.rows(partition)


class StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: self._whole(f, size) for f, size in sorted(listed(self.path).items())}

    def _whole(self, file: str, size: int) -> int:
        """How much of a file is complete: up to its last line end."""
        store, where = _opened(self.path)
        from pyarrow import fs

        with store.open_input_file(where if store.get_file_info(where).type == fs.FileType.File else f"{where}/{file}") as handle:
            end = size
            while end > 0:
                start = max(0, end - CHUNK)
                handle.seek(start)
                found = handle.read(end - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # what Spark keeps; there is nothing to release


class Exports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lorebase_exports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
