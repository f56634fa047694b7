"""Streaming source over growing log files: whole lines by byte range.

The driver lists files and looks for the last line end of each; executors read the ranges. Offsets hold, per file, the byte read
up to and who the file is: digests of its first 1, 2, 4, ... bytes. So a restarted stream goes on where its checkpoint ends; a file
that was rewritten, shrunk or grown beyond its old size is read from its beginning; and a file that was renamed goes on under its
new name. Lines are returned as text and parsed by Spark.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20  # most bytes one task reads
FILE_SHIFT = 44  # a line's place: number of its file, then its byte
_STEP = 1 << 20
HEAD_BYTES = 1024  # as much of a file's beginning tells it from others
RENAME_BYTES = 16  # files that agree in fewer bytes are not taken for one renamed file


def file_store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def list_files(path: str) -> dict[str, int]:
    """Sizes of the files of a folder (hidden ones left out), a glob in the last part of the path, or one file."""
    from pyarrow import fs

    store, inner = file_store(path)
    folder, pattern = inner, "*"
    if any(c in posixpath.basename(inner) for c in "*?["):
        folder, pattern = posixpath.split(inner)
    elif store.get_file_info(inner).type == fs.FileType.File:
        return {inner: store.get_file_info(inner).size}
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {
        f.path: f.size
        for f in sorted(found, key=lambda f: f.path)
        if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._"
    }


def last_line_end(store, path: str, size: int) -> int:
    """The byte after the last line feed, looking back from the end: a half-written line waits."""
    with store.open_input_file(path) as file:
        end = size
        while end > 0:
            start = max(0, end - _STEP)
            file.seek(start)
            found = file.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return 0


def next_line_end(store, path: str, at: int) -> int:
    """The byte after the first line feed from ``at`` on; ``at`` if there is none yet."""
    with store.open_input_file(path) as file:
        file.seek(at)
        begin = at
        while more := file.read(_STEP):
            found = more.find(b"\n")
            if found >= 0:
                return begin + found + 1
            begin += len(more)
    return at


def identity(store, path: str, end: int) -> dict[str, str]:
    """Short digests of the first 1, 2, 4, ... bytes of a file, as far as ``end`` and ``HEAD_BYTES`` reach."""
    with store.open_input_file(path) as file:
        head = file.read(min(end, HEAD_BYTES))
    return {str(1 << k): hashlib.blake2b(head[: 1 << k], digest_size=6).hexdigest() for k in range(len(head).bit_length()) if 1 << k <= len(head)}


def agreement(a: dict[str, str], b: dict[str, str]) -> int:
    """The longest beginning in which two files are known to agree; 0 if the longest comparable one differs."""
    longest = max((int(n) for n in a.keys() & b.keys()), default=0)
    return longest if longest and a[str(longest)] == b[str(longest)] else 0


def entry_of(offset: dict, file: str) -> tuple[int, dict[str, str] | None]:
    """Position and identity of a file in an offset; a plain number is a position of a file that nothing else is known of."""
    found = offset.get(file, 0)
    return (found, None) if isinstance(found, int) else (found["end"], found["head"])


def beginnings(start: dict, end: dict) -> dict[str, int]:
    """Where reading of each file of ``end`` begins: where it ended under this name, or under its old one, else at 0."""
    same, begins = set(), {}
    for file in end:
        to, head = entry_of(end, file)
        at, was = entry_of(start, file)
        if file in start and (was is None or not was or head is None or agreement(was, head)):
            same.add(file)
            begins[file] = at if at <= to else 0
    gone = {f: entry_of(start, f) for f in start if f not in same}
    for file in sorted(end.keys() - same):
        to, head = entry_of(end, file)
        old = [(agreement(was, head), at, f) for f, (at, was) in gone.items() if was and head and at <= to]
        best = max((o for o in old if o[0] >= RENAME_BYTES), default=None)
        begins[file] = best[1] if best else 0
        if best:
            del gone[best[2]]
    return begins


@dataclass
class Range(InputPartition):
    file: str
    rank: int
    start: int
    end: int
    first: bool  # begins at a line, as the range of a batch does


class LogTailReader(DataSourceStreamReader):
    """``maxBytes`` bounds what a batch takes in, as far as whole lines allow.

    For that the reader has to know what was read before, also in the first batch of a run: ``checkpoint`` names the folder of the
    query's checkpoint.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.max_bytes = int(options.get("maxBytes", 0))
        if self.max_bytes and "checkpoint" not in options:
            raise ValueError("a bound of batches needs the folder of the query's checkpoint")
        self.known: dict = last_offset(options["checkpoint"]) if self.max_bytes else {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = file_store(self.path)
        end = {}
        for path, size in list_files(self.path).items():
            to = last_line_end(store, path, size)
            end[path] = {"end": to, "head": identity(store, path, to)}
        if self.max_bytes:
            left = self.max_bytes
            for path, begin in sorted(beginnings(self.known, end).items()):
                to = end[path]["end"]
                if to - begin > left:
                    to = max(begin, last_line_end(store, path, begin + left)) if left > 0 else begin
                    if to == begin and left == self.max_bytes:  # a line longer than the bound is a batch of its own
                        to = next_line_end(store, path, begin)
                    end[path] = {"end": to, "head": identity(store, path, to)}
                left -= to - begin
        return end

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = end
        out = []
        for rank, (file, begin) in enumerate(sorted(beginnings(start, end).items())):
            to = entry_of(end, file)[0]
            for at in range(begin, to, self.range_bytes):
                out.append(Range(file, rank, at, min(at + self.range_bytes, to), at == begin))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """Lines that begin in the range; the last one may end beyond it."""
        store, _ = file_store(self.path)
        with store.open_input_file(partition.file) as file:
            at = partition.start if partition.first else partition.start - 1
            file.seek(at)
            held = b""
            skip = not partition.first  # the rest of a line that begins before
            while more := file.read(_STEP):
                *lines, held = (held + more).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at >= partition.end:
                        return
                    else:
                        yield line.decode("utf-8", "replace"), (partition.rank << FILE_SHIFT) + at
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        self.known = end


def last_offset(checkpoint: str) -> dict:
    """The offset of a tail that a query's checkpoint has planned last; empty for a new query."""
    from pyarrow import fs

    store, inner = file_store(checkpoint)
    found = store.get_file_info(fs.FileSelector(f"{inner.rstrip('/')}/offsets", allow_not_found=True))
    batches = [f.path for f in found if f.base_name.isdigit()]
    if not batches:
        return {}
    with store.open_input_file(max(batches, key=lambda p: int(posixpath.basename(p)))) as file:
        lines = file.read().decode().splitlines()  # version, settings of the batch, one line per source
    tails = [o for o in map(_offset, lines[2:]) if o is not None]
    if len(tails) != 1:
        raise ValueError(f"the checkpoint has {len(tails)} offsets of tails, not one")
    return tails[0]


def _offset(line: str) -> dict | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    whole = isinstance(found, dict) and all(isinstance(v, int) or (isinstance(v, dict) and "head" in v) for v in found.values())
    return found if whole else None


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linewatch_tail"

    def schema(self) -> str:
        return "value string, place long"

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)
