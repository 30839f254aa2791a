"""Text files that grow: a data source that reads what has been added to them, line by line, each line once.

As a stream, an offset tells of every file in a folder how far it has been read, up to the end of its last whole line, and
what its first bytes were. What lies between two offsets is read in ranges of bytes, by as many tasks as it takes; a file that
has shrunk, or begins with other bytes, was cut or replaced and starts over. Offsets are in the stream's checkpoint, so a restart
goes on where it stopped. As a batch, it is the end of a file from a cursor on.

Folders may lie wherever pyarrow's file systems reach: file:, s3:, gs: and hdfs: paths.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, at long, value string"
#: Bytes of a file's beginning that tell it from another one of its name, bytes of a task, and of a look at a file's end.
HEAD, RANGE, LOOK = 64, 16 << 20, 1 << 16
#: What a batch returns if it does not say: lines, and bytes that they may lie behind the end.
LIMIT, MOST = 500, 250_000


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes first to end of a file whose lines are read from `begin` to `stop`."""

    path: str
    begin: int
    first: int
    end: int
    stop: int
    cut: bool = False  # whether `begin` may lie inside a line, which is then left out


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _ranges(path: str, begin: int, stop: int, cut: bool = False, size: int = RANGE) -> list[Range]:
    return [Range(path, begin, a, min(a + size, stop), stop, cut) for a in range(begin, stop, size)]


def _lines(r: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range as batches; a last line without an end counts as one."""
    store, path = _store(r.path)
    with store.open_input_file(path) as f:
        inside = r.first > r.begin or r.cut and r.first > 0
        at = r.first - 1 if inside else r.first  # from the byte before, as that may be a line's end
        f.seek(at)
        rest, skip = b"", inside
        while at < r.stop and (raw := f.read(min(RANGE, r.stop - at))):
            rows, data, offset = [], rest + raw, at - len(rest)
            begin = 0
            while (end := data.find(b"\n", begin)) >= 0:
                if not skip:
                    if offset + begin >= r.end:
                        break
                    rows.append((offset + begin, data[begin:end]))
                skip, begin = False, end + 1
            rest, at = data[begin:], at + len(raw)
            if rows:
                yield _batch(r.path, rows)
            if not skip and at - len(rest) >= r.end:
                return
        if rest and not skip and at - len(rest) < r.end:
            yield _batch(r.path, [(at - len(rest), rest)])


def _batch(path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([x.decode(errors="replace") for _, x in rows])], ["path", "at", "value"])


class TailStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob, self.range = options["path"], options.get("glob", "*"), int(options.get("rangebytes", RANGE))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """path: [cursor, size, first bytes] of each file of the folder itself; the cursor is the end of its last whole line."""
        store, folder = _store(self.folder)
        found = {}
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and fnmatch.fnmatch(info.base_name, self.glob):
                with store.open_input_file(info.path) as f:
                    size = f.size()
                    found[posixpath.join(self.folder, info.base_name)] = [self._whole(f, size), size, f.read_at(min(HEAD, size), 0).hex()]
        return found

    @staticmethod
    def _whole(f, size: int) -> int:
        """The end of the last whole line: from the end back, a look at a time."""
        stop = size
        while stop > 0:
            begin = max(0, stop - LOOK)
            if (k := f.read_at(stop - begin, begin).rfind(b"\n")) >= 0:
                return begin + k + 1
            stop = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (cursor, size, head) in sorted(end.items()):
            before = start.get(path)
            # what there was at the last offset is still there if the file is no shorter and begins with the same bytes
            begin = before[0] if before and size >= before[1] and head.startswith(before[2]) else 0
            out += _ranges(path, begin, cursor, size=self.range) if cursor > begin else []
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(partition)


class TailBatch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob, self.range = options["path"], options.get("glob", "*"), int(options.get("rangebytes", RANGE))
        self.cursor, self.most = int(options["cursor"]) if "cursor" in options else None, int(options.get("most", MOST))

    def partitions(self) -> list[InputPartition]:
        store, inner = _store(self.path)
        paths = [self.path]
        if store.get_file_info(inner).type == fs.FileType.Directory:
            below = (x for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file and fnmatch.fnmatch(x.base_name, self.glob))
            paths = sorted(posixpath.join(self.path, x.path[len(inner.rstrip("/")) + 1 :]) for x in below)
        out = [r for p in paths for start, size in [window(p, self.cursor, self.most)] for r in _ranges(p, start, size, cut=True, size=self.range)]
        return out or [Range(self.path, 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(partition) if partition.stop else iter(())


class TailSource(DataSource):
    """`path` is a folder for a stream (with `glob`), and a file (with `cursor` and `most`) or all files below a folder (with
    `glob` and `most`) for a batch; `rangeBytes` is a task's."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailBatch:
        return TailBatch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> TailStream:  # noqa: N802
        return TailStream({k.lower(): v for k, v in self.options.items()})


def window(path: str, cursor: int | None, most: int) -> tuple[int, int]:
    """Where to begin reading a file, and its size: at the cursor, or `most` bytes before the end if there is none, if it
    lies beyond the end (the file was cut) or if more than that has been added. No file: 0, 0."""
    store, inner = _store(path)
    info = store.get_file_info(inner)
    size = info.size if info.is_file else 0
    start = cursor if cursor is not None and 0 <= cursor <= size and size - cursor <= most else max(0, size - most)
    return start, size


def stream(spark: SparkSession, folder: str, glob: str = "*.jsonl", **options) -> DataFrame:
    """path, at (a line's first byte), value: lines that are added to the files of a folder, each once."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").options(path=folder, glob=glob, **options).load()


def tail(spark: SparkSession, path: str, cursor: int | None = None, limit: int = LIMIT, most: int = MOST, **options) -> tuple[DataFrame, dict]:
    """The last `limit` lines of a file from a cursor on (path, at, value), and what the next call needs to know: its cursor,
    whether this one started over, and whether something before its start was left out.

    A first line that is cut off is left out, as is an empty last one. A file that is not there has no lines.
    """
    spark.dataSource.register(TailSource)
    start, size = window(path, cursor, most)
    chosen = options | ({} if cursor is None else {"cursor": cursor})
    rows = spark.read.format("tail").options(path=path, most=most, **chosen).load()
    over = cursor is not None and start != cursor
    return rows.orderBy(F.desc("at")).limit(limit), {"cursor": size, "size": size, "reset": over, "truncated": start > 0 and (cursor is None or over)}


def ends(spark: SparkSession, folder: str, glob: str = "*", limit: int = LIMIT, most: int = MOST, **options) -> DataFrame:
    """path, at, value: the last `limit` lines of every file below a folder, of those that begin in its last `most` bytes."""
    spark.dataSource.register(TailSource)
    rows = spark.read.format("tail").options(path=folder, glob=glob, most=most, **options).load()
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at")))
    return rows.withColumn("last", last).where(F.col("last") <= limit).drop("last")
