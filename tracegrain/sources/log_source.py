"""Log files as a Python data source: lines by byte ranges, for a batch or a stream that resumes at (file, byte).

A line belongs to the range that holds its first byte, so a line cut by a border is read once, by the task before the border.  The stream's offset
holds for each file the byte after its last whole line; a line that is still being written waits for its end.  Files are opened through
`pyarrow.fs`, so any path that it knows will do; the driver lists files and looks at their last bytes, tasks read them.

Options: `path` (a folder, read with all below it, or a file), `suffix` (.jsonl), `rangebytes` (64 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import logs

FORMAT = "event_log_lines"
SCHEMA = "file string, start bigint, line string"
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
BATCH_LINES = 10_000


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class _Files:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("option path is missing")
        self.uri = options["path"]
        self.suffix = options.get("suffix", ".jsonl")
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.uri)

    def sizes(self) -> dict[str, int]:
        system, root = self.system()
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.is_file and f.path.endswith(self.suffix)}

    def ranges(self, spans: dict[str, tuple[int, int]]) -> list[Range]:
        return [Range(file, at, min(at + self.step, stop)) for file, (start, stop) in sorted(spans.items()) for at in range(start, stop, self.step)]

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The lines whose first byte lies in the range, without line breaks; blank ones are left out."""
        system, _ = self.system()
        starts, lines = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.file] * len(lines)), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], names=["file", "start", "line"])

        with system.open_input_file(part.file) as source:
            at = part.start
            if at:  # the line that ends at or after the byte before belongs to the range before
                source.seek(at - 1)
                at -= 1
            first, rest = bool(part.start), b""
            while True:
                block = source.read(BLOCK_BYTES)
                pieces = (rest + block).split(b"\n")
                rest = pieces.pop()
                if not block and rest:  # a last line without a line break
                    pieces, rest = [rest], b""
                for piece in pieces:
                    begin, at = at, at + len(piece) + 1
                    if first:
                        first = False
                    elif begin >= part.stop:
                        rest, block = b"", b""
                        break
                    elif piece.strip():
                        starts.append(begin)
                        lines.append(piece.decode("utf-8", errors="replace"))
                if len(lines) >= BATCH_LINES:
                    yield batch()
                    starts, lines = [], []
                if not block or (at >= part.stop and not first):
                    break
        if lines:
            yield batch()


class LogReader(DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def partitions(self) -> list[Range]:
        return self.files.ranges({f: (0, n) for f, n in self.files.sizes().items()}) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from self.files.lines(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, files: _Files):
        self.files, self.known = files, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = self.files.system()
        for file, size in self.files.sizes().items():
            if size > self.known.get(file, 0):
                self.known[file] = self._last_whole(system, file, self.known.get(file, 0), size)
        return dict(self.known)

    @staticmethod
    def _last_whole(system: pyarrow.fs.FileSystem, file: str, known: int, size: int) -> int:
        """The byte after the last line break in [known, size), or `known`."""
        with system.open_input_file(file) as source:
            stop = size
            while stop > known:
                at = max(known, stop - BLOCK_BYTES)
                source.seek(at)
                found = source.read(stop - at).rfind(b"\n")
                if found >= 0:
                    return at + found + 1
                stop = at
        return known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.files.ranges({f: (start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)})

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.files.lines(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(_Files(self.options))

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(_Files(self.options))


def lines(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Lines of the log files below `path`: file, start (byte), line."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).options(path=path, **{k.replace("_", ""): str(v) for k, v in options.items()}).load()


def events(read: DataFrame) -> DataFrame:
    """Event rows of either envelope from `lines`, as `logs.read_log` gives them, with the place they were read at (file, start)."""
    parsed = F.from_json("line", logs.RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = read.select("file", "start", parsed.alias("_r")).select("file", "start", "_r.*")
    return logs.normalise(raw.withColumns({"_file": F.col("file"), "_block": F.col("start"), "_row": F.col("start")})).withColumnsRenamed(
        {"_file": "file", "_block": "start"}).drop("_row")
