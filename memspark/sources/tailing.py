"""Growing transcripts as a stream: full lines as they are appended, with their number in the file."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from memspark.sources.transcripts import parsed

#: Bytes that are read at once, of a file in a micro-batch at most, and of a file in one task at most.
BLOCK, MOST_BYTES, TASK_BYTES = 1 << 20, 256 << 20, 32 << 20


class Lines(InputPartition):
    """Full lines of a file from byte ``start`` to byte ``end``; the first of them has the number ``line``."""

    def __init__(self, path: str, start: int, end: int, line: int):
        self.path, self.start, self.end, self.line = path, start, end, line


def _blocks(files: fs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    with files.open_input_file(path) as f:
        f.seek(start)
        while start < end and (data := f.read(min(BLOCK, end - start))):
            start += len(data)
            yield data


class TailReader(DataSourceStreamReader):
    """The offset holds for each file the byte behind its last full line, the lines before that byte, and how often it was begun anew."""

    def __init__(self, folder: str, suffix: str, most: int, task: int):
        self.folder, self.suffix, self.most, self.task = folder, suffix, most, task
        self.marks: list[tuple[str, int, int, int]] = []  # (path, begun, byte, line) where a task may begin
        self.at: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files, top = fs.FileSystem.from_uri(self.folder)
        found = {}
        for info in files.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            byte, line, begun = self.at.get(info.path, [0, 0, 0])
            if info.size < byte:  # cut off or written anew
                byte, line, begun = 0, 0, begun + 1
            place, seen, full = byte, line, [byte, line]
            for data in _blocks(files, info.path, byte, info.size):
                if full[0] > byte and place - byte >= self.most:
                    break
                if (last := data.rfind(b"\n")) >= 0:
                    seen += data.count(b"\n")
                    full = [place + last + 1, seen]
                    if full[0] - self._mark(info.path, begun, byte) >= self.task:
                        self.marks.append((info.path, begun, *full))
                place += len(data)
            found[info.path] = [*full, begun]
        self.at = found
        return {"files": found}

    def _mark(self, path: str, begun: int, byte: int) -> int:
        return max([m[2] for m in self.marks if m[:2] == (path, begun)], default=byte)

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for path, (byte, _, begun) in end["files"].items():
            was = start["files"].get(path, [0, 0, 0])
            edges = [(was[0], was[1]) if was[2] == begun and was[0] <= byte else (0, 0)]
            edges += sorted(m[2:] for m in self.marks if m[:2] == (path, begun) and edges[0][0] < m[2] < byte)
            for (a, line), b in zip(edges, [*[e[0] for e in edges[1:]], byte], strict=True):
                if b > a:
                    out.append(Lines(path, a, b, line))
        self.at = {**end["files"], **self.at} if self.at else dict(end["files"])
        return out or [Lines("", 0, 0, 0)]

    def read(self, part: Lines) -> Iterator[tuple]:
        if not part.path:
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        rest, line = b"", part.line
        for data in _blocks(files, part.path, part.start, part.end):
            *whole, rest = (rest + data).split(b"\n")
            for value in whole:
                yield part.path, line, value.decode("utf-8", "replace")
                line += 1

    def commit(self, end: dict) -> None:
        self.marks = [m for m in self.marks if m[2] > end["files"].get(m[0], [0])[0]]

    def stop(self) -> None:
        pass


class TailSource(DataSource):
    """Format ``tail``: option path is a folder (a URI or an absolute path), suffix the ending of its files (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, line_no long, value string"

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"], o.get("suffix", ".jsonl"), int(o.get("mostBytes", MOST_BYTES)), int(o.get("taskBytes", TASK_BYTES)))


def tail_lines(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Stream of (path, line_no, value): lines of the files below ``folder``, each once it ends in a line feed.

    A file may grow: what follows its last full line is read with the rest of that line. One that gets shorter is read anew
    from its start; one rewritten in place with more bytes is not noticed. Lines are numbered from 0 within a file, which
    the driver does by counting line feeds of what was appended, at most ``mostBytes`` of a file a micro-batch; the lines
    themselves are read by tasks of ``taskBytes``. After a restart the count begins at the files' starts once.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("path", folder)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def tail_transcripts(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(source, line_no, record) as read_transcripts gives them, as a stream of growing files; malformed and empty lines are skipped."""
    return parsed(tail_lines(spark, folder, **options).filter(F.trim("value") != ""))
