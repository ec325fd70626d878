"""Lines of large text files: byte ranges read by as many tasks, and a bounded stream of token files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from antiphon.sources.blocks import place_of

#: Bytes of one task's share of a file, bytes read at a time, and lines of a batch.
SHARE, STEP, TOGETHER = 64 << 20, 4 << 20, 8_192


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, size: int):
        self.path, self.begin, self.end, self.size = path, begin, end, size


def lines_of(f: pa.NativeFile, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """(where it begins, the line, whether nothing ends it) of the lines that begin in [begin, end). One that goes on beyond the end is read whole."""
    at = begin
    if begin:
        # A line begins here only if a new line stands before; else the next one does.
        at = begin - 1
        f.seek(at)
        while True:
            data = f.read(min(STEP, size - at)) if at < size else b""
            if not data:
                return
            cut = data.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(data)
    f.seek(at)
    parts: list[bytes] = []
    where = read = at
    while where < end:
        data = f.read(min(STEP, size - read)) if read < size else b""
        if not data:
            if parts:
                yield where, b"".join(parts), True
            return
        read += len(data)
        pieces = data.split(b"\n")
        for piece in pieces[:-1]:
            line = b"".join([*parts, piece])
            parts = []
            if where >= end:
                return
            yield where, line, False
            where += len(line) + 1
        if pieces[-1]:
            parts.append(pieces[-1])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.share = options["path"], int(options.get("share", SHARE))

    def partitions(self) -> list[InputPartition]:
        fs, path = place_of(self.path)
        found = fs.get_file_info(path)
        files = [found] if found.type == pf.FileType.File else [x for x in fs.get_file_info(pf.FileSelector(path, recursive=True, allow_not_found=True)) if x.type == pf.FileType.File and not os.path.basename(x.path).startswith((".", "_"))]
        return [_Range(x.path, at, min(at + self.share, x.size), x.size) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, self.share)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of a folder without lines
            return
        fs, _ = place_of(self.path)
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("line", pa.string()), ("torn", pa.bool_())])
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            at, line, torn = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array(at), pa.array([x.decode("utf-8", "replace") for x in line]), pa.array(torn)], schema=schema)

        with fs.open_input_file(partition.path) as f:
            for x in lines_of(f, partition.begin, partition.end, partition.size):
                rows.append(x)
                if len(rows) == TOGETHER:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class FileLines(DataSource):
    """spark.dataSource.register(FileLines); spark.read.format("file_lines").option("share", bytes).load(path). at: the byte at which a line begins; torn: nothing ends it, so it's the file's last."""

    @classmethod
    def name(cls) -> str:
        return "file_lines"

    def schema(self) -> str:
        return "path string, at long, line string, torn boolean"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


class _TokenReader(SimpleDataSourceStreamReader):
    """Offsets: a file's place in the folder's order, and a byte in it. A line that isn't ended yet waits for a later batch."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most", 64))

    def _files(self) -> list[tuple[str, int]]:
        fs, path = place_of(self.path)
        found = fs.get_file_info(pf.FileSelector(path, allow_not_found=True))
        return sorted((x.path, x.size) for x in found if x.type == pf.FileType.File and x.path.endswith(".jsonl"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "at": 0}

    def _rows(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        fs, _ = place_of(self.path)
        rows, now = [], dict(start)
        for path, size in self._files():
            if path < now["file"] or (end is not None and path > end["file"]):
                continue
            at = now["at"] if path == now["file"] else 0
            stop = end["at"] if end is not None and path == end["file"] else size
            if at < stop:
                with fs.open_input_file(path) as f:
                    for where, line, torn in lines_of(f, at, stop, size):
                        if torn or (end is None and len(rows) == self.most):
                            break
                        x = json.loads(line)
                        rows.append((x["request"], int(x["seq"]), x["text"]))
                        at = where + len(line) + 1
            now = {"file": path, "at": at}
            if end is None and len(rows) == self.most:
                break
        return rows, now

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._rows(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._rows(start, end)[0])

    def commit(self, end: dict) -> None:
        """Nothing to let go of: files stay."""


class TokenFiles(DataSource):
    """spark.dataSource.register(TokenFiles); spark.readStream.format("token_files").option("most", 64).load(folder): tokens (JSON lines of request, seq, text) in .jsonl files that grow, at most so many a batch. New files must have later names."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "request string, seq long, text string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _TokenReader(dict(self.options))
