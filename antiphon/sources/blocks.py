"""Inventories of files of any size: a Python data source that reads each file, or each block, where a task runs. No file is ever one row's content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow.fs as pf
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time, and bytes of one task's share of a file that is cut into blocks, about.
STEP, SHARE = 8 << 20, 256 << 20


def place_of(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if ":/" in path else (pf.LocalFileSystem(), path)


class _Span(InputPartition):
    def __init__(self, path: str, begin: int, end: int, size: int):
        self.path, self.begin, self.end, self.size = path, begin, end, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", 0))

    def partitions(self) -> list[InputPartition]:
        fs, path = place_of(self.path)
        found = fs.get_file_info(path)
        files = [found] if found.type == pf.FileType.File else [x for x in fs.get_file_info(pf.FileSelector(path, recursive=True)) if x.type == pf.FileType.File]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda x: x.path):
            share = f.size if not self.block else max(1, SHARE // self.block) * self.block
            out += [_Span(f.path, at, min(at + share, f.size), f.size) for at in range(0, max(f.size, 1), max(share, 1))]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = place_of(self.path)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.begin)
            block = self.block or max(partition.size, 1)
            for at in range(partition.begin, max(partition.end, partition.begin + 1), block):
                digest, left = hashlib.sha256(), min(block, partition.end - at)
                size = left
                while left > 0:
                    data = f.read(min(left, STEP))
                    if not data:
                        raise OSError(f"{partition.path} is shorter than it was")
                    digest.update(data)
                    left -= len(data)
                yield partition.path, at // block, at, size, digest.hexdigest()


class FileBlocks(DataSource):
    """spark.dataSource.register(FileBlocks); then spark.read.format("file_blocks").option("block", bytes).load(path). Without a block's size a row is a whole file."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return "path string, block long, at long, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))
