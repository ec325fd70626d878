"""A store with a file for each record, written whole or not at all, in any file system that pyarrow knows.

Tasks write drafts under names of their own; what they tell the driver of them are commit messages. Only when all tasks are done are the
drafts moved to their names, which the records' keys fix. A run that fails, or a task that runs twice, leaves no record.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pf
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from antiphon.sources.blocks import place_of
from antiphon.sources.files import BadDocument, record_path, strict_json

#: Where drafts lie, beside the groups; and records of one reading task.
DRAFTS, TOGETHER = "_drafts", 1_000


@dataclass
class Drafts(WriterCommitMessage):
    """What a task has written: draft and name, and the drafts' folder."""

    files: list[tuple[str, str]] = field(default_factory=list)


def _there(fs: pf.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pf.FileType.NotFound


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.fs_uri, self.group, self.key, self.exclusive = options["path"], options.get("group", "group"), options.get("key", "key"), options.get("exclusive", "true") == "true"
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Drafts:
        fs, root = place_of(self.fs_uri)
        folder, out = f"{root}/{DRAFTS}/{self.run}/{uuid.uuid4().hex}", Drafts()
        fs.create_dir(folder, recursive=True)
        seen: set[str] = set()
        for n, row in enumerate(iterator):
            record = row.asDict(recursive=True)
            name = record_path(root, str(record[self.group]), str(record[self.key]))
            if name in seen:
                raise BadDocument(f"{name}: a record is there twice")
            seen.add(name)
            draft = f"{folder}/{n}.json"
            with fs.open_output_stream(draft, compression=None) as f:
                f.write(json.dumps(record, sort_keys=True, ensure_ascii=False, allow_nan=False).encode())
            out.files.append((draft, name))
        return out

    def commit(self, messages: list[Drafts | None]) -> None:
        """All names are looked at before any draft is moved; what can't be moved undoes the rest."""
        fs, root = place_of(self.fs_uri)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) != len(names):
            raise BadDocument("a record is there twice")
        if self.exclusive and (taken := [n for n in names if _there(fs, n)]):
            raise FileExistsError(f"{len(taken)} records are there already, such as {taken[0]}")
        for folder in {name.rpartition("/")[0] for name in names}:
            fs.create_dir(folder, recursive=True)
        moved = []
        try:
            for draft, name in files:
                fs.move(draft, name)
                moved.append((draft, name))
        except BaseException:
            for draft, name in moved if self.exclusive else []:
                with contextlib.suppress(OSError):
                    fs.move(name, draft)
            raise
        self._clear(fs, root)

    def abort(self, messages: list[Drafts | None]) -> None:
        fs, root = place_of(self.fs_uri)
        self._clear(fs, root)

    def _clear(self, fs: pf.FileSystem, root: str) -> None:
        with contextlib.suppress(OSError):
            fs.delete_dir(f"{root}/{DRAFTS}/{self.run}")


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        fs, root = place_of(self.path)
        found = [x.path for x in fs.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True)) if x.type == pf.FileType.File and f"/{DRAFTS}/" not in x.path and x.path.endswith(".json")]
        found.sort()
        return [_Names(found[i : i + TOGETHER]) for i in range(0, len(found), TOGETHER)]

    def read(self, partition: _Names | None) -> Iterator[tuple]:
        if partition is None:  # of an empty store
            return
        fs, _ = place_of(self.path)
        for name in partition.names:
            with fs.open_input_stream(name) as f:
                text = f.read().decode()
            strict_json(text)
            yield name.split("/")[-2], name, text


class RecordStore(DataSource):
    """spark.dataSource.register(RecordStore); df.write.format("record_store").option("key", ...).option("group", ...).mode("append").save(path), and load(path).

    exclusive (true unless said otherwise): a record whose name is taken fails the whole write.
    """

    @classmethod
    def name(cls) -> str:
        return "record_store"

    def schema(self) -> str:
        return "group string, path string, record string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("a store of records is only added to")
        return _Writer(dict(self.options))
