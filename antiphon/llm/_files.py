"""Files written by tasks into the shared folder: under a name of the attempt first, then renamed, so that a task that is lost or runs twice leaves one whole file."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf


def filesystem(uri: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


@contextlib.contextmanager
def whole_file(uri: str) -> Iterator[pa.NativeFile]:
    fs, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(draft, compression=None) as out:
            yield out
        fs.move(draft, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(draft)
        raise


def open_file(uri: str) -> pa.NativeFile:
    """For random access; a local file is mapped, so that what is read from it is not copied."""
    fs, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(fs, pf.LocalFileSystem) else fs.open_input_file(path)
