"""Tensor files: an 8-byte length, a JSON header, and the values. As a Python data source with two tables, headers and vectors."""

from __future__ import annotations

import contextlib
import json
import math
import os
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow.fs as pf
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from antiphon.sources.blocks import place_of
from antiphon.sources.files import BadDocument, strict_json

# Bytes of a value.
WIDTHS = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
MOST_HEADER = 100 << 20


def opened(path: str) -> BinaryIO:
    """For reading, in any file system that pyarrow knows by a URI."""
    fs, place = place_of(path)
    return fs.open_input_file(place)


def read_header(path: str) -> tuple[int, dict[str, dict]]:
    """Where the values begin, and the tensors; their spans must cover the values without a gap or an overlap."""
    with opened(path) as f:
        raw = f.read(8)
        if len(raw) < 8 or not 0 < (size := struct.unpack("<Q", raw)[0]) <= MOST_HEADER:
            raise BadDocument(f"{path}: no header")
        tensors = strict_json(f.read(size).decode())
        f.seek(0, os.SEEK_END)
        whole = f.tell()
    tensors.pop("__metadata__", None)
    at = 0
    for name, t in sorted(tensors.items(), key=lambda x: x[1]["data_offsets"]):
        begin, end = t["data_offsets"]
        if begin != at or end - begin != math.prod(t["shape"]) * WIDTHS[t["dtype"]]:
            raise BadDocument(f"{path}: the span of {name} is wrong")
        at = end
    if whole != 8 + size + at:
        raise BadDocument(f"{path}: values are missing, or something follows them")
    return 8 + size, tensors


@contextlib.contextmanager
def whole(path: str) -> Iterator[BinaryIO]:
    """A file that is there whole or not at all, and on disk when this returns: under a draft's name of its own first, so that two writers don't meet."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with open(draft, "xb") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)


def write_tensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    """32-bit floats, under another name first."""
    header, at = {}, 0
    for name, x in tensors.items():
        header[name] = {"dtype": "F32", "shape": list(x.shape), "data_offsets": [at, at + 4 * x.size]}
        at += 4 * x.size
    text = json.dumps(header).encode()
    with whole(path) as f:
        f.write(struct.pack("<Q", len(text)) + text)
        for x in tensors.values():
            f.write(np.ascontiguousarray(x, "<f4").tobytes())


def copy_missing(source: list[str], export: list[str], path: str, prefix: str) -> list[str]:
    """Writes the tensors named prefix... that source files have and exported ones lack, byte by byte, as one more file; their names. Raises where a tensor that both have differs in type or shape, and where nothing is missing."""
    have = {name: t for p in export for name, t in read_header(p)[1].items()}
    headers = [(p, *read_header(p)) for p in source]
    if other := sorted(n for _, _, tensors in headers for n, t in tensors.items() if n in have and any(t[k] != have[n][k] for k in ("dtype", "shape"))):
        raise BadDocument(f"{other[0]} has another type or shape in the export")
    wanted = [(name, p, begin, t) for p, begin, tensors in headers for name, t in sorted(tensors.items()) if name.startswith(prefix) and name not in have]
    if not wanted:
        raise BadDocument(f"no tensor {prefix}... is missing")
    header, at = {}, 0
    for name, _, _, t in wanted:
        size = t["data_offsets"][1] - t["data_offsets"][0]
        header[name] = {"dtype": t["dtype"], "shape": t["shape"], "data_offsets": [at, at + size]}
        at += size
    text = json.dumps(header).encode()
    with whole(path) as out:
        out.write(struct.pack("<Q", len(text)) + text)
        for _, p, begin, t in wanted:
            with opened(p) as f:
                f.seek(begin + t["data_offsets"][0])
                left = t["data_offsets"][1] - t["data_offsets"][0]
                while left:
                    part = f.read(min(left, 8 << 20))
                    if not part:
                        raise BadDocument(f"{p} is shorter than its header says")
                    out.write(part)
                    left -= len(part)
    return [name for name, *_ in wanted]


def check_bank(path: str, shape: list[int]) -> None:
    """A bank has one tensor, "vectors", of that shape, in 32-bit floats."""
    tensors = read_header(path)[1]
    if list(tensors) != ["vectors"] or tensors["vectors"]["dtype"] != "F32" or tensors["vectors"]["shape"] != shape:
        raise BadDocument(f"{path}: not a bank of shape {shape}")


class _Part(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        folder = options["path"]
        fs, place = place_of(folder)
        scheme = folder[: folder.index(place)] if ":/" in folder and place in folder else ""
        info = fs.get_file_info(place)
        inside = [x.path for x in fs.get_file_info(pf.FileSelector(place)) if x.path.endswith(".safetensors")] if info.type == pf.FileType.Directory else [place]
        self.paths = [scheme + x for x in sorted(inside)]
        self.vectors = options.get("table", "headers") == "vectors"

    def partitions(self) -> list[InputPartition]:
        """A task for each file, or for each tensor."""
        return [_Part(p, name) for p in self.paths for name in (sorted(read_header(p)[1]) if self.vectors else [""])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, tensors = read_header(partition.path)
        if not self.vectors:
            for name, t in sorted(tensors.items()):
                yield os.path.basename(partition.path), name, t["dtype"], [int(n) for n in t["shape"]], *t["data_offsets"]
            return
        t = tensors[partition.name]
        if t["dtype"] != "F32" or not t["shape"]:
            raise BadDocument(f"{partition.name} has no vectors of 32-bit floats")
        width = t["shape"][-1]
        with opened(partition.path) as f:
            f.seek(start + t["data_offsets"][0])
            for row, at in enumerate(np.ndindex(*t["shape"][:-1])):
                v = np.frombuffer(f.read(4 * width), "<f4")
                if not np.isfinite(v).all():
                    raise BadDocument(f"{partition.name}: a value of row {row} is not finite")
                yield partition.name, [int(i) for i in at], v.tolist(), float(np.sqrt((v.astype(float) ** 2).sum()))


class TensorFiles(DataSource):
    """spark.dataSource.register(TensorFiles); then spark.read.format("tensor_files").option("table", "headers" or "vectors").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "tensor_files"

    def schema(self) -> str:
        if self.options.get("table", "headers") == "vectors":
            return "tensor string, place array<int>, vec array<float>, norm double"
        return "file string, tensor string, dtype string, shape array<bigint>, begin bigint, end bigint"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))
