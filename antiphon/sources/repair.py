"""Repair of a folder's files by blocks: each file anew from the blocks that are right here and those that are fetched, all or none of them put in place."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antiphon.sources.blocks import place_of
from antiphon.sources.files import BadDocument, inventory


def relative(blocks: DataFrame, root: str) -> DataFrame:
    """An inventory with paths from the folder on."""
    _, place = place_of(root)
    return blocks.withColumn("path", F.substring(F.col("path"), F.lit(len(place.rstrip("/")) + 2), F.length("path")))


def _block(fs: pf.FileSystem, path: str, at: int, size: int) -> bytes:
    with contextlib.suppress(FileNotFoundError):
        with fs.open_input_file(path) as f:
            if f.size() >= at + size:
                f.seek(at)
                return f.read(size)
    return b""


def repair(spark: SparkSession, declared: DataFrame, source: str, local: str) -> DataFrame:
    """path, blocks, fetched, problem (repaired, right or surplus), after files under `local` are what was declared: path (from the folder on), at, bytes, sha256 of each block.

    A task makes one file, under a draft's name: a block that is right in place is taken from there, any other from `source`, and checked.
    Only when all drafts are whole are they moved, and files that weren't declared deleted. If any block can't be had, nothing changes.
    """
    run = uuid.uuid4().hex
    files = declared.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "bytes", "sha256"))).alias("blocks"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, theirs = place_of(source)
        here, own = place_of(local)
        for b in batches:
            out = []
            for path, blocks in zip(b["path"], b["blocks"]):
                end, fetched, draft = 0, 0, f"{own}/{path}.{run}.draft"
                here.create_dir(draft.rpartition("/")[0], recursive=True)
                with here.open_output_stream(draft, compression=None) as f:
                    for x in blocks:
                        if x["at"] != end:
                            raise BadDocument(f"{path}: a gap or an overlap at {end}")
                        data = _block(here, f"{own}/{path}", x["at"], x["bytes"])
                        if hashlib.sha256(data).hexdigest() != x["sha256"] or len(data) != x["bytes"]:
                            data, fetched = _block(there, f"{theirs}/{path}", x["at"], x["bytes"]), fetched + 1
                            if hashlib.sha256(data).hexdigest() != x["sha256"]:
                                raise BadDocument(f"{path}: the block at {x['at']} has another hash at its source, too")
                        f.write(data)
                        end += x["bytes"]
                info = here.get_file_info(f"{own}/{path}")
                out.append((path, len(blocks), fetched, "right" if not fetched and info.type == pf.FileType.File and info.size == end else "repaired"))
            yield pd.DataFrame(out, columns=["path", "blocks", "fetched", "problem"])

    here, own = place_of(local)
    try:
        # As many rows as files.
        made = files.repartition("path").mapInPandas(make, "path string, blocks long, fetched long, problem string").collect()
        names = {r.path for r in made}
        there = [x.path[len(own.rstrip("/")) + 1 :] for x in here.get_file_info(pf.FileSelector(own, recursive=True, allow_not_found=True)) if x.type == pf.FileType.File]
        surplus = [p for p in there if p not in names and not p.endswith(f".{run}.draft")]
        for r in made:
            if r.problem == "repaired":
                here.move(f"{own}/{r.path}.{run}.draft", f"{own}/{r.path}")
        for p in surplus:
            here.delete_file(f"{own}/{p}")
    finally:
        for x in here.get_file_info(pf.FileSelector(own, recursive=True, allow_not_found=True)):
            if x.path.endswith(f".{run}.draft"):
                here.delete_file(x.path)
    return spark.createDataFrame([*map(tuple, made), *((p, 0, 0, "surplus") for p in surplus)], "path string, blocks long, fetched long, problem string")


def declared_blocks(spark: SparkSession, root: str, block: int) -> DataFrame:
    """What `root` holds, as repair() wants it declared. An empty file has one block of no bytes."""
    return relative(inventory(spark, root, block), root).select("path", "at", "bytes", "sha256")
