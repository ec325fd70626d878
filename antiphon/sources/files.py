"""JSON, JSON lines, CSV results and file inventories."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from antiphon.sources.blocks import FileBlocks
from antiphon.sources.lines import SHARE, FileLines

# Fixed value: the columns of a results file, in order.
RESULT_COLUMNS = ("prompt_id", "instruction", "category", "response", "heuristic_refusal", "refusal_matches", "generated_tokens", "finish_reason", "model_id", "source_revision", "thinking", "max_new_tokens", "run_id", "status")


class BadDocument(ValueError):
    pass


def strict_json(text: str) -> dict:
    """An object without repeated keys, NaN or infinities, at any depth."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise BadDocument("a key is there twice")
        return out

    def constant(name: str) -> None:
        raise BadDocument(f"{name} is not JSON")

    value = json.loads(text, object_pairs_hook=unique, parse_constant=constant)
    if not isinstance(value, dict):
        raise BadDocument("not an object")
    return value


def canonical_json(value: object) -> str:
    """Sorted keys, blanks after separators, letters as they are."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False)


def read_strict_json(spark: SparkSession, path: str) -> DataFrame:
    """path, document (canonical text) for each file, whole; raises where a file is not strict JSON."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "document": [canonical_json(strict_json(bytes(x).decode())) for x in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, document string")


def any_files(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(place)
    return found is not None and len(found) > 0


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = False, key: str | None = None, share: int = SHARE) -> DataFrame:
    """Rows of JSON lines. Blank lines are skipped and a file's last line may be torn if nothing ends it; any other bad line raises. With strict, blank and torn lines raise, too.

    A file is read in byte ranges of `share` bytes by as many tasks; the one that has the file's end knows whether its last line
    is ended. A path without files has no rows. With `key`, a row without that text is an error as well.
    """
    spark.dataSource.register(FileLines)
    lines = spark.read.format("file_lines").option("share", share).load(path)
    parsed = lines.withColumn("r", F.from_json("line", StructType([*schema.fields, StructField("_bad", StringType())]), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    blank, bad = F.trim("line") == "", F.col("r").isNull() | F.col("r._bad").isNotNull()
    allowed = F.lit(False) if strict else blank | (F.col("torn") & bad)
    told = F.concat(F.lit("bad line at byte "), F.col("at").cast("string"), F.lit(" of "), "path")
    checked = parsed.withColumn("ok", F.when(~(blank | bad), F.lit(True)).when(allowed, F.lit(False)).otherwise(F.raise_error(told).cast("boolean")))
    rows = checked.where("ok").select(*(F.col(f"r.{f.name}") for f in schema))
    if key is None:
        return rows
    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return rows.where(F.when(named, F.lit(True)).otherwise(F.raise_error(F.lit(f"a row without {key}")).cast("boolean")))


def _tail(f: BinaryIO, step: int = 1 << 16) -> tuple[int, bytes]:
    """Where a file's last line begins, and what stands there: read from the end, no more than that line."""
    at = f.seek(0, os.SEEK_END)
    parts: list[bytes] = []
    while at:
        size = min(step, at)
        at -= size
        f.seek(at)
        data = f.read(size)
        cut = data.rfind(b"\n")
        if cut >= 0:
            return at + cut + 1, b"".join([data[cut + 1 :], *reversed(parts)])
        parts.append(data)
    return 0, b"".join(reversed(parts))


def mended(path: str) -> int:
    """Ends a journal's last line: with a new line if it is whole, else by cutting it off. Returns how many bytes were cut."""
    with open(path, "rb+") as f:
        begin, tail = _tail(f)
        if not tail.strip():
            return 0
        try:
            json.loads(tail)
        except ValueError:
            f.truncate(begin)
            return len(tail)
        f.seek(0, os.SEEK_END)
        f.write(b"\n")
        return 0


def append_record(path: str, record: dict) -> None:
    """One sequential writer's line, on disk when this returns; what an earlier crash left torn is mended first."""
    if os.path.exists(path):
        mended(path)
    with open(path, "ab") as f:
        f.write(json.dumps(record, ensure_ascii=False, allow_nan=False).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def write_document(path: str, value: object, exclusive: bool = False) -> None:
    """A JSON document, whole or not at all, under a draft's name first. Exclusive: raises FileExistsError where there is one, also if another writer was faster."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with open(draft, "x", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, allow_nan=False, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
        if exclusive:
            os.link(draft, path)
        else:
            os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)


def read_pool(spark: SparkSession, path: str, sha256: str, expected: int, column: str = "instruction") -> DataFrame:
    """The rows of a JSON list (a file of prompts, read on the driver), after its checksum, their number, and that no text is blank."""
    with open(path, "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise BadDocument(f"{path}: another checksum")
    rows = json.loads(data)
    if not isinstance(rows, list) or len(rows) != expected:
        raise BadDocument(f"{path}: not a list of {expected}")
    if not all(isinstance(r, dict) and isinstance(r.get(column), str) and r[column].strip() for r in rows):
        raise BadDocument(f"{path}: a row without {column}")
    return spark.createDataFrame([(i, r[column], json.dumps(r, ensure_ascii=False, sort_keys=True)) for i, r in enumerate(rows)], f"place int, {column} string, record string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line: the lines of text files that aren't blank, without white space at the ends."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("line"))
    return lines.where("line <> ''")


def write_json_by(df: DataFrame, path: str, key: str, order: str) -> None:
    """JSON lines in a folder for each key, and all of them in one folder, ordered."""
    df.sortWithinPartitions(order).write.partitionBy(key).json(f"{path}/by-{key}")
    df.orderBy(order).write.json(f"{path}/all")


def record_path(root: str, group: str, key: str) -> str:
    """Where a record of a store with a file for each row stands: a name that the key fixes and that is safe in any file system."""
    return f"{root}/{group}/{hashlib.sha256(key.encode()).hexdigest()}.json"


def insert_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't there yet: nothing that was written is written again."""
    spark = df.sparkSession
    if any_files(spark, path):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """A new file for each append, whole or not at all: no torn lines to mend."""
    df.write.mode("append").json(path)


def as_flag(value: Column) -> Column:
    return F.coalesce(F.when(value, "true").when(~value, "false"), F.lit(""))


def write_results(df: DataFrame, path: str, model_id: str, revision: str) -> None:
    """CSV of the fixed columns, everything quoted; defaults are filled in, booleans are true, false or empty, and lists are JSON."""
    have = {f.name: f.dataType.typeName() for f in df.schema}
    defaults = {"model_id": model_id, "source_revision": revision}

    def cell(name: str) -> Column:
        if name == "status":
            own = F.col("status").cast("string") if "status" in have else F.lit(None).cast("string")
            filled = F.coalesce(F.col("response"), F.lit("")) != ""
            return F.coalesce(F.when(own != "", own), F.when(filled, "completed").otherwise("empty"))
        if name not in have:
            return F.lit(defaults.get(name, ""))
        if have[name] == "boolean":
            return as_flag(F.col(name))
        if have[name] in ("array", "map", "struct"):
            return F.to_json(name)
        text = F.col(name).cast("string")
        return F.coalesce(F.when(text != "", text), F.lit(defaults.get(name, "")))

    df.select(*(cell(c).alias(c) for c in RESULT_COLUMNS)).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All values as text; raises where a header is not exactly the fixed columns."""
    schema = ", ".join(f"{c} string" for c in RESULT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)


def inventory(spark: SparkSession, path: str, block: int | None = None) -> DataFrame:
    """path, bytes, sha256 of each file under a folder; with a block size also block, at: a row for each block."""
    spark.dataSource.register(FileBlocks)
    if block is None:
        return spark.read.format("file_blocks").load(path).select("path", "bytes", "sha256")
    return spark.read.format("file_blocks").option("block", block).load(path).where("bytes > 0")
