"""Where callers put in functions of their own: scoring, commits, progress, row-wise draws, freezing of settings and stages."""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from antiphon.sources.files import BadDocument, write_document


def scored(requests: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A batch scorer in place of a service: it gets frames of rows and returns as many, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = score(b)
            if len(out) != len(b):
                raise ValueError("a scorer returns a row for each row")
            yield out

    return requests.mapInPandas(run, schema)


def committed(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Runs a stream that hands each batch to `commit`, which makes it durable before the next one; a batch may come twice after a crash."""
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(df: DataFrame, name: str, **measures) -> tuple[DataFrame, Observation]:  # noqa: ANN003
    """df and what it tells of itself once it has run: progress without a pass of its own."""
    seen = Observation(name)
    return df.observe(seen, *(m.alias(k) for k, m in measures.items())), seen


def seeded_draws(rows: DataFrame, logits: str, seed: str, key: str, temperature: float = 1.0) -> DataFrame:
    """key, drawn (from 0): a categorical draw from each row's logits by a generator of the row's own, so that batching changes nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            drawn = []
            for values, s in zip(b[logits], b[seed]):
                x = np.asarray(values, float) / temperature
                p = np.exp(x - x.max())
                drawn.append(int(np.random.default_rng(int(s)).choice(len(x), p=p / p.sum())))
            yield pd.DataFrame({key: b[key], "drawn": drawn})

    return rows.select(key, logits, seed).mapInPandas(run, f"{key} long, drawn long")


def fingerprint_of(value: object) -> str:
    """SHA-256 of the value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def stage_fingerprint(stage: Callable, settings: dict) -> str:
    """Of a stage's source and its settings: another implementation has another one."""
    return fingerprint_of({"name": stage.__qualname__, "source": inspect.getsource(stage), "settings": settings})


def slice_fingerprint(source: str, names: list[str]) -> str:
    """Of the named functions and classes of a module's source, as syntax: comments and layout make no difference. Raises where one is missing."""
    found = {n.name: ast.dump(n) for n in ast.parse(source).body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}
    if missing := [n for n in names if n not in found]:
        raise BadDocument(f"not in the source: {', '.join(missing)}")
    return fingerprint_of({n: found[n] for n in names})


def _same(a: object, b: object) -> bool:
    """Equal in value and type, at any depth: 1, 1.0 and True all differ."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def frozen(path: str, settings: dict) -> dict:
    """Lays settings down at the first run; later runs must have the same, in value and type."""
    try:
        write_document(path, settings, exclusive=True)
        return settings
    except FileExistsError:
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        if not _same(saved, json.loads(json.dumps(settings))):
            raise BadDocument(f"{path}: the run was begun with other settings") from None
        return saved


def bound_inputs(root: str, manifest: dict[str, dict]) -> None:
    """Every file of a manifest (path: bytes, sha256) must be there as it was; raises with all that aren't."""
    wrong = []
    for name, entry in sorted(manifest.items()):
        path = os.path.join(root, name)
        if not os.path.isfile(path):
            wrong.append(f"{name}: missing")
            continue
        with open(path, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        if os.path.getsize(path) != entry["bytes"] or digest != entry["sha256"]:
            wrong.append(f"{name}: changed")
    if wrong:
        raise BadDocument("; ".join(wrong))


def phases(steps: dict[str, Callable[[], object]]) -> Callable[[str], object]:
    """An entry function over named phases; an unknown name raises."""

    def run(name: str) -> object:
        if name not in steps:
            raise KeyError(f"no phase {name}; there are {', '.join(steps)}")
        return steps[name]()

    return run


def patched(path: str, blocks: list[tuple[int, bytes, str]]) -> None:
    """Writes repaired blocks (offset, bytes, their SHA-256) into a file, each checked before any is written."""
    for at, data, sha in blocks:
        if hashlib.sha256(data).hexdigest() != sha:
            raise BadDocument(f"the block at {at} has another hash")
    with open(path, "r+b") as f:
        for at, data, _ in blocks:
            f.seek(at)
            f.write(data)
        f.flush()
        os.fsync(f.fileno())


def progress(done: DataFrame, total: int) -> DataFrame:
    """done, total, share of a table of finished rows."""
    return done.agg(F.count("*").alias("done")).select("done", F.lit(total).alias("total"), F.try_divide("done", F.lit(total)).alias("share"))
